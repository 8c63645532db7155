"""Equi-joins with the language's output columns, and the as-of join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.temporal import micros, span_us
from millrace.operators.ranges import handed_on, ranged

#: Rows of one key that one task may sort in an as-of join.
HOT_ROWS = 5_000_000


def join(left: DataFrame, right: DataFrame, on: list[str | tuple[str, str]], how: str = "inner") -> DataFrame:
    """``inner``, ``left``, ``right`` or ``full`` join; null keys match nothing.

    Columns are the left ones, then the right ones but its keys; a name that the left has gets
    ``_r``. Right and full joins show the right key where the left is missing. Keys of different
    types are compared as text. Spark picks broadcast or shuffle by size and splits skewed keys.
    """
    pairs = [(k, k) if isinstance(k, str) else k for k in on]
    renamed = right.select(*[F.col(f"`{c}`").alias(f"__r_{c}") for c in right.columns])
    keys_l: list[Column] = []
    condition = F.lit(True)
    for i, (lk, rk) in enumerate(pairs):
        root, _, path = rk.partition(".")
        r_key = F.col(f"`__r_{root}`" + (f".{path}" if path else ""))
        l_key = F.col(lk)
        if left.select(lk).schema[0].dataType != right.select(rk).schema[0].dataType:
            numeric = {"int", "bigint", "smallint", "double", "float"}
            kinds = {left.select(lk).dtypes[0][1], right.select(rk).dtypes[0][1]}
            if not kinds <= numeric:
                l_key, r_key = l_key.cast("string"), r_key.cast("string")
        condition = (l_key == r_key) if i == 0 else condition & (l_key == r_key)
        keys_l.append(r_key)
    joined = left.join(renamed, condition, how)
    shared = {lk: rk for lk, rk in pairs}
    out = []
    for c in left.columns:
        q = F.col(f"`{c}`")
        if how in ("right", "full") and c in shared and "." not in shared[c]:
            q = F.coalesce(q, F.col(f"`__r_{shared[c]}`").cast(left.schema[c].dataType))
        out.append(q.alias(c))
    gone = {rk for _, rk in pairs}
    for c in right.columns:
        if c not in gone:
            out.append(F.col(f"`__r_{c}`").alias(f"{c}_r" if c in left.columns else c))
    return joined.select(*out)


def asof(left: DataFrame, right: DataFrame, on: list[str | tuple[str, str]], by: str, within: str | None = None, right_order: list[str] | None = None, hot: int = HOT_ROWS) -> DataFrame:
    """Each left row with the nearest right row of its key at or before its time.

    Left-outer. Among right rows at the same time the last by ``right_order`` counts; a match
    older than ``within`` is dropped, one exactly as old is kept. Right time and keys are not
    returned, other clashing names get ``_r``. Null keys and null times match nothing.

    Both sides are put in one stream by key and time, so rows are shuffled and sorted once and
    never multiplied. Without keys, or if a key has more than ``hot`` rows, the stream is cut into
    ranges of (key, time) instead, and each range is handed the last right row before it.
    """
    pairs = [(k, k) if isinstance(k, str) else k for k in on]
    gone = {by, *[rk for _, rk in pairs]}
    carried = [c for c in right.columns if c not in gone]
    l_keys = [F.col(lk).cast("string").alias(f"__k{i}") for i, (lk, _) in enumerate(pairs)]
    r_keys = [F.col(rk).cast("string").alias(f"__k{i}") for i, (_, rk) in enumerate(pairs)]
    tie = F.struct(*[F.col(c) for c in right_order]) if right_order else F.struct(F.lit(0))
    payload = F.struct(*[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(carried)], F.col(by).alias("at"))
    l_rows = left.select(*l_keys, F.col(by).alias("__ts"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"))
    r_rows = right.filter(F.col(by).isNotNull()).select(*r_keys, F.col(by).alias("__ts"), F.lit(0).alias("__side"), tie.alias("__tie"), payload.alias("__r"))
    for i in range(len(pairs)):
        r_rows = r_rows.filter(F.col(f"__k{i}").isNotNull())
    both = l_rows.unionByName(r_rows, allowMissingColumns=True)
    keys = [f"__k{i}" for i in range(len(pairs))]
    in_time = ["__ts", "__side", "__tie"]
    if keys and both.groupBy(*keys).count().filter(F.col("count") > hot).isEmpty():
        frame = W.partitionBy(*keys).orderBy(*in_time).rowsBetween(W.unboundedPreceding, 0)
        matched = both.withColumn("__m", F.last("__r", ignorenulls=True).over(frame)).filter("__side = 1")
    else:
        whole = F.struct(*keys, *in_time)
        rows = handed_on(ranged(both, [*keys, *in_time]), F.max_by(F.struct(*keys, "__r"), F.when(F.col("__side") == 0, whole)))
        frame = W.partitionBy("__range", *keys).orderBy(*in_time).rowsBetween(W.unboundedPreceding, 0)
        own = reduce(lambda x, y: x & y, [F.col(f"__carry.{k}") == F.col(k) for k in keys], F.lit(True))
        near = F.coalesce(F.last("__r", ignorenulls=True).over(frame), F.when(own, F.col("__carry.__r")))
        matched = rows.withColumn("__m", near).filter("__side = 1")
    usable = F.col("__ts").isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    if within is not None:
        limit = span_us(within)
        if limit is None:
            raise ValueError(f"no span: {within}")
        usable = usable & (micros(F.col("__ts")) - micros(F.col("__m.at")) <= limit)
    names = [c if c not in left.columns else f"{c}_r" for c in carried]
    return matched.select("__l.*", *[F.when(usable, F.col(f"__m.v{i}")).alias(n) for i, n in enumerate(names)])
