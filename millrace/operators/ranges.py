"""One order over all rows without a task that holds them all.

Rows are dealt into ranges of the order and written to the shared folder, so that ranges stay as
they are whatever is read again. Each range is worked on by itself; what one hands to the next is
a table of one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.scratch import materialize

#: Rows that a window over positions handles at once, unless it looks further back than that.
BLOCK = 100_000
#: Bytes, by Spark's own estimate, up to which a group's distinct values may be one task's map.
SMALL_BYTES = 16 << 20


def small(df: DataFrame) -> bool:
    """Whether all of ``df`` would fit one task, as Spark estimates its files; what it can't estimate isn't small."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES
    except AttributeError:  # a session that has no plan at hand
        return False


def columns_of(order_by: list) -> list[Column]:
    return [k if isinstance(k, Column) else F.col(k) for k in order_by]


def ranged(df: DataFrame, order_by: list) -> DataFrame:
    """``df`` with ``__range``, its rows' place among the ranges of the order."""
    return materialize(df.repartitionByRange(*columns_of(order_by)).withColumn("__range", F.spark_partition_id()), "ranges")


def handed_on(df: DataFrame, edge: Column, forward: bool = True) -> DataFrame:
    """``df`` with ``__carry``: the aggregate ``edge`` of the nearest range before (after) that has one."""
    edges = df.groupBy("__range").agg(edge.alias("__edge"))
    order = W.orderBy("__range" if forward else F.desc("__range"))
    carry = F.last("__edge", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    edges = edges.select(F.col("__range").alias("__of"), carry.alias("__carry"))
    return df.join(edges, F.col("__range") == F.col("__of")).drop("__of")  # as many rows as ranges: Spark broadcasts it


def numbered(df: DataFrame, order_by: list) -> DataFrame:
    """``df`` with ``__pos``, each row's place in the order from 0."""
    rows = ranged(df, order_by)
    within = F.row_number().over(W.partitionBy("__range").orderBy(*order_by)).cast("bigint")
    counts = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    counts = counts.select(F.col("__range").alias("__of"), before.alias("__before"))
    joined = rows.withColumn("__within", within).join(counts, F.col("__range") == F.col("__of"))
    return joined.withColumn("__pos", F.col("__before") + F.col("__within") - 1).drop("__within", "__before", "__of", "__range")


def in_blocks(df: DataFrame, order_by: list, reach: int, forward: bool = False) -> DataFrame:
    """``df`` with ``__pos`` and ``__at``, for windows that look at most ``reach`` rows back (or forward).

    Places are cut into blocks, ``__at.block``; the rows within reach of the next block (the one
    before) are in it a second time, marked ``__at.copy``, to be dropped after the window.
    """
    block = max(BLOCK, reach)
    rows = numbered(df, order_by)
    own, place = F.floor(F.col("__pos") / block), F.col("__pos") % block
    near, other = (place < reach, own - 1) if forward else (place >= block - reach, own + 1)
    at = lambda b, copy: F.struct(b.alias("block"), F.lit(copy).alias("copy"))
    return rows.withColumn("__at", F.explode(F.when(near, F.array(at(own, False), at(other, True))).otherwise(F.array(at(own, False)))))


def percentiles(df: DataFrame, keys: list[str], column: Column, ranks: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles of non-null values: the keys, and one column for each of ``ranks``.

    Values are counted first, (key, value) by (key, value). Their ranges' totals tell which ranges
    hold a wanted place; only those are put in order, each by itself. No task holds a group.
    Tables that are small as a whole are aggregated at once, with the same results.
    """
    slim = df.select(*[F.col(f"`{k}`") for k in keys], column.cast("double").alias("__v"))
    if small(slim):
        found = slim.groupBy(*[f"`{k}`" for k in keys]).agg(F.percentile("__v", F.array(*map(F.lit, ranks.values()))).alias("__p"))
        return found.select(*[F.col(f"`{k}`") for k in keys], *[F.get("__p", F.lit(i)).alias(name) for i, name in enumerate(ranks)])
    names = [f"__k{i}" for i in range(len(keys))]
    values = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], column.cast("double").alias("__v")).filter("__v is not null")
    rows = ranged(values.groupBy(*names, "__v").agg(F.count(F.lit(1)).alias("__n")), [*names, "__v"])
    group = W.partitionBy(*(names or [F.lit(0)]))
    sums = rows.groupBy(*names, "__range").agg(F.sum("__n").alias("__s"))
    before = F.coalesce(F.sum("__s").over(group.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    sums = sums.withColumns({"__before": before, "__total": F.sum("__s").over(group)})
    place = {name: (F.col("__total") - 1) * rank for name, rank in ranks.items()}
    wanted = F.lit(False)
    for p in place.values():
        for end in (F.floor(p), F.ceil(p)):
            wanted = wanted | ((F.col("__before") <= end) & (end < F.col("__before") + F.col("__s")))
    hits = sums.filter(wanted).select(*[F.col(n).alias(f"__h{n}") for n in names], F.col("__range").alias("__of"), "__before", "__total")
    same = F.col("__range") == F.col("__of")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"__h{n}"))
    upto = F.col("__before") + F.sum("__n").over(W.partitionBy(*names, "__range").orderBy("__v").rowsBetween(W.unboundedPreceding, 0))
    held = rows.join(hits, same).withColumn("__upto", upto)
    found = []
    for i, p in enumerate(place.values()):
        found += [F.min(F.when(F.col("__upto") > F.floor(p), F.col("__v"))).alias(f"__lo{i}"), F.min(F.when(F.col("__upto") > F.ceil(p), F.col("__v"))).alias(f"__hi{i}")]
    out = held.groupBy(*names).agg(*found, F.max("__total").alias("__total"))

    def between(i: int, p: Column) -> Column:
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *[between(i, p).alias(name) for i, (name, p) in enumerate(place.items())])
