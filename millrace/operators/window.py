"""Row windows: lag, lead, differences, rolling aggregates and sessions.

Each adds one column. ``by`` are the partitions, ``order_by`` the order within them. Nulls
and empty texts in ``by`` are one partition. Without ``by`` there is one order over all rows,
which is cut into blocks that overlap as far as the window looks (see ``ranges``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.temporal import interval, interval_us, micros, span_us
from millrace.operators.ranges import columns_of, handed_on, in_blocks, ranged


def _spec(df: DataFrame, by: list[str], order_by: list) -> WindowSpec:
    parts = [F.coalesce(F.col(c), F.lit("")) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c) for c in by]
    return W.partitionBy(*parts).orderBy(*order_by)


def shifted(df: DataFrame, kind: str, column: str, n: int, by: list[str], order_by: list) -> Column:
    """``lag``, ``lead``, ``diff`` (a span for instants) or ``pct_change``, as a column of ``df``."""
    c, spec = F.col(column), _spec(df, by, order_by)
    if kind == "lead":
        return F.lead(c, n).over(spec)
    before = F.lag(c, n).over(spec)
    if kind == "lag":
        return before
    if kind == "diff":
        return c - before
    return F.try_divide(c.cast("double") - before.cast("double"), before.cast("double"))


def rolling(df: DataFrame, kind: str, column: str, n: int, by: list[str], order_by: list) -> Column:
    """``rolling_sum``, ``_avg``, ``_min``, ``_max`` of the last ``n`` rows; null for the first ``n - 1``."""
    c, frame = F.col(column), _spec(df, by, order_by).rowsBetween(-(n - 1), 0)
    of = kind.removeprefix("rolling_")
    if of == "sum" and isinstance(df.schema[column].dataType, T.DayTimeIntervalType):
        value = interval(F.sum(interval_us(c)).over(frame))
    elif of == "sum" and isinstance(df.schema[column].dataType, (T.LongType, T.IntegerType)):
        value = F.try_sum(c).over(frame)
    else:
        value = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[of](c).over(frame)
    return F.when(F.count(F.lit(1)).over(frame) == n, value)


def with_session(df: DataFrame, name: str, ts: str, gap: str, by: list[str], order_by: list | None = None) -> DataFrame:
    """Adds ``name``: the start of the row's session.

    A session ends when the next row of the partition comes more than ``gap`` later. Null times
    get a null and split nothing.
    """
    limit = span_us(gap)
    if limit is None:
        raise ValueError(f"no span: {gap}")
    order = order_by or [ts]
    if not by and not df.isStreaming:
        return _sessions_of_all(df, name, ts, limit, order)
    spec = _spec(df, [*by], order)
    last_known = F.last(F.col(ts), ignorenulls=True).over(spec.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.col(ts).isNotNull() & (last_known.isNull() | (micros(F.col(ts)) - micros(last_known) > limit))
    marked = df.withColumn("__start", F.when(fresh, F.col(ts)))
    start = F.last("__start", ignorenulls=True).over(spec.rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn(name, F.when(F.col(ts).isNotNull(), start)).drop("__start")


def _sessions_of_all(df: DataFrame, name: str, ts: str, limit: int, order: list) -> DataFrame:
    """Sessions over one order: each range is handed the last time, then the last start, of those before it."""
    t, place = F.col(ts), F.struct(*columns_of(order))
    spec = W.partitionBy("__range").orderBy(*order)
    rows = handed_on(ranged(df, order), F.max_by(t, F.when(t.isNotNull(), place)))
    last_known = F.coalesce(F.last(t, ignorenulls=True).over(spec.rowsBetween(W.unboundedPreceding, -1)), F.col("__carry"))
    fresh = t.isNotNull() & (last_known.isNull() | (micros(t) - micros(last_known) > limit))
    marked = rows.withColumn("__start", F.when(fresh, t)).drop("__carry")
    rows = handed_on(marked, F.max_by("__start", F.when(F.col("__start").isNotNull(), place)))
    start = F.coalesce(F.last("__start", ignorenulls=True).over(spec.rowsBetween(W.unboundedPreceding, 0)), F.col("__carry"))
    return rows.withColumn("__session", F.when(t.isNotNull(), start)).drop("__start", "__carry", "__range").withColumn(name, F.col("__session")).drop("__session")


def with_window(df: DataFrame, name: str, kind: str, column: str, n: int = 1, by: list[str] = (), order_by: list = ()) -> DataFrame:
    """Adds ``name`` (``name_r`` if it is taken) with a shifted or rolling value."""
    make, out = rolling if kind.startswith("rolling_") else shifted, f"{name}_r" if name in df.columns else name
    if by or df.isStreaming:
        return df.withColumn(out, make(df, kind, column, n, list(by), list(order_by)))
    blocks = in_blocks(df, list(order_by), n - 1 if kind.startswith("rolling_") else n, kind == "lead").withColumn("__block", F.col("__at.block"))
    valued = blocks.withColumn("__value", make(blocks, kind, column, n, ["__block"], ["__pos"]))
    return valued.filter(~F.col("__at.copy")).drop("__at", "__block", "__pos").withColumnRenamed("__value", out)
