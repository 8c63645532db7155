"""Grouping with the aggregates of the flow language."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.temporal import bucket, hops, span_us
from millrace.operators.ranges import percentiles, small

FUNCTIONS = ("count", "sum", "avg", "min", "max", "std", "first", "last", "median", "count_distinct", "nunique", "array_agg", "list_agg", "arr")


def _ordered(order_by: list | None) -> Column:
    if not order_by:
        raise ValueError("first, last and array_agg need an order")
    return F.struct(*[k if isinstance(k, Column) else F.col(k) for k in order_by])


def percentile_rank(func: str) -> float | None:
    """0.5 for median, N / 100 for pN."""
    m = re.fullmatch(r"p(\d{1,3})", func)
    return 0.5 if func == "median" else int(m[1]) / 100 if m and int(m[1]) <= 100 else None


def aggregate(func: str, column: str, kind: T.DataType, order_by: list | None = None) -> Column:
    """One aggregate of non-null values.

    Sums of whole numbers and decimals are exact, ``avg`` of a decimal has six more digits
    rounded half to even, ``std`` is the sample deviation (null below two values),
    percentiles interpolate and are exact, ``first``, ``last`` and ``array_agg`` go by ``order_by``.
    """
    c = F.col(column)
    if func == "count":
        return F.count(c)
    if func in ("count_distinct", "nunique"):
        return F.count_distinct(c)
    if func == "sum":
        return F.sum(c)
    if func == "avg":
        if isinstance(kind, T.DecimalType):
            # These precisions leave the quotient enough digits.
            total, n = F.sum(c).try_cast(f"decimal(28,{kind.scale})"), F.count(c).cast("decimal(10,0)")
            return F.bround(F.try_divide(total, n), kind.scale + 6)
        return F.avg(c)
    if func in ("min", "max"):
        return getattr(F, func)(c)
    if func == "std":
        return F.stddev_samp(c)
    if func == "first":
        return F.min_by(c, F.when(c.isNotNull(), _ordered(order_by)))
    if func == "last":
        return F.max_by(c, F.when(c.isNotNull(), _ordered(order_by)))
    if func in ("array_agg", "list_agg", "arr"):
        pairs = F.collect_list(F.when(c.isNotNull(), F.struct(_ordered(order_by).alias("o"), c.alias("v"))))
        return F.transform(F.array_sort(pairs), lambda p: p["v"])
    if (rank := percentile_rank(func)) is not None:
        return F.percentile(c.cast("double"), rank)
    raise ValueError(f"unknown aggregate {func}")


def group(df: DataFrame, keys: list[str], aggregates: list[tuple[str, str]] = (), order_by: list | None = None) -> DataFrame:
    """Keys, ``count`` of rows, then ``<func>_<column>`` for each aggregate.

    Null keys are one group. Keys may be paths into structs. Partial aggregation runs before
    the shuffle; only lists carry a group's values. Percentiles are picked by their ranks (see
    ``ranges.percentiles``), so a group may have any number of values.
    """
    if not keys:
        raise ValueError("a group needs a key")
    names = {k: k.split(".")[-1] for k in keys}
    types = {c: df.select(c).schema[0].dataType for _, c in aggregates}
    title = lambda f, c: f"{f}_{c.replace('.', '_')}"
    ranks: dict[str, dict[str, float]] = {}
    for f, c in aggregates:
        if (rank := percentile_rank(f)) is not None and not df.isStreaming:
            ranks.setdefault(c, {})[title(f, c)] = rank
    picked = {name for wanted in ranks.values() for name in wanted}
    found = [aggregate(f, c, types[c], order_by).alias(title(f, c)) for f, c in aggregates if title(f, c) not in picked]
    keyed = df.select(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"__c{i}") for i, c in enumerate(ranks)])
    rows = df.groupBy(*[F.col(k).alias(names[k]) for k in keys])
    if ranks and small(keyed):
        # All percentiles of a column from one map, in the same pass as the other aggregates.
        at_once = [F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, wanted.values()))).alias(f"__p{i}") for i, (c, wanted) in enumerate(ranks.items())]
        out = rows.agg(F.count(F.lit(1)).alias("count"), *found, *at_once)
        return out.select(*names.values(), "count", *[F.get(f"__p{list(ranks).index(c)}", F.lit(list(ranks[c]).index(title(f, c)))).alias(title(f, c)) if title(f, c) in picked else F.col(f"`{title(f, c)}`") for f, c in aggregates])
    out = rows.agg(F.count(F.lit(1)).alias("count"), *found)
    for i, wanted in enumerate(ranks.values()):
        own = percentiles(keyed, [f"__g{k}" for k in range(len(keys))], F.col(f"__c{i}"), wanted)
        same = reduce(lambda x, y: x & y, [F.col(f"`{names[k]}`").eqNullSafe(F.col(f"__g{n}")) for n, k in enumerate(keys)])
        out = out.join(own, same, "left").drop(*[f"__g{k}" for k in range(len(keys))])
    return out.select(*names.values(), "count", *[F.col(f"`{title(f, c)}`") for f, c in aggregates])


def hop_group(df: DataFrame, ts: str, size: str, hop: str, keys: list[str], aggregates: list[tuple[str, str]] = (), name: str = "w") -> DataFrame:
    """Groups by windows of ``size`` that start every ``hop``: ``name``, the keys, ``count``, the aggregates.

    Rows are reduced to panes of one hop first (count, sum, min, max), and only panes are copied
    into the windows that hold them; so the shuffle doesn't grow with ``size / hop``. Other
    aggregates, and sizes that aren't a multiple of the hop, copy the rows.
    """
    t = F.col(ts)
    simple = {"count", "sum", "avg", "min", "max"}
    if span_us(size) % span_us(hop) or any(f not in simple or (f == "avg" and isinstance(df.schema[c].dataType, T.DecimalType)) for f, c in aggregates):
        return group(df.withColumn(name, F.explode(hops(t, size, hop))), [name, *keys], aggregates)
    used = sorted({c for _, c in aggregates})
    parts = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(used):
        kinds = {f for f, own in aggregates if own == c}
        parts += [F.count(F.col(c)).alias(f"__n{i}")]
        parts += [F.sum(F.col(c)).alias(f"__s{i}")] if kinds & {"sum", "avg"} else []
        parts += [getattr(F, f)(F.col(c)).alias(f"__{f}{i}") for f in ("min", "max") if f in kinds]
    panes = df.groupBy(bucket(t, hop).alias("__pane"), *keys).agg(*parts)
    spread = panes.withColumn(name, F.explode(hops(F.col("__pane"), size, hop)))
    out = [F.sum("__n").alias("count")]
    for f, c in aggregates:
        i = used.index(c)
        if f == "count":
            value = F.sum(f"__n{i}")
        elif f == "avg":
            value = F.try_divide(F.sum(f"__s{i}").cast("double"), F.sum(f"__n{i}"))
        else:
            value = F.sum(f"__s{i}") if f == "sum" else getattr(F, f)(f"__{f}{i}")
        out.append(value.alias(f"{f}_{c}"))
    return spread.groupBy(name, *keys).agg(*out)
