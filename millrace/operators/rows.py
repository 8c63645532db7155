"""Rows: filter, contracts, missing values, order, distinct, union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.events import ContractHalted, Ledger, Severity
from millrace.functions import scalar as s
from millrace.operators.ranges import columns_of, handed_on, percentiles, ranged


def where(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows for which all conditions hold; a null doesn't. Conditions stay bare, so that the reader gets them."""
    return df.filter(reduce(lambda x, y: x & y, conditions))


def validate(df: DataFrame, condition: Column, disposition: str, rule: str = "contract", ledger: Ledger | None = None, scope: str = "") -> DataFrame:
    """``warn`` keeps and counts failing rows, ``reject`` drops and counts them, ``halt`` stops the action.

    Counts come with the data's own pass; ``halt`` raises in the task that meets the first failure.
    """
    holds = s.false_if_null(condition)
    severity = {"warn": Severity.WARNING, "reject": Severity.ERROR, "halt": Severity.FATAL}[disposition]
    if ledger is not None and disposition != "halt":
        df = ledger.watch(df, scope, {rule: (severity, f"{{n}} row(s) failed {rule} ({disposition})", ~holds)})
    if disposition == "reject":
        return df.filter(holds)
    if disposition == "halt":
        return df.filter(F.when(holds, True).otherwise(F.raise_error(F.lit(f"{ContractHalted.__name__}: {rule}")).cast("boolean")))
    return df


def dropna(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without a null in the named (or any) columns; a NaN is no null."""
    named = [c for c in columns if c in df.columns] if columns else df.columns
    if not named:
        return df
    return df.filter(reduce(lambda x, y: x & y, [F.col(f"`{c}`").isNotNull() for c in named]))


def fill(df: DataFrame, column: str, value: object) -> DataFrame:
    """A constant for nulls, in the column's own type."""
    kind = df.schema[column].dataType
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value).try_cast(kind)))


def _filled(df: DataFrame, column: str, order_by: list, by: list[str], forward: bool) -> DataFrame:
    c = F.col(column)
    known = F.when(c != "", c) if isinstance(df.schema[column].dataType, T.StringType) else c
    near = _nearest(W.partitionBy(*by).orderBy(*order_by), forward)
    return df.withColumn("__known", known).withColumn(column, F.coalesce(near, c)).drop("__known")


def _nearest(order: WindowSpec, forward: bool) -> Column:
    """``__known`` of the row itself, or else of the nearest row before (after) that has one.

    Both read a partition once. A frame to ``unboundedFollowing`` would be gone through anew for each
    of its rows, so the next value is found by ``lead``.
    """
    if forward:
        return F.last("__known", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return F.coalesce(F.col("__known"), F.expr("lead(__known, 1) IGNORE NULLS").over(order))


def ffill(df: DataFrame, column: str, order_by: list, by: list[str] | None = None) -> DataFrame:
    """The last value before, for null and empty cells.

    Without ``by`` there is one order over all rows: see ``ordered_fill`` for large inputs.
    """
    return _filled(df, column, order_by, by or [], True) if by else ordered_fill(df, column, order_by, True)


def bfill(df: DataFrame, column: str, order_by: list, by: list[str] | None = None) -> DataFrame:
    """The next value after, for null and empty cells."""
    return _filled(df, column, order_by, by or [], False) if by else ordered_fill(df, column, order_by, False)


def ordered_fill(df: DataFrame, column: str, order_by: list, forward: bool) -> DataFrame:
    """Fill over one global order without a window that holds all rows in one task.

    Each range of the order is filled by itself, and a cell before the range's first value gets
    the last value of the ranges before it (see ``ranges``).
    """
    c = F.col(column)
    known = F.when(c != "", c) if isinstance(df.schema[column].dataType, T.StringType) else c
    place = F.when(known.isNotNull(), F.struct(*columns_of(order_by)))
    near, edge = _nearest(W.partitionBy("__range").orderBy(*order_by), forward), (F.max_by if forward else F.min_by)(known, place)
    joined = handed_on(ranged(df, order_by), edge, forward).withColumn("__known", known).withColumn("__near", near)
    return joined.withColumn(column, F.coalesce("__near", "__carry", c)).select(*df.columns)


def fill_statistic(df: DataFrame, column: str, statistic: str) -> DataFrame:
    """The column's ``mean`` or exact ``median`` for nulls (for blanks of a text column, as text).

    A whole-number column becomes double.
    """
    c = F.col(column)
    is_text = isinstance(df.schema[column].dataType, T.StringType)
    number = s.to_float(c) if is_text else c.cast("double")
    value = (df.agg(F.avg(number).alias("v")) if statistic == "mean" else percentiles(df, [], number, {"v": 0.5})).scalar()
    if not is_text:
        return df.withColumn(column, F.coalesce(number, value))
    shown = F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
    return df.withColumn(column, F.when(c.isNull() | (F.trim(c) == ""), shown).otherwise(c))


def sort(df: DataFrame, *keys: tuple[str, str] | str, order_by: list | None = None) -> DataFrame:
    """Stable: ``order_by`` breaks ties. Nulls last ascending, first descending."""
    pairs = [(k, "asc") if isinstance(k, str) else k for k in keys]
    return df.orderBy(*[F.col(k).desc_nulls_first() if d == "desc" else F.col(k).asc_nulls_last() for k, d in pairs], *(order_by or []))


def take(df: DataFrame, n: int, order_by: list | None = None) -> DataFrame:
    """The first rows by ``order_by``: Spark keeps the top of each task only."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def distinct(df: DataFrame, *columns: str, order_by: list | None = None) -> DataFrame:
    """The first row of each key by ``order_by``, all columns kept; nulls are one key.

    Rows are reduced before the shuffle: an aggregate keeps each task's first row of a key.
    """
    if not columns:
        return df.distinct()
    if order_by is None:
        return df.dropDuplicates(list(columns))
    whole = F.struct(*df.columns)
    keys = [k if isinstance(k, Column) else F.col(k) for k in order_by]
    first = df.groupBy(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(columns)]).agg(F.min_by(whole, F.struct(*keys)).alias("__row"))
    return first.select("__row.*")


def union(*frames: DataFrame) -> DataFrame:
    """All rows, columns by name; a column that one side lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
