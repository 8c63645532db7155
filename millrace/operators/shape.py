"""Columns: select, compute, rename, drop, reorder, cast, explode, describe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import scalar as s
from millrace.functions import temporal as t


def project(df: DataFrame, *items: str | Column) -> DataFrame:
    return df.select(*items)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """In place; unknown names are passed over."""
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def drop(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def reorder(df: DataFrame, *front: str) -> DataFrame:
    """The named columns first, the rest in their order."""
    lead = [c for c in dict.fromkeys(front) if c in df.columns]
    return df.select(*lead, *[c for c in df.columns if c not in lead])


def cast_column(c: Column, kind: T.DataType, to: str) -> Column:
    """A value of type ``kind`` in lane ``to``: int, float, str, bool, decimal(N), datetime, date, time, duration, resource."""
    is_text = isinstance(kind, T.StringType)
    is_ts = isinstance(kind, (T.TimestampNTZType, T.TimestampType))
    if to == "int":
        return s.to_int(c, kind)
    if to == "float":
        return c.cast("double") if isinstance(kind, (*s.NUMERIC, T.BooleanType)) else s.to_float(c)
    if to.startswith("decimal"):
        return s.to_decimal(c, int(to[8:-1]))
    if to == "bool":
        return s.to_bool(c, kind)
    if to == "datetime":
        if is_ts:
            return c.cast("timestamp_ntz")
        if isinstance(kind, T.DateType):
            return c.cast("timestamp_ntz")
        return t.to_instant(c.cast("string")) if is_text else t.from_micros(c.cast("bigint") * 1_000_000)
    if to == "date":
        return t.to_date(c) if is_text else t.date_of(c) if is_ts else c.cast("date") if isinstance(kind, T.DateType) else F.date_from_unix_date(c.cast("int"))
    if to == "time":
        return t.to_time(c) if is_text else t.time_of(c)
    if to == "duration":
        return t.parse_span(c) if is_text else c if isinstance(kind, T.DayTimeIntervalType) else t.interval(c.cast("bigint") * 1_000_000)
    if to in ("str", "resource"):
        return t.format_span(c) if isinstance(kind, T.DayTimeIntervalType) else c.cast("string")
    raise ValueError(f"unknown type {to}")


def cast(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """In place; what can't be read becomes null; unknown columns are passed over."""
    return df.withColumns({c: cast_column(F.col(f"`{c}`"), df.schema[c].dataType, to) for c, to in types.items() if c in df.columns})


def explode(df: DataFrame, column: str) -> DataFrame:
    """A row for each element, in place; none for a null or empty list. Other columns pass unchanged."""
    if not isinstance(df.schema[column].dataType, T.ArrayType):
        return df
    return df.select(*[F.explode(c).alias(c) if c == column else c for c in df.columns])


def describe(df: DataFrame) -> DataFrame:
    """A row for each column: column, type, count of rows, and min, max, mean of numbers; nulls are skipped.

    One aggregation over the data; only its single row is turned into rows.
    """
    names = {"bigint": "i64", "int": "i64", "smallint": "i64", "tinyint": "i64", "double": "f64", "float": "f64", "string": "str", "boolean": "bool", "timestamp_ntz": "datetime", "timestamp": "datetime"}
    numeric = [f.name for f in df.schema if isinstance(f.dataType, s.NUMERIC)]
    aggregates = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(df.columns):
        if c in numeric:
            q = F.col(f"`{c}`")
            aggregates += [F.min(q).cast("string").alias(f"min{i}"), F.max(q).cast("string").alias(f"max{i}"), F.avg(q.cast("double")).cast("string").alias(f"mean{i}")]
    none = F.lit(None).cast("string")
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.lit(names.get(kind, "decimal" if kind.startswith("decimal") else kind)).alias("type"), F.col("n").cast("bigint").alias("count"),
            *[(F.col(f"{what}{i}") if c in numeric else none).alias(what) for what in ("min", "max", "mean")],
        )
        for i, (c, kind) in enumerate(df.dtypes)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))
