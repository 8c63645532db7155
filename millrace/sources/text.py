"""CSV, TSV and JSON readers with the flow language's inference and null rules."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.events import Ledger, Severity
from millrace.functions import scalar as s
from millrace.functions import temporal as t
from millrace.operators.shape import cast_column

BAD = "__bad"
#: A character that no cell holds, so that an empty cell is null and a quoted one is "".
NO_NULL = "\u0002"
#: Lanes in the order in which inference tries them.
LANES = ("int", "float", "bool", "date", "time", "datetime")


def _well_formed(raw: DataFrame) -> DataFrame:
    """Rows that could be parsed. The second condition never holds; it only has a count read a real column, which Spark asks for."""
    marker = F.col(f"`{raw.columns[0]}`").cast("string") == F.lit(NO_NULL * 2) if raw.columns[0] != BAD else F.lit(False)
    return raw.filter(F.col(BAD).isNull() | marker).drop(BAD)


def first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).limit(1).first()
    return (row[0] if row else "").removeprefix("﻿")


def _cells(line: str, sep: str) -> list[str]:
    import csv

    return next(csv.reader([line.rstrip("\r")], delimiter=sep), [])


def _parsed(lane: str, c):
    """The cell in a lane, null where it doesn't fit."""
    if lane == "int":
        return c.try_cast("bigint")
    if lane == "float":
        return F.when(~F.lower(c).isin("nan", "inf", "-inf", "infinity", "-infinity"), c).try_cast("double")
    if lane == "bool":
        return F.when(c == "true", True).when(c == "false", False)
    if lane == "date":
        return t.to_date(c)
    if lane == "time":
        return t.to_time(c)
    return t.to_instant(c)


def infer(raw: DataFrame, columns: list[str]) -> dict[str, str]:
    """The first lane that fits all non-empty cells of a column, in one pass over all rows; else str."""
    if not columns:
        return {}
    found = []
    for i, c in enumerate(columns):
        cell = F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`"))
        found.append(F.count(cell).alias(f"n{i}"))
        found += [F.count(_parsed(lane, cell)).alias(f"{lane}{i}") for lane in LANES]
    row = raw.agg(*found).first()
    return {c: next((lane for lane in LANES if row[f"n{i}"] and row[f"{lane}{i}"] == row[f"n{i}"]), "str") for i, c in enumerate(columns)}


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    header: bool = True,
    schema: list[tuple[str, str | None]] | None = None,
    sep: str = ",",
    ledger: Ledger | None = None,
    scope: str = "",
    names: list[str] | None = None,
) -> DataFrame:
    """Rows of a CSV or TSV file (compressed too), typed.

    ``schema`` names the columns by place and may fix their types (``datetime(fmt)`` included);
    other columns are inferred over all rows. An empty cell is null, a quoted one is "". Rows
    with too many or too few cells are dropped and counted, cells that don't fit a type become
    null and are counted. ``names`` are column names that are known already.
    """
    if names is None:
        first = _cells(first_line(spark, path if isinstance(path, str) else path[0]), sep)
        names = first if header else [f"c{i}" for i in range(len(first))]
        if schema:
            if header and ledger is not None and _looks_like_data(first, schema):
                ledger.add(Severity.WARNING, scope, f"the first line of {path} looks like data; add noheader to keep it")
            names = [n for n, _ in schema] + names[len(schema) :]
    raw_type = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(BAD, T.StringType())])
    raw = spark.read.option("columnPruning", "false").csv(path, schema=raw_type, header=header, sep=sep, nullValue=NO_NULL, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=BAD, enforceSchema=True)
    if ledger is not None:
        raw = ledger.watch(raw, scope, {"arity": (Severity.ERROR, "{n} row(s) with a wrong number of cells were skipped", F.col(BAD).isNotNull())})
    raw = _well_formed(raw)
    declared = {n: kind for n, kind in schema or [] if kind}
    lanes = infer(raw, [n for n in names if n not in declared]) | declared
    return typed(raw, {n: lanes[n] for n in names}, ledger, scope)


def _looks_like_data(cells: list[str], schema: list[tuple[str, str | None]]) -> bool:
    for cell, (_, kind) in zip(cells, schema):
        if kind in ("int", "float") or (kind or "").startswith("decimal"):
            try:
                float(cell)
                return True
            except ValueError:
                continue
    return False


def typed(raw: DataFrame, lanes: dict[str, str], ledger: Ledger | None = None, scope: str = "") -> DataFrame:
    """Text columns in their lanes; what doesn't fit becomes null and is counted."""
    out, lost = [], {}
    for c in raw.columns:
        q, lane = F.col(f"`{c}`"), lanes.get(c, "str")
        if lane in ("str", "resource"):
            out.append(q)
            continue
        cell = F.when(F.trim(q) != "", q)
        if lane.startswith("datetime("):
            value = t.parse_instant(cell, lane[9:-1])
        elif lane == "bool":
            value = s.to_bool(cell)
        elif lane == "float":
            value = s.to_float(cell)
        else:
            value = cast_column(cell, T.StringType(), lane)
        out.append(value.alias(c))
        lost[c] = (Severity.WARNING, f"{{n}} cell(s) of column '{c}' don't fit {lane} and became null", cell.isNotNull() & value.isNull())
    if ledger is not None and lost:
        raw = ledger.watch(raw, scope, lost)
    return raw.select(*out)


def read_json(spark: SparkSession, path: str | list[str], ledger: Ledger | None = None, scope: str = "") -> DataFrame:
    """JSON lines, or a file that is one array; columns are those of the first object, in its order.

    Other objects' further keys are ignored, missing ones are null, a column of mixed kinds is
    its JSON text. Lines that aren't objects are dropped and counted.
    """
    first = first_line(spark, path if isinstance(path, str) else path[0]).lstrip()
    array = first.startswith("[")
    inferred = spark.read.json(path, multiLine=array, columnNameOfCorruptRecord=BAD).schema
    by_name = {f.name: f for f in inferred}
    keys = [f.name for f in inferred if f.name != BAD]
    try:
        sample = json.loads(first) if not array else None
        keys = [k for k in sample if k in by_name] if isinstance(sample, dict) else keys
    except ValueError:
        pass
    if array:
        ordered = spark.read.text(path, wholetext=True).limit(1).select(F.json_object_keys(F.get_json_object("value", "$[0]"))).first()
        if ordered and ordered[0]:
            keys = [k for k in ordered[0] if k in by_name]
    left_out = [n for n in by_name if n != BAD and n not in keys]
    if left_out and ledger is not None:
        ledger.add(Severity.WARNING, scope, f"column(s) {', '.join(left_out)} are not in the first object and were left out", len(left_out))
    if not keys:
        if ledger is not None:
            ledger.add(Severity.ERROR, scope, f"{path} holds no JSON object")
        return spark.range(0).drop("id")
    schema = T.StructType([by_name[k] for k in keys] + [T.StructField(BAD, T.StringType())])
    raw = spark.read.json(path, schema=schema, multiLine=array, columnNameOfCorruptRecord=BAD)
    if ledger is not None:
        raw = ledger.watch(raw, scope, {"json": (Severity.ERROR, "{n} line(s) that are no JSON object were skipped", F.col(BAD).isNotNull())})
    return _well_formed(raw)


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Flat columns in their lanes; nested columns are refused."""
    path = paths[0]
    df = spark.read.parquet(*paths)
    out = []
    for f in df.schema:
        q = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            raise ValueError(f"column {f.name} of {path} is nested")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            q = q.cast("bigint")
        elif isinstance(f.dataType, T.FloatType):
            q = q.cast("double")
        elif isinstance(f.dataType, T.TimestampType):
            q = q.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.BinaryType):
            q = q.cast("string")
        out.append(q.alias(f.name))
    return df.select(*out)
