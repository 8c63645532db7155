"""Writers: single files, JSON arrays, and output dealt into many files by its values."""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.temporal import format_span
from millrace.sources.files import format_of

NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
# Characters that are escaped in path segments.
UNSAFE = ("%", "/", "\\", ":", "*", "?", '"', "<", ">", "|", "=", "{", "}")


def shown(df: DataFrame) -> DataFrame:
    """Instants as ISO text, spans in their human form; other columns as they are."""
    out = []
    for f in df.schema:
        q = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DayTimeIntervalType):
            q = format_span(q)
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            q = F.regexp_replace(F.date_format(q, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0{1,6}$", "")
            q = F.when(F.length(q) < 19, F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(q)
        out.append(q.alias(f.name))
    return df.select(*out)


def _json_lines(df: DataFrame) -> DataFrame:
    """Each row as a JSON object; nulls are kept, and a NaN is null."""
    clean = [F.when(~F.isnan(f"`{f.name}`"), F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("value"))


def _write(df: DataFrame, fmt: str, path: str, by: list[str] | None = None) -> None:
    # A limit of rows a file, which a session may set, would split a task's file.
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", 0)
    if by:
        writer = writer.partitionBy(*by)
    if fmt in ("csv", "tsv"):
        writer.option("sep", "\t" if fmt == "tsv" else ",").option("header", "true").option("escape", '"').csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    elif by:
        writer.option("ignoreNullFields", "false").json(path)
    else:
        lines = _json_lines(df)
        (lines if fmt != "json" else lines.mapInArrow(_array_parts, "value string")).write.mode("overwrite").option("maxRecordsPerFile", 0).text(path)


def _array_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's JSON lines as one array."""
    lead = "["
    for batch in batches:
        if batch.num_rows:
            lines = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([lead + lines[0], *["," + x for x in lines[1:]]], pa.string())], ["value"])
            lead = ","
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if lead == "[" else "]"], pa.string())], ["value"])


def one_file(spark: SparkSession) -> bool:
    """Whether a sink is one file by default: on one machine; a cluster writes parts."""
    return spark.sparkContext.master.startswith("local")


def _fs(df: DataFrame, path: str):
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _move(fs, new_path: Callable, old: str, new: str) -> None:
    target = new_path(new)
    if target.getParent() is not None:
        fs.mkdirs(target.getParent())
    fs.delete(target, True)
    if not fs.rename(new_path(old), target):
        raise OSError(f"could not write {new}")


def save(df: DataFrame, path: str, fmt: str | None = None, order_by: list | None = None, single: bool | None = None) -> None:
    """Write ``df`` as csv, tsv, json (one array), jsonl or parquet.

    ``single`` gives one file, as a shell user expects; without it each task writes its own part
    (of json: its own array) below ``path``, as a cluster should. By default the session's master
    decides. ``-`` and ``stdout`` print. Rows are streamed by the tasks, never collected.
    """
    fmt = {"ndjson": "jsonl", "json": "json", "jsonl": "jsonl"}.get(fmt or "", fmt) or ("jsonl" if re.search(r"\.(jsonl|ndjson)$", path) else format_of(path))
    df = shown(df)
    ordered = df.orderBy(*order_by) if order_by else df
    if path in ("-", "stdout"):
        for line in _lines(ordered, fmt):
            sys.stdout.write(line + "\n")
        return
    if not (one_file(df.sparkSession) if single is None else single):
        _write(ordered, fmt, path)
        return
    stage = f"{path}.{uuid.uuid4().hex}"
    _write(ordered.coalesce(1), fmt, stage)
    fs, new_path = _fs(df, stage)
    parts = [s.getPath().toString() for s in fs.globStatus(new_path(f"{stage}/part-*"))]
    if len(parts) > 1:
        raise OSError(f"{path} was written in {len(parts)} parts, which are left in {stage}")
    if parts:
        _move(fs, new_path, parts[0], path)
    else:
        out = fs.create(new_path(path), True)
        out.write(bytearray({"csv": ",".join(df.columns) + "\n", "tsv": "\t".join(df.columns) + "\n", "json": "[]\n"}.get(fmt, "").encode()))
        out.close()
    fs.delete(new_path(stage), True)


def _lines(df: DataFrame, fmt: str):
    if fmt in ("json", "jsonl"):
        found = (r[0] for r in _json_lines(df).toLocalIterator())
        if fmt == "jsonl":
            yield from found
            return
        yield "["
        first = True
        for line in found:
            yield ("" if first else ",") + line
            first = False
        yield "]"
        return
    sep = "\t" if fmt == "tsv" else ","

    def cell(c: Column) -> Column:
        text = c.cast("string")
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.isNull(), "").when((text == "") | text.rlike(f'[{sep}"\r\n]'), quoted).otherwise(text)

    yield sep.join(df.columns)
    for r in df.select(F.concat_ws(sep, *[cell(F.col(f"`{c}`")) for c in df.columns])).toLocalIterator():
        yield r[0]


def escaped(c: Column) -> Column:
    """A value as a path segment: unsafe characters percent-escaped, null as the null partition."""
    text = c.cast("string")
    for ch in UNSAFE:
        text = F.replace(text, F.lit(ch), F.lit(f"%{ord(ch):02X}"))
    text = F.when(text.isin(".", ".."), F.replace(text, F.lit("."), F.lit("%2E"))).otherwise(text)
    return F.coalesce(text, F.lit(NULL_PARTITION))


def _glob_safe(path: str) -> str:
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _numbered(relative: str, n: int) -> str:
    """The name of a file's part: ``=`` is escaped in values, so no value gives such a name."""
    stem, dot, ending = relative.rpartition(".")
    return relative if n == 0 else f"{stem}={n:05d}.{ending}" if dot and "/" not in ending else f"{relative}={n:05d}"


def route(df: DataFrame, target: Column, folder: str, fmt: str) -> list[str]:
    """Write each row to the file that ``target`` names below ``folder``; returns the files' names.

    Rows go through Spark's partitioned writer into a staging folder (bounded memory, one open
    file at a time for each task after a sort), then finished files are moved. Rows are dealt by
    target, and Spark splits a target that has too many rows for one task: its further parts are
    ``name=00001.ext`` and so on, beside ``name.ext``. Files of an earlier run are replaced.
    """
    df = shown(df).withColumn("__path", target)
    stage = f"{folder.rstrip('/')}/.staging-{uuid.uuid4().hex}"
    _write(df.hint("rebalance", "__path"), fmt, stage, ["__path"])
    fs, new_path = _fs(df, stage)
    unescape = df.sparkSession._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    written = []
    for status in fs.listStatus(new_path(stage)):
        name = status.getPath().getName()
        if not name.startswith("__path="):
            continue
        relative = unescape(name.removeprefix("__path="))
        old = _numbered(f"{folder.rstrip('/')}/{relative}", 1)
        for earlier in fs.globStatus(new_path("=[0-9][0-9][0-9][0-9][0-9]".join(map(_glob_safe, old.rsplit("=00001", 1))))) or []:
            fs.delete(earlier.getPath(), True)
        for n, part in enumerate(fs.globStatus(new_path(f"{_glob_safe(status.getPath().toString())}/part-*"))):
            written.append(_numbered(relative, n))
            _move(fs, new_path, part.getPath().toString(), f"{folder.rstrip('/')}/{written[-1]}")
    fs.delete(new_path(stage), True)
    return sorted(written)


def save_by(df: DataFrame, folder: str, keys: dict[str, Column], fmt: str = "csv", layout: str = "hive") -> list[str]:
    """Files by key: ``k=v/part.ext`` (hive) or ``v1_v2.ext`` (flat); key columns stay in the files."""
    segments = [escaped(c) for c in keys.values()]
    if layout == "flat":
        target = F.concat(F.concat_ws("_", *segments), F.lit(f".{fmt}"))
    else:
        target = F.concat(F.concat_ws("/", *[F.concat(F.lit(f"{k}="), seg) for k, seg in zip(keys, segments)]), F.lit(f"/part.{fmt}"))
    return route(df, target, folder, fmt)


def save_template(df: DataFrame, template: str, value: Callable[[str], Column], fmt: str | None = None) -> list[str]:
    """Files by a template: ``{…}`` is an expression that ``value`` compiles, ``{{`` and ``}}`` are braces."""
    pieces = re.findall(r"\{\{|\}\}|\{[^{}]*\}|[^{}]+", template)
    fixed = ""
    while pieces and not (pieces[0].startswith("{") and pieces[0] != "{{"):
        fixed += pieces.pop(0)
    folder, _, head = fixed.rpartition("/")
    parts = [F.lit(head)] if head else []
    for p in pieces:
        parts.append(F.lit(p[0]) if p in ("{{", "}}") else escaped(value(p[1:-1])) if p.startswith("{") else F.lit(p))
    return route(df, F.concat(*parts), folder or ".", fmt or format_of(template))
