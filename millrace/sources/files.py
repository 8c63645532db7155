"""File discovery, reading of discovered files, and fixed-width binary records."""

from __future__ import annotations

import json
import os
import re
import urllib.parse
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.events import Ledger, Severity
from millrace.scratch import scratch_dir
from millrace.sources import text

# Binary field types and their numpy codes.
BINARY = {"i8": "i1", "i16": "i2", "i32": "i4", "i64": "i8", "u8": "u1", "u16": "u2", "u32": "u4", "u64": "u8", "f32": "f4", "f64": "f8", "bool": "u1"}


def path_pattern(glob: str) -> str:
    """A path's regular expression: ``*`` and ``?`` within a segment, ``**`` across segments."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def _root(glob: str) -> str:
    """The folder above the first segment with a wildcard."""
    fixed = re.match(r"[^*?\[]*", glob)[0]
    return fixed.rpartition("/")[0] or ("/" if fixed.startswith("/") else ".")


def plain(path):
    """A local file's URI as a path."""
    return F.regexp_replace(path, "^file:(//)?", "")


def ls(spark: SparkSession, glob: str, ledger: Ledger | None = None, scope: str = "") -> DataFrame:
    """A row for each file: path, name, size, mtime. Contents aren't read; the store lists the files."""
    if "://" not in glob and not glob.startswith("/"):
        glob = f"{os.getcwd()}/{glob}"
    root = _root(glob)
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        found = found.select(plain(F.col("path")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("mtime"))
    except Exception as e:  # noqa: BLE001  a folder that doesn't exist is an empty listing, reported
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = spark.createDataFrame([], "path string, size bigint, mtime timestamp_ntz")
        if ledger is not None:
            ledger.add(Severity.WARNING, scope, f"no file matches {glob}")
    found = found.filter(F.col("path").rlike(path_pattern(glob.removeprefix("file://"))))
    return found.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "size", "mtime")


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    return hadoop.Path(path).getFileSystem(conf), hadoop.Path, conf


def _shared(spark: SparkSession, name: str) -> str:
    """A new file's path in the folder that executors can read."""
    return f"{scratch_dir(spark)}/{uuid.uuid4().hex}/{name}"


def fetch(spark: SparkSession, url: str, seconds: float = 60.0) -> str:
    """A web file as one in the shared folder, streamed; hosts may be restricted by MILLRACE_HOSTS.

    A redirect isn't followed if hosts are restricted, as it may lead to another one.
    """
    from millrace.streaming.sources import allow_host

    allow_host(urllib.parse.urlsplit(url).hostname or "")
    path = _shared(spark, os.path.basename(urllib.parse.urlsplit(url).path) or "page")
    connection = spark._jvm.java.net.URI(url).toURL().openConnection()
    connection.setConnectTimeout(int(seconds * 1000))
    connection.setReadTimeout(int(seconds * 1000))
    connection.setInstanceFollowRedirects(not os.environ.get("MILLRACE_HOSTS"))
    if connection.getResponseCode() != 200:
        raise OSError(f"{url} answered {connection.getResponseCode()}")
    fs, new_path, conf = _file_system(spark, path)
    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(connection.getInputStream(), fs.create(new_path(path)), conf, True)
    return path


def unpacked(spark: SparkSession, path: str) -> str:
    """zstd files (a glob may name several) as plain ones in the shared folder: Spark's own codec needs a native library.

    The stream is unpacked by the JVM, block by block, and never held.
    """
    fs, new_path, conf = _file_system(spark, path)
    folder, names = _shared(spark, ""), []
    for status in fs.globStatus(new_path(path)) or []:
        names.append(folder + re.sub(r"\.zstd?$", "", status.getPath().getName()))
        target = _file_system(spark, names[-1])[0]
        stream = spark._jvm.com.github.luben.zstd.ZstdInputStream(fs.open(status.getPath()))
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, target.create(new_path(names[-1])), conf, True)
    if not names:
        raise FileNotFoundError(path)
    return names[0] if len(names) == 1 else folder


def piped(spark: SparkSession, stream: BinaryIO, ending: str) -> str:
    """A pipe's bytes as a file in the shared folder: a pipe belongs to one process."""
    path = _shared(spark, f"stdin.{ending}")
    fs, new_path, _ = _file_system(spark, path)
    out = fs.create(new_path(path))
    while block := stream.read(1 << 20):
        out.write(bytearray(block))
    out.close()
    return path


def format_of(path: str) -> str:
    bare = re.sub(r"\.(gz|zst|zstd|bz2)$", "", path.lower())
    ending = bare.rpartition(".")[2]
    return {"tsv": "tsv", "tab": "tsv", "json": "json", "jsonl": "json", "ndjson": "json", "parquet": "parquet"}.get(ending, "csv")


# From narrow to wide.
_WIDER = {("bigint", "double"): "double", ("double", "bigint"): "double"}


def widened(frames: list[DataFrame]) -> DataFrame:
    """All frames by name; a column's type is the narrowest that holds all, text if they differ in kind."""
    kinds: dict[str, str] = {}
    for df in frames:
        for name, kind in df.dtypes:
            have = kinds.get(name)
            if have is None or have == kind:
                kinds[name] = kind
            elif {have, kind} <= {"bigint", "double"}:
                kinds[name] = "double"
            elif "decimal" in have + kind and all(x in ("bigint", "double") or x.startswith("decimal") for x in (have, kind)):
                kinds[name] = have if have.startswith("decimal") else kind
            else:
                kinds[name] = "string"
    out = None
    for df in frames:
        same = df.select(*[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) if k != kinds[c] else F.col(f"`{c}`") for c, k in df.dtypes])
        out = same if out is None else out.unionByName(same, allowMissingColumns=True)
    return out


def read(resources: DataFrame, column: str = "path", fmt: str | None = None, with_source: bool = False, ledger: Ledger | None = None, scope: str = "") -> DataFrame:
    """The rows of all files that ``column`` names, united by name with types widened.

    Only names and first lines come to the driver. CSV files with the same header, JSON-lines
    files whose first objects have the same keys and Parquet files with the same schema are read
    by one reader each, so a plan has one branch for each distinct form, not for each file (JSON
    arrays have one each). Files that can't be read are left out and reported. ``with_source`` adds ``__src``, each row's file.
    """
    spark = resources.sparkSession
    names = sorted({r[0] for r in resources.select(column).filter(F.col(column).isNotNull()).distinct().collect()})
    groups: dict[tuple, list[str]] = {}
    for kind in ("csv", "tsv", "json", "parquet"):
        own = [n for n in names if (fmt or format_of(n)) in (kind, *(("jsonl", "ndjson") if kind == "json" else ()))]
        if not own:
            continue
        if kind in ("csv", "tsv"):
            for header, paths in _headers(spark, own, ledger, scope).items():
                groups[(kind, header)] = paths
        elif kind == "json":
            for line, paths in _headers(spark, own, ledger, scope).items():
                form = _keys(line)
                for n in paths:
                    groups.setdefault((kind, form or n), []).append(n)
        else:
            for n in own:
                groups.setdefault((kind, _form(spark, n)), []).append(n)
    frames = []
    for (kind, key), paths in groups.items():
        try:
            if kind in ("csv", "tsv"):
                sep = "\t" if kind == "tsv" else ","
                df = text.read_csv(spark, paths, sep=sep, ledger=ledger, scope=scope, names=text._cells(key, sep))
            elif kind == "json":
                df = text.read_json(spark, sorted(paths), ledger, scope)
            else:
                df = text.read_parquet(spark, *paths)
            frames.append(df.withColumn("__src", plain(F.input_file_name())) if with_source else df)
        except Exception as e:  # noqa: BLE001  one bad file must not stop the others; it is reported
            if ledger is None:
                raise
            ledger.add(Severity.ERROR, scope, f"{', '.join(paths)} could not be read: {str(e).splitlines()[0]}", len(paths))
    return widened(frames) if frames else spark.createDataFrame([], "path string").drop("path")


def _keys(line: str) -> tuple[str, ...] | None:
    """The keys of a line that is one JSON object."""
    try:
        found = json.loads(line)
    except ValueError:
        return None
    return tuple(found) if isinstance(found, dict) else None


def _form(spark: SparkSession, path: str) -> str:
    """A Parquet file's schema; its path if it can't be read, which is reported where it is read."""
    try:
        return spark.read.parquet(path).schema.json()
    except Exception:  # noqa: BLE001
        return path


def _headers(spark: SparkSession, paths: list[str], ledger: Ledger | None, scope: str) -> dict[str, list[str]]:
    there = []
    for p in paths:
        try:
            spark.read.text(p)
            there.append(p)
        except Exception as e:  # noqa: BLE001
            if ledger is None:
                raise
            ledger.add(Severity.ERROR, scope, f"{p} could not be opened: {str(e).splitlines()[0]}")
    if not there:
        return {}
    lines = spark.read.text(there).select(plain(F.col("_metadata.file_path")).alias("p"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("o"), "value")
    out: dict[str, list[str]] = {}
    for p, header in sorted(tuple(r) for r in lines.groupBy("p").agg(F.min_by("value", "o")).collect()):
        out.setdefault(header.removeprefix("﻿").rstrip("\r"), []).append(p)
    return out


def binary_type(fields: list[tuple[str, str]], big: bool = False, aligned: bool = False) -> np.dtype:
    order = ">" if big else "<"
    codes = [(n, f"S{kind[5:-1]}" if kind.startswith("char[") else order + BINARY[kind]) for n, kind in fields]
    return np.dtype(codes, align=aligned)


def read_binary(spark: SparkSession, path: str, fields: list[tuple[str, str]], big: bool = False, aligned: bool = False) -> DataFrame:
    """Fixed-width records: i8 to u64, f32, f64, bool and char[N], packed or with C alignment.

    Splits a large file at record borders; records are decoded by the batch.
    """
    kind = binary_type(fields, big, aligned)
    lanes = {n: "double" if k in ("f32", "f64") else "boolean" if k == "bool" else "string" if k.startswith("char[") else "bigint" for n, k in fields}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(0).cast(pa.large_binary())  # records stand one after the other in its buffer
            at = cells.offset * kind.itemsize
            rows = np.frombuffer(cells.buffers()[2], dtype=kind, count=len(cells), offset=at) if len(cells) else np.zeros(0, dtype=kind)
            out = []
            for name, k in fields:
                column = rows[name]
                if k.startswith("char["):
                    size = int(k[5:-1])
                    out.append(pa.array([bytes(v).ljust(size, b"\0").decode("utf-8", "replace") for v in column], pa.string()))
                elif k == "bool":
                    out.append(pa.array(column != 0))
                elif k in ("f32", "f64"):
                    out.append(pa.array(column.astype(np.float64)))
                else:
                    out.append(pa.array(column.astype(np.int64)))
            yield pa.RecordBatch.from_arrays(out, [n for n, _ in fields])

    # The JVM cuts the file into records; no Python runs for a single one.
    jvm, context = spark._jvm, spark._jsc.sc()
    records = spark._jsparkSession.createDataset(context.binaryRecords(path, kind.itemsize, context.hadoopConfiguration()), jvm.org.apache.spark.sql.Encoders.BINARY())
    return DataFrame(records.toDF(), spark).mapInArrow(decode, ", ".join(f"`{n}` {t}" for n, t in lanes.items()))
