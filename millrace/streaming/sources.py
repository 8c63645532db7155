"""``watch`` and ``subscribe`` as Structured Streaming sources, within what the environment allows.

MILLRACE_WATCH_PATHS and MILLRACE_HOSTS (comma-separated) restrict what may be watched or
subscribed to; unset, anything may.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.files import _root, path_pattern, plain


class NotAllowed(PermissionError):
    """A path or host outside the allowed ones."""


def _listed(variable: str) -> list[str]:
    return [p for p in os.environ.get(variable, "").split(",") if p]


def allow_host(host: str) -> None:
    """A host has to be one of MILLRACE_HOSTS, not merely begin like one."""
    if _listed("MILLRACE_HOSTS") and host.lower() not in {h.lower() for h in _listed("MILLRACE_HOSTS")}:
        raise NotAllowed(f"{host} isn't among MILLRACE_HOSTS")


def allow_path(path: str) -> None:
    """A path has to be one of MILLRACE_WATCH_PATHS or lie below one."""
    plain = os.path.normpath(path.removeprefix("file://"))
    folders = [os.path.normpath(p.removeprefix("file://")) for p in _listed("MILLRACE_WATCH_PATHS")]
    if folders and not any(plain == f or plain.startswith(f.rstrip("/") + "/") for f in folders):
        raise NotAllowed(f"{path} isn't below MILLRACE_WATCH_PATHS")


def watch(spark: SparkSession, glob: str, files_per_trigger: int = 1000) -> DataFrame:
    """A row for each new file: path, name, size, mtime, like ``ls``.

    Files that change after they were seen aren't seen again. ``files_per_trigger`` bounds a batch.
    """
    root = _root(glob)
    allow_path(root)
    found = spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(files_per_trigger)).load(root)
    found = found.select(plain(F.col("path")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("mtime"))
    found = found.filter(F.col("path").rlike(path_pattern(glob)))
    return found.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "size", "mtime")


def subscribe(spark: SparkSession, url: str, schema: str | None = None, fmt: str = "csv") -> DataFrame:
    """Lines of a TCP server, parsed by ``schema`` (a DDL text) as csv, tsv or json; raw without one."""
    m = re.fullmatch(r"tcp://([^:/]+):(\d+)", url)
    if not m:
        raise ValueError(f"expected tcp://host:port, found {url}")
    allow_host(m[1])
    lines = spark.readStream.format("socket").option("host", m[1]).option("port", m[2]).load()
    if schema is None:
        return lines
    if fmt in ("json", "jsonl", "ndjson"):
        return lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    return lines.select(F.from_csv("value", schema, {"sep": "\t" if fmt == "tsv" else ","}).alias("r")).select("r.*")


def subscribe_fields(spark: SparkSession, url: str, fields: list[tuple[str, str | None]], fmt: str = "csv") -> DataFrame:
    """The same with the flow language's types: cells that don't fit become null."""
    from millrace.sources.text import typed

    raw = subscribe(spark, url, ", ".join(f"`{n}` string" for n, _ in fields), fmt)
    return typed(raw, {n: kind or "str" for n, kind in fields})


def read_stream(spark: SparkSession, folder: str, schema: str, fmt: str = "csv", **options: str) -> DataFrame:
    """Rows of the files that arrive in a folder."""
    return spark.readStream.schema(schema).format({"tsv": "csv", "jsonl": "json"}.get(fmt, fmt)).options(**({"sep": "\t"} if fmt == "tsv" else {}), **options).load(folder)


def take(df: DataFrame, n: int, sink: Callable[[DataFrame], None], checkpoint: str) -> int:
    """Run a stream until ``n`` rows have gone to ``sink``; returns how many did.

    The only way in which an unbounded flow ends by itself.
    """
    seen = 0
    done: list[bool] = []

    def batch(rows: DataFrame, _: int) -> None:
        nonlocal seen
        if seen >= n:
            return
        part = rows.limit(n - seen)
        part.persist()
        seen += part.count()
        sink(part)
        part.unpersist()
        if seen >= n:
            done.append(True)

    query = df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
    while query.isActive and not done:
        query.awaitTermination(0.2)
        if query.exception():
            raise query.exception()
    query.stop()
    return seen
