"""Time windows over streams (and, alike, over tables): tumbling, sliding, session.

An extension: late rows are dropped by a watermark, which bounds the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, ts: str, lateness: str | None) -> DataFrame:
    # Watermarks need an instant with a zone; the session's is UTC.
    df = df.withColumn(ts, F.col(ts).cast("timestamp_ltz"))
    return df.withWatermark(ts, lateness) if lateness and df.isStreaming else df


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], aggregates: list[Column], lateness: str | None = "10 minutes") -> DataFrame:
    return sliding(df, ts, size, size, keys, aggregates, lateness)


def sliding(df: DataFrame, ts: str, size: str, hop: str, keys: list[str], aggregates: list[Column], lateness: str | None = "10 minutes") -> DataFrame:
    """``window_start``, the keys, and the aggregates of each window that starts every ``hop``."""
    window = F.window(ts, size, hop)
    out = _late(df, ts, lateness).groupBy(window.alias("__w"), *keys).agg(*aggregates)
    return out.select(F.col("__w.start").cast("timestamp_ntz").alias("window_start"), *[c for c in out.columns if c != "__w"])


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], aggregates: list[Column], lateness: str | None = "10 minutes") -> DataFrame:
    """``session_start``, ``session_end``, the keys, and the aggregates of each session."""
    out = _late(df, ts, lateness).groupBy(F.session_window(ts, gap).alias("__w"), *keys).agg(*aggregates)
    return out.select(F.col("__w.start").cast("timestamp_ntz").alias("session_start"), F.col("__w.end").cast("timestamp_ntz").alias("session_end"), *[c for c in out.columns if c != "__w"])
