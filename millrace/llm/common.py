"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.scratch import materialize, scratch_dir

__all__ = ["join_checked", "materialize", "sample_by_hash", "scratch_dir", "table"]

#: A side of a join is broadcast only if it has been written and has no more rows and bytes than this.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20


def join_checked(large: DataFrame, small: DataFrame, on: Column, how: str) -> DataFrame:
    """Join with a written table: broadcast if its size allows, else left to Spark's shuffle.

    ``small`` has to be cheap to read; its rows are counted and its columns' sizes summed.
    """
    widths = [F.coalesce(F.sum(F.octet_length(F.col(c).cast("string"))), F.lit(0)) for c in small.columns]
    rows, *sizes = small.agg(F.count(F.lit(1)), *widths).first()
    if rows <= BROADCAST_ROWS and sum(sizes) <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return large.join(small, on, how)


def sample_by_hash(rows: DataFrame, id_col: str, class_col: str, classes: list, most: int, seed: int) -> tuple[DataFrame, dict]:
    """Of each class the ``most`` rows of ``(id, class)`` with the smallest hash of the id.

    Only ids come to the driver, ``most`` of each class, so the result may be broadcast.
    Also returns the size of each class.
    """
    spark, found = rows.sparkSession, []
    schema = T.StructType([T.StructField("__id", rows.schema[id_col].dataType), T.StructField("__class", rows.schema[class_col].dataType)])
    for name in classes:
        own = rows.filter(F.col(class_col) == F.lit(name)).select(id_col)
        found += [(r[0], name) for r in own.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(most).collect()]
    counts = {r[0]: r[1] for r in rows.filter(F.col(class_col).isin(classes)).groupBy(class_col).count().collect()} if classes else {}
    return spark.createDataFrame(found, schema), counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
