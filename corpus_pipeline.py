"""From raw documents to token ids: five stages, each written as Parquet and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import encode_documents
from millrace.llm.common import materialize, scratch_dir
from millrace.llm.line_dedup import drop_boilerplate
from millrace.llm.mixing import mix
from millrace.llm.near_dedup import near_duplicates
from millrace.llm.quality_rules import keep_good

#: Share of all tokens that the mixture takes; no document is repeated.
BUDGET_SHARE = 0.95


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules, or whose host does, go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source are cut out; copies of a text count once there."""
    cut = drop_boilerplate(docs, by_text=True).withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("bigint"))
    return cut.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, 0.8 or more) one row stays, of the smallest id; null ids come last.

    Rows are told apart by id and 96 bits of hashes of the text. Of rows that are equal in
    both one stays as well, unless the text is null or blank: such rows link with nothing, so
    all of them stay. Texts are compared by a shuffle of their own only where rows repeat.
    """
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("id"), F.xxhash64("text").alias("a"), F.hash("text").alias("b"))
    keyed = docs.withColumn("__key", key)
    found = near_duplicates(keyed.select("__key", "text"), id_col="__key").filter("kept")
    found = materialize(found.groupBy("__key").agg(((F.count(F.lit(1)) > 1) & (F.max("n_shingles") > 0)).alias("repeated")), "kept")
    out = keyed.join(found.filter("not repeated"), "__key", "left_semi")
    if not found.filter("repeated").isEmpty():
        out = out.unionAll(keyed.join(found.filter("repeated"), "__key", "left_semi").dropDuplicates(["__key"]))
    return out.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their weights."""
    return mix(docs, BUDGET_SHARE).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids."""
    encoded = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: SQL can express neither the near-duplicate groups nor the encoding; tests/llm hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
