"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chat_format, line_dedup, mixing, quality_rules
from millrace.llm.bpe import encode_documents
from millrace.llm.common import table
from millrace.llm.fingerprint import compare_edits
from millrace.llm.language_id import fit_languages, identify_languages
from millrace.llm.near_dedup import near_duplicates
from millrace.llm.quality_classifier import fit_quality, score_quality
from millrace.llm.substring_dedup import remove_repeats


#: Budget over all tokens, and epochs at most.
MIX = (1.1, 2)


def _fold(column: str, folds: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 6))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), *MIX)
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(chat_format.as_calls(table(spark, sf_dir, "conversations")), chat_format.ASK)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = fit_quality(docs, labels.filter(_fold("doc_id", 5) != 0), "quality")
    return score_quality(docs, model).select("doc_id", (_fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.filter(_fold("doc_id", 4) != 2), "doc_id", "text", "lang")
    return identify_languages(docs, model).select("doc_id", (_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_fingerprints": op3_fingerprints,
    "op4_line_dedup": op4_line_dedup,
    "op5_near_dedup": op5_near_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_mixing": op7_mixing,
    "op8_chat_format": op8_chat_format,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_language_id": op10_language_id,
}

ORACLES: dict[str, str] = {
    "op4_line_dedup": line_dedup.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "op7_mixing": mixing.oracle(*MIX),
    "op8_chat_format": chat_format.ORACLE,
}
