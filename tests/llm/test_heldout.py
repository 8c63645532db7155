"""Held-out quality on the driver's tables: the figures of the README."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.llm.queries import QUERIES

DATA = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def test_quality_of_documents_not_learnt_from(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")
    rows = QUERIES["op9_quality_classifier"](spark, DATA).filter("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == label] for label in (1, 0))
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    print(f"op9: {len(rows)} held out, accuracy {right:.4f}, AUC {auc:.4f}, share of good {len(good) / len(rows):.3f}")
    assert auc >= 0.98 and right >= 0.98


def test_language_of_documents_not_learnt_from(spark):
    lang = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op10_language_id"](spark, DATA).filter("held_out").join(lang, "doc_id").filter(F.col("lang").isNotNull()).collect()
    right = sum(r.lang == r.lang_pred for r in rows) / len(rows)
    print(f"op10: {len(rows)} held out, accuracy {right:.4f}")
    assert right >= 0.99
