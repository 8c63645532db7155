"""The pipeline against a plain Python version of its stages, and queries with planted cases."""

import os
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from millrace.llm import mixing
from millrace.llm.bpe import load_ranks
from millrace.llm.line_dedup import MAX_RATIO, MIN_PAGES
from millrace.llm.queries import QUERIES

from .test_filters import plain_hosts, plain_metrics
from .test_near import brute as near_brute

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def plain_quality(rows):
    failed = {}
    for r in rows:
        n, _, _, _, repeated = plain_metrics(r["text"])
        failed[r["doc_id"]] = n < 20 or 100 * repeated > 30 * n
    count, bad = Counter(r["source"] for r in rows), Counter(r["source"] for r in rows if failed[r["doc_id"]])
    good = {h for h, (_, kept) in plain_hosts({h: (n, bad[h]) for h, n in count.items()}).items() if kept}
    return [r for r in rows if not failed[r["doc_id"]] and r["source"] in good]


def plain_lines(rows):
    pages, seen = Counter(r["source"] for r in rows), defaultdict(Counter)
    for r in rows:
        seen[r["source"]].update(set(r["text"].split("\n")))
    drop = {h: {line for line, n in c.items() if line.strip(" ") and n >= MIN_PAGES and n > MAX_RATIO * pages[h]} for h, c in seen.items()}
    out = []
    for r in rows:
        text = "\n".join(line for line in r["text"].split("\n") if line not in drop[r["source"]])
        out.append(r | {"text": text, "n_chars": len(text)})
    return out


def plain_near(rows):
    found = near_brute([(r["doc_id"], r["text"]) for r in rows], 5, 80)
    return [r for r in rows if found[r["doc_id"]][1] == r["doc_id"]]


def plain_mix(rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows))
    kept = {x[0] for x in con.execute(f"SELECT doc_id FROM ({mixing.oracle(cp.BUDGET_SHARE, 1)})").fetchall()}
    return [r for r in rows if r["doc_id"] in kept]


def test_pipeline_equals_plain_python(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"])
    now = docs
    for (name, stage), plain in zip(cp.STAGES[:-1], (plain_quality, plain_lines, plain_near, plain_mix)):
        before = len(rows)
        now, rows = stage(spark, now, DATA), plain(rows)
        assert now.columns == docs.columns, name
        got = sorted((tuple(r) for r in now.collect()), key=lambda r: r[0])
        assert got == [tuple(r[c] for c in docs.columns) for r in rows], name
        assert len(rows) < before or name in ("line dedup", "mixing"), name
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = {r.doc_id: r for r in cp.run(spark, DATA).collect()}
    assert {i: list(r.ids) for i, r in out.items()} == {r["doc_id"]: theirs.encode_ordinary(r["text"]) for r in rows}
    assert all(r.n_tokens == len(r.ids) for r in out.values())


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() == 0, name
        docs = out if out.columns == docs.columns else docs


def test_stages_keep_nulls_from_crashing(spark):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(None, None, None, None, None), (1, text, None, None, 3), (1, text, None, None, 3), (2, "", "en", "s", 0)], schema)
    for _, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), schema)
    assert {r.doc_id for r in docs.collect()} == {1}


def test_stages_with_long_texts_ties_and_more_columns(spark, prose):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    long = prose(1, 80_000)
    rows = [(1, long, "en", "s", 0), (2, long, "en", "s", 0), (3, prose(3, 60), "en", "s", 0), (4, prose(3, 60), "en", "s", 0), (5, prose(5, 60), "de", "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").select(*schema.names)
    more = docs.withColumns({"kept": F.lit(True), "host": F.lit("x"), "tokens": F.lit(1), "whole": F.lit(2), "component_id": F.lit(9), "token": F.lit("t")})
    for name, stage in cp.STAGES[:-1]:
        plain, wide = stage(spark, docs, DATA), stage(spark, more, DATA)
        assert wide.columns == more.columns and sorted(r.doc_id for r in wide.collect()) == sorted(r.doc_id for r in plain.collect()), name
        if name == "near dedup":
            assert sorted(r.doc_id for r in plain.collect()) == [1, 3, 5]
    assert cp.tokens(spark, more, DATA).count() == 5


def test_near_dedup_keeps_one_row_of_each_component(spark):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    text = lambda name: " ".join(f"{name}{i}" for i in range(40))
    rows = [(None, text("alone")), (None, text("both")), (None, text("both")), (1, text("same")), (1, text("same")), (1, text("same")), (2, text("own")), (2, text("other")), (3, text("mixed")), (None, text("mixed"))]
    rows += [(4, text("near")), (None, text("near") + " more"), (-5, text("low")), (5, text("low")), (6, None), (6, None), (None, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").select(*schema.names)
    got = Counter((r.doc_id, r.text) for r in cp.near_dedup(spark, docs, DATA).collect())
    assert got == Counter([(None, text("alone")), (None, text("both")), (1, text("same")), (2, text("own")), (2, text("other")), (3, text("mixed")), (4, text("near")), (-5, text("low")), (6, None), (6, None), (None, None), (7, "")])


@pytest.mark.parametrize("name", [n for n in QUERIES])
def test_queries_run_on_the_small_tables(spark, name):
    df = QUERIES[name](spark, DATA)
    source = "conversations" if name.startswith("op8") else "documents"
    n = spark.read.parquet(f"{DATA}/{source}.parquet").count()
    assert df.count() >= n if name.startswith("op7") else df.count() == n
