"""Windows, fills, as-of joins and percentiles over one order: equal to one task's, without one."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import group as g
from millrace.operators import join as j
from millrace.operators import ranges
from millrace.operators import rows as r
from millrace.operators import window as w


@pytest.fixture
def small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranges, "BLOCK", 7)
    monkeypatch.setattr(ranges, "SMALL_BYTES", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def series(spark, n=200):
    rnd = random.Random(1)
    at = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at += dt.timedelta(seconds=rnd.choice([1, 5, 700]))
        rows.append((i, at if i % 11 else None, float(rnd.randint(0, 50)) if i % 5 else None))
    return spark.createDataFrame(rows, "i int, ts timestamp_ntz, v double").repartition(9)


def same(a, b):
    assert sorted(map(str, map(tuple, a.collect()))) == sorted(map(str, map(tuple, b.collect())))


@pytest.mark.parametrize("kind", ["lag", "lead", "diff", "pct_change", "rolling_sum", "rolling_avg", "rolling_min", "rolling_max"])
@pytest.mark.parametrize("n", [1, 3, 20])
def test_windows_without_keys(spark, small_blocks, kind, n):
    df = series(spark)
    whole = df.withColumn("k", F.lit(1))
    same(w.with_window(df, "x", kind, "v", n, [], ["i"]), w.with_window(whole, "x", kind, "v", n, ["k"], ["i"]).drop("k"))


def test_sessions_without_keys(spark, small_blocks):
    df = series(spark)
    same(w.with_session(df, "s", "ts", "10m", [], ["i"]), w.with_session(df.withColumn("k", F.lit(1)), "s", "ts", "10m", ["k"], ["i"]).drop("k"))


@pytest.mark.parametrize("keys", [[], ["k"], ["k", "m"]])
def test_asof_in_ranges(spark, small_blocks, keys):
    rnd = random.Random(5)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randint(0, 300))
    key = lambda: rnd.choice(["a", "a", "a", "b", None])
    left = spark.createDataFrame([(key(), key(), at() if i % 9 else None, i) for i in range(150)], "k string, m string, ts timestamp_ntz, i int")
    right = spark.createDataFrame([(key(), key(), at(), i, i) for i in range(60)], "k string, m string, ts timestamp_ntz, v int, o int")
    right = right.select(*keys, "ts", "v", "o")
    plain_keys = keys or ["one"]
    plain = j.asof(left.withColumn("one", F.lit("x")), right.withColumn("one", F.lit("x")), plain_keys, "ts", "1h", ["o"]).drop("one", "one_r")
    same(j.asof(left, right, keys, "ts", "1h", ["o"], hot=0), plain)


def test_percentiles_pick_ranks(spark, small_blocks):
    rnd = random.Random(3)
    rows = [(rnd.choice(["x", "y", None]), rnd.choice([None, 1.0, 2.5, rnd.random() * 100])) for _ in range(500)] + [("none", None), ("one", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    out = g.group(df, ["k"], [("median", "v"), ("count", "v"), ("p90", "v"), ("p0", "v"), ("p100", "v")])
    assert out.columns == ["k", "count", "median_v", "count_v", "p90_v", "p0_v", "p100_v"]
    plain = df.groupBy("k").agg(F.count(F.lit(1)), F.percentile("v", 0.5), F.count("v"), F.percentile("v", 0.9), F.min("v"), F.max("v"))
    got, expected = ({x[0]: x[1:] for x in map(tuple, d.collect())} for d in (out, plain))
    assert got.keys() == expected.keys()
    assert all(a == b or abs(a - b) < 1e-9 for k in got for a, b in zip(got[k], expected[k]))
    filled = r.fill_statistic(df, "v", "median")
    median = df.agg(F.percentile("v", 0.5)).first()[0]
    assert filled.filter(F.col("v") == median).count() >= sum(v is None for _, v in rows)
    assert g.group(df.limit(0), ["k"], [("median", "v")]).count() == 0


def test_small_tables_have_the_same_percentiles(spark, monkeypatch):
    rnd = random.Random(4)
    df = spark.createDataFrame([(rnd.choice("xyz"), rnd.choice([None, rnd.random() * 100]), float(rnd.randint(0, 9))) for _ in range(400)], "k string, v double, u double")
    wanted = [("median", "v"), ("p90", "u"), ("sum", "u"), ("p10", "v"), ("median", "u")]
    at_once = g.group(df, ["k"], wanted)
    assert at_once.columns == ["k", "count", *[f"{f}_{c}" for f, c in wanted]]
    monkeypatch.setattr(ranges, "SMALL_BYTES", -1)
    ranked = {r.k: r for r in g.group(df, ["k"], wanted).collect()}
    for r in at_once.collect():
        assert all(abs(a - b) < 1e-9 for a, b in zip(r[1:], ranked[r.k][1:]))


def test_no_task_holds_a_group(spark, small_blocks):
    text = g.group(spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v")), ["k"], [("median", "v")])._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in text


def test_hop_group_equals_copied_rows(spark):
    df = series(spark).withColumn("k", F.col("i") % 3)
    wanted = [("sum", "v"), ("avg", "v"), ("min", "v"), ("max", "v"), ("count", "v")]
    for size, hop in (("10m", "2m"), ("5m", "2m")):
        copied = g.group(df.withColumn("w", F.explode(ranges_hops(size, hop))), ["w", "k"], wanted)
        same(g.hop_group(df, "ts", size, hop, ["k"], wanted).select(*copied.columns), copied)


def ranges_hops(size, hop):
    from millrace.functions import temporal as t

    return t.hops(F.col("ts"), size, hop)


@pytest.mark.parametrize("by", [None, ["k"]])
def test_bfill_reads_a_partition_once(spark, by):
    """A frame to the end is gone through anew for each row: a range's rows, squared."""
    n = 200_000
    df = spark.range(n).select("id", F.lit(1).alias("k"), F.when(F.col("id") % 1000 == 998, F.col("id").cast("string")).when(F.col("id") % 2 == 0, "").alias("v"))
    filled = r.bfill(df, "v", ["id"], by)
    assert "unboundedfollowing" not in filled._jdf.queryExecution().optimizedPlan().toString().lower()
    after = F.col("id") + F.pmod(998 - F.col("id"), F.lit(1000))
    expected = F.when(after < n, after.cast("string")).when(F.col("id") % 2 == 0, "")
    assert filled.count() == n and filled.filter(~F.col("v").eqNullSafe(expected)).count() == 0


@pytest.mark.parametrize("known", [0, 2, 7, 30])
@pytest.mark.parametrize("by", [[], ["k"]])
def test_bfill_equals_a_walk_backwards(spark, small_blocks, by, known):
    rnd = random.Random(known)
    rows = [(i, rnd.choice(["a", "b", None]), f"v{i}" if rnd.randrange(30) < known else rnd.choice([None, ""])) for i in range(300)]
    after, expected = {}, {}
    for i, k, v in reversed(rows):
        key = k if by else 0
        after[key] = v or after.get(key)
        expected[i] = after[key] or v
    df = spark.createDataFrame(rows, "i int, k string, v string").repartition(9)
    out = r.bfill(df, "v", ["i"], by)
    assert out.schema == df.schema and {x.i: x.v for x in out.collect()} == expected
    if by:  # keys of an order may have directions
        mirrored = r.bfill(df.withColumn("m", -F.col("i")), "v", [F.desc("m")], by)
        assert {x.i: x.v for x in mirrored.collect()} == expected
