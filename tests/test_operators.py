"""Every query against DuckDB, and operators on small literal tables."""

import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace import queries as q
from millrace.events import Ledger
from millrace.functions import scalar as s
from millrace.functions import temporal as t
from millrace.operators import group as g
from millrace.operators import join as j
from millrace.operators import rows as r
from millrace.operators import shape
from millrace.operators import window as w

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(show(row[i]) for i in order) for row in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", list(q.QUERIES))
def test_query(spark, duck, name):
    df = q.QUERIES[name](spark, DATA)
    sql = duck.execute(q.ORACLES[name])
    names = [c[0] for c in sql.description]
    assert sorted(df.columns) == sorted(names)
    assert plain([tuple(x) for x in df.collect()], df.columns) == plain(sql.fetchall(), names)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_explode_reads_every_vector(spark, duck):
    n = duck.execute("SELECT sum(len(embedding)), count(DISTINCT vec_id) FROM embeddings").fetchone()
    assert q.QUERIES["explode"](spark, DATA).agg(F.count("x"), F.countDistinct("vec_id")).first() == n and n[1] > 50


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'bigint' if isinstance(v, int) else 'double' if isinstance(v, float) else 'timestamp_ntz'}" for n, v in values.items()))
    return df.select(column(*[F.col(n) for n in names])).first()[0]


def test_scalar_edges(spark):
    assert one(spark, lambda c: s.upper(c), a=None) == ""
    assert one(spark, lambda c: s.substr(c, F.lit(0), F.lit(2)), a="abc") == "ab"
    assert one(spark, lambda c: s.replace(c, F.lit(""), F.lit("x")), a="abc") == "abc"
    assert one(spark, lambda c: s.split_part(c, F.lit("/"), F.lit(0)), a="a/b") == ""
    assert one(spark, lambda c: s.split_part(c, F.lit("/"), F.lit(-2)), a="a/b") == "a"
    assert one(spark, lambda c: s.matches(c, "("), a="(") is False
    assert one(spark, lambda c: s.like(c, "a\\_%"), a="a\\xb") is True
    assert one(spark, lambda c: s.glob(c, "[!a]?*"), a="bcd") is True
    assert one(spark, lambda c: s.stem(c), a="/x/.profile") == ".profile"
    assert one(spark, lambda c: s.stem(c), a="/x/a.tar.gz") == "a.tar"
    assert one(spark, lambda c: s.dirname(c), a="a") == "."
    assert one(spark, lambda c: s.dirname(c), a="/a") == "/"
    assert one(spark, lambda c: s.whole("round", c), a=-2.5) == -3
    assert one(spark, lambda c: s.to_int(c), a=" 3.9 ") == 3
    assert one(spark, lambda c: s.to_int(c), a="x") is None
    assert float(one(spark, lambda c: s.to_decimal(c, 2), a="2.345")) == 2.34
    assert one(spark, lambda c: s.divide(c, F.lit(0)), a=1) is None
    assert one(spark, lambda c: s.modulo(c, F.lit(2)), a=-7) == -1
    assert one(spark, lambda c: s.trim(c), a="\t x　") == "x"
    assert one(spark, lambda c: s.concat(c, F.lit("b")), a=None) == "b"


def test_instants(spark):
    day = dt.datetime(2026, 6, 1, 5, 30)
    for text in ("2026-06-01T14:30:00+09:00", "2026-06-01 14:30:00 JST", "2026-06-01T05:30:00Z", "2026-06-01T05:30:00.9", "20260601053000", "260601053000"):
        assert one(spark, t.to_instant, a=text) == day, text
    for text in ("2026-06-01 14:30:00 CST", "2026-02-30", "", "12"):
        assert one(spark, t.to_instant, a=text) is None, text
    assert one(spark, lambda c: t.parse_instant(c, "[ja-jp]yyyy年MM月dd日(ddd)"), a="2026年06月01日(月)") == dt.datetime(2026, 6, 1)
    assert one(spark, lambda c: t.parse_instant(c, "[ja-jp]yyyy年MM月dd日(ddd)"), a="2026年06月01日(火)") is None
    assert one(spark, lambda c: t.parse_instant(c, "HH:mm:ss.nnnnnn"), a="01:02:03.000004") == dt.datetime(1970, 1, 1, 1, 2, 3, 4)
    assert one(spark, lambda c: t.format_instant(c, "[ja-jp]ddd"), a=day) == "月"
    with pytest.raises(ValueError):
        t.parse_instant(F.lit(""), "[xx]yyyy")
    assert one(spark, t.to_time, a="9:5:0") == "09:05:00" and one(spark, t.to_time, a="25:00:00") is None


def test_spans(spark):
    assert t.span_us("15m") == 900_000_000 and t.span_us("-1d 00:00:01") == -86_401_000_000 and t.span_us("5 weeks") is None
    assert one(spark, lambda c: t.interval_us(t.parse_span(c)), a="3d 02:15:00.5") == t.span_us("3d 02:15:00.5")
    assert one(spark, lambda c: t.interval_us(t.parse_span(c)), a="2 hours") == 7_200_000_000
    assert one(spark, lambda c: t.format_span(t.parse_span(c)), a="-3d 02:15:00") == "-3d 02:15:00"
    assert one(spark, lambda c: t.format_span(t.parse_span(c), True), a="26:00:01") == "PT26H0M1S"
    assert one(spark, lambda c: t.parse_span(c), a="soon") is None


def test_buckets_before_1970(spark):
    at = dt.datetime(1969, 12, 31, 23, 59)
    assert one(spark, lambda c: t.bucket(c, "15m"), a=at) == dt.datetime(1969, 12, 31, 23, 45)
    assert one(spark, lambda c: t.bucket(c, "nonsense"), a=at) is None
    assert one(spark, lambda c: t.hops(c, "5m", "2m"), a=dt.datetime(2024, 1, 1, 0, 4)) == [dt.datetime(2024, 1, 1, 0, 0), dt.datetime(2024, 1, 1, 0, 2), dt.datetime(2024, 1, 1, 0, 4)]
    assert one(spark, lambda c: t.hops(c, "1m", "10m"), a=dt.datetime(2024, 1, 1, 0, 5)) == []


def test_group_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (1, 2.0, 6), (2, None, 7)], "k int, v double, o int")
    out = g.group(df, ["k"], [("sum", "v"), ("std", "v"), ("first", "v"), ("array_agg", "v"), ("count", "v")], ["o"]).orderBy("k").collect()
    assert [tuple(x) for x in out] == [(1, 2, 2.0, None, 2.0, [2.0], 1), (2, 1, None, None, None, [], 0)]
    with pytest.raises(ValueError):
        g.group(df, ["k"], [("p101", "v")])


def test_ordered_fill_over_many_ranges(spark):
    data = [(i, None if i % 97 else f"v{i}") for i in range(1000)]
    df = spark.createDataFrame(data, "i int, v string").repartition(7)
    got = dict(r.ffill(df, "v", ["i"]).collect())
    assert all(got[i] == f"v{i - i % 97}" for i in range(1000))
    back = dict(r.bfill(df, "v", ["i"]).collect())
    assert all(back[i] == (f"v{-(-i // 97) * 97}" if -(-i // 97) * 97 < 1000 else None) for i in range(1000))


def test_contract_counts(spark):
    ledger = Ledger()
    df = spark.createDataFrame([(1,), (None,), (-1,)], "a int")
    assert r.validate(df, F.col("a") > 0, "reject", "a > 0", ledger, "X").count() == 1
    assert [e.count for e in ledger.collect()] == [2]


def test_asof_ties_and_nulls(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    left = spark.createDataFrame([("a", at(5), 1), (None, at(5), 2), ("a", None, 3)], "k string, ts timestamp_ntz, n int")
    right = spark.createDataFrame([("a", at(5), 10, 1), ("a", at(5), 11, 2), (None, at(1), 12, 3)], "k string, ts timestamp_ntz, v int, o int")
    out = j.asof(left, right, ["k"], "ts", right_order=["o"]).select("n", "v").collect()
    assert dict(map(tuple, out)) == {1: 11, 2: None, 3: None}


def test_session_boundary_and_nulls(spark):
    at = lambda m, sec=0: dt.datetime(2024, 1, 1, 0, m, sec)
    df = spark.createDataFrame([(1, at(0)), (2, at(10)), (3, at(20, 1)), (4, None)], "i int, ts timestamp_ntz")
    out = dict(w.with_session(df, "s", "ts", "10m", [], ["i"]).select("i", "s").collect())
    assert out == {1: at(0), 2: at(0), 3: at(20, 1), 4: None}


def test_describe_skips_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "n bigint, s string")
    assert [tuple(x) for x in shape.describe(df).collect()] == [("n", "i64", 2, "1", "1", "1.0"), ("s", "str", 2, None, None, None)]


def test_dropna_keeps_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "v double")
    assert r.dropna(df, "v").count() == 2
