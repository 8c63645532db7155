"""One query for each operator, over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.events import Ledger
from millrace.functions import scalar as s
from millrace.functions import temporal as t
from millrace.operators import group as g
from millrace.operators import join as j
from millrace.operators import rows as r
from millrace.operators import shape
from millrace.operators import window as w
from millrace.scratch import materialize, scratch_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
BY_TIME = ["ts", "event_id"]


def query(sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events")


# Filters and projections


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_quantity >= 20 AND l_discount < 0.05 AND l_returnflag = 'R'""")
def filter_comma(spark, d):
    df = read(spark, d, "lineitem")
    kept = r.where(df, F.col("l_quantity") >= 20, F.col("l_discount") < 0.05, F.col("l_returnflag") == "R")
    return shape.project(kept, "l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice > 400000 OR o_orderstatus = 'P'")
def filter_or(spark, d):
    return r.where(read(spark, d, "orders"), (F.col("o_totalprice") > 400000) | (F.col("o_orderstatus") == "P")).select("o_orderkey", "o_orderpriority")


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END > 50, FALSE) AS high,
  coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END <> 50, FALSE) AS other FROM events""")
def compare_null(spark, d):
    df = events(spark, d).withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    kind = df.schema["v"].dataType
    lit = df.select(F.lit(50)).schema[0].dataType
    return df.select("event_id", s.compare(">", F.col("v"), F.lit(50), kind, lit).alias("high"), s.compare("!=", F.col("v"), F.lit(50), kind, lit).alias("other"))


@query("""SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'x' ELSE CAST(user_id AS VARCHAR) END AS u FROM events)
WHERE TRY_CAST(u AS DOUBLE) >= 20""")
def compare_text_number(spark, d):
    df = events(spark, d).withColumn("u", F.when(F.col("event_id") % 5 == 0, "x").otherwise(F.col("user_id").cast("string")))
    return df.filter(s.compare(">=", F.col("u"), F.lit(20), df.schema["u"].dataType, df.select(F.lit(20)).schema[0].dataType)).select("event_id")


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net,
  CAST(l_linenumber AS BIGINT) * 10 AS tens, l_quantity / nullif(l_linenumber - 1, 0) AS ratio, l_orderkey % l_linenumber AS rest FROM lineitem""")
def project_computed(spark, d):
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"),
        (F.col("l_linenumber").cast("bigint") * 10).alias("tens"),
        s.divide(F.col("l_quantity"), F.col("l_linenumber") - 1).alias("ratio"),
        s.modulo(F.col("l_orderkey"), F.col("l_linenumber")).alias("rest"),
    )


@query("""SELECT c_custkey, CASE WHEN c_acctbal >= 7500 THEN 'high' WHEN c_acctbal >= 2500 THEN 'middle' ELSE 'low' END AS band,
  CASE WHEN c_acctbal < 0 THEN 'debt' ELSE '' END AS mark FROM customer""")
def case_band(spark, d):
    b = F.col("c_acctbal")
    return read(spark, d, "customer").select("c_custkey", s.case([(b >= 7500, F.lit("high")), (b >= 2500, F.lit("middle"))], F.lit("low")).alias("band"), s.case([(b < 0, F.lit("debt"))]).alias("mark"))


@query("""SELECT event_id, CAST(trunc(value) AS BIGINT) AS i, CAST(CAST(value AS VARCHAR) AS DOUBLE) AS f,
  CAST(user_id AS VARCHAR) AS txt, user_id % 2 <> 0 AS odd, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS BIGINT) AS parsed FROM events""")
def cast_lanes(spark, d):
    df = events(spark, d).select("event_id", F.col("value").alias("i"), F.col("value").cast("string").alias("f"), F.col("user_id").alias("txt"), (F.col("user_id") % 2).alias("odd"), F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("user_id").cast("string")).alias("parsed"))
    return shape.cast(df, {"i": "int", "f": "float", "txt": "str", "odd": "bool", "parsed": "int", "missing": "int"})


@query("SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(38,9)), 2) AS DOUBLE) AS price FROM orders")
def cast_decimal(spark, d):
    out = shape.cast(read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price")), {"price": "decimal(2)"})
    return out.withColumn("price", F.col("price").cast("double"))


@query("SELECT p_name AS title, p_partkey AS id, p_size, p_retailprice FROM part")
def rename_drop_reorder(spark, d):
    df = shape.rename(read(spark, d, "part"), {"p_name": "title", "p_partkey": "id", "nothing": "x"})
    return shape.reorder(shape.drop(df, "p_brand", "p_type", "nothing"), "title", "id")


@query("SELECT p_partkey, substr(p_name, 1, 3) AS head, CASE WHEN length(p_brand) >= 8 THEN substr(p_brand, 7, 2) END AS tail FROM part")
def sub_views(spark, d):
    return read(spark, d, "part").select("p_partkey", s.sub_view(F.col("p_name"), 0, 3).alias("head"), s.sub_view(F.col("p_brand"), 6, 8).alias("tail"))


@query("SELECT n_nationkey AS a, n_name AS b FROM nation WHERE n_regionkey = 2")
def positional_field(spark, d):
    return _flow(spark, d, 'X: open "@/nation.parquet" |? $_[2] == 2 |> ($_[0]) as a ($_[1]) as b ;').withColumn("a", F.col("a").cast("int"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice <= 150000")
def validate_reject(spark, d):
    df = r.validate(read(spark, d, "orders"), F.col("o_totalprice") >= 1000, "reject", "o_totalprice >= 1000")
    return r.validate(df, F.col("o_totalprice") <= 150000, "reject").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE NOT o_totalprice > 50000) AS warned FROM orders")
def validate_warn(spark, d):
    """All rows stay, and the ledger has the number of those that broke the rule."""
    ledger = Ledger()
    out = materialize(r.validate(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice") > 50000, "warn", ledger=ledger), "warned")
    return out.withColumn("warned", F.lit(sum(e.count for e in ledger.collect())).cast("bigint"))


@query("SELECT TRUE AS halted, 'o_totalprice > 50000' AS rule")
def validate_halt(spark, d):
    """The first row that breaks the rule ends the action."""
    from millrace.plans.engine import run

    result = run(f'X: open "{d}/orders.parquet" |! o_totalprice > 50000 halt save "{scratch_dir(spark)}/halt-{uuid.uuid4().hex}.csv" ;', spark)
    rule = result.events[-1].message.removeprefix("halted: ")
    return spark.createDataFrame([(result.mode == "halted", rule)], "halted boolean, rule string")


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events WHERE event_id % 7 <> 0")
def dropna(spark, d):
    df = events(spark, d).select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return r.dropna(df, "v", "missing")


@query("SELECT d.doc_id, coalesce(CAST(l.quality AS INTEGER), -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def fill_const(spark, d):
    df = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id", "left")
    return r.fill(df, "quality", -1)


_GAPS = "CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 5 = 0 THEN NULL ELSE event_type END"


def _gaps(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("event_type"))
    return events(spark, d).select("event_id", "user_id", text.alias("et"))


@query(f"""SELECT event_id, user_id, coalesce(last_value(nullif({_GAPS}, '') IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), {_GAPS}) AS et FROM events""")
def fill_ffill(spark, d):
    return r.ffill(_gaps(spark, d), "et", ["event_id"])


@query(f"""SELECT event_id, user_id, coalesce(first_value(nullif({_GAPS}, '') IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), {_GAPS}) AS et FROM events""")
def fill_bfill(spark, d):
    return r.bfill(_gaps(spark, d), "et", ["event_id"])


@query(f"""SELECT event_id, user_id, coalesce(last_value(nullif({_GAPS}, '') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), {_GAPS}) AS et FROM events""")
def fill_ffill_by_user(spark, d):
    return r.ffill(_gaps(spark, d), "et", ["event_id"], ["user_id"])


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)
SELECT event_id, round(coalesce(v, (SELECT avg(v) FROM t)), 4) AS v FROM t""")
def fill_mean(spark, d):
    df = events(spark, d).select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return r.fill_statistic(df, "v", "mean").withColumn("v", F.round("v", 4))


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)
SELECT event_id, round(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM t)), 4) AS v FROM t""")
def fill_median(spark, d):
    df = events(spark, d).select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return r.fill_statistic(df, "v", "median").withColumn("v", F.round("v", 4))


def _described(column: str, kind: str) -> str:
    numbers = f"CAST(min({column}) AS DOUBLE) AS min, CAST(max({column}) AS DOUBLE) AS max, round(avg({column}), 4) AS mean" if kind in ("i64", "f64") else "NULL AS min, NULL AS max, NULL AS mean"
    return f"""SELECT '{column}' AS "column", '{kind}' AS type, count(*) AS count, {numbers} FROM orders"""


_ORDERS = {"o_orderkey": "i64", "o_custkey": "i64", "o_orderstatus": "str", "o_totalprice": "f64", "o_orderdate": "datetime", "o_orderpriority": "str"}


@query(" UNION ALL ".join(_described(c, kind) for c, kind in _ORDERS.items()))
def describe(spark, d):
    out = shape.describe(read(spark, d, "orders"))
    return out.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in ("min", "max", "mean")})


@query("SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings")
def explode(spark, d):
    return shape.explode(read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x")), "x")


def _as_json(spark, d) -> str:
    """Events with their properties as a nested object and a list, as JSON lines in the shared folder."""
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}.jsonl"
    rows = events(spark, d).select("event_id", F.from_json("props", "k bigint").alias("props"), F.array("user_id", "event_id").alias("ids"))
    rows.write.json(path)
    return path


_K = "CAST(json_extract(props, '$.k') AS BIGINT)"


@query("SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[100000] AS DOUBLE) AS missing FROM embeddings")
def list_index(spark, d):
    rows, views = read(spark, d, "embeddings"), {}
    at = lambda i: _compiled(rows, f"embedding[{i}]", views).cast("double")
    return rows.select("vec_id", at(0).alias("first"), at(99999).alias("missing"))


@query(f"SELECT event_id, {_K} AS k, {_K} AS deep, user_id AS first, CAST(NULL AS BIGINT) AS missing FROM events")
def nested_path(spark, d):
    return _flow(spark, d, f'X: open "{_as_json(spark, d)}" |> event_id (props.k) as k ($_..k) as deep (ids[0]) as first (ids[7]) as missing ;')


@query("SELECT event_id, event_id AS item, user_id AS up, event_type FROM events")
def field_forms(spark, d):
    return _flow(spark, d, 'X: open "@/events.parquet" |> event_id (item("event_id")) as item ($_:1.user_id) as up event_type ;')


@query(f"SELECT e.event_id, n.n_name FROM (SELECT event_id, {_K} AS k FROM events) e JOIN nation n ON e.k = n.n_nationkey")
def join_nested_key(spark, d):
    rows = events(spark, d).select("event_id", F.from_json("props", "k bigint").alias("props"))
    return j.join(rows, read(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("nk"), "n_name"), [("props.k", "nk")]).select("event_id", "n_name")


@query("SELECT c_custkey, c_name, CAST(NULL AS BIGINT) AS n_regionkey FROM customer")
def join_absent_side(spark, d):
    """A left join with a side that has no rows keeps that side's columns."""
    text = 'C: open "@/customer.parquet" ; N: open "@/nation.parquet" |? n_nationkey < 0 ; X: C &left N on c_nationkey:n_nationkey |> c_custkey c_name n_regionkey ;'
    return _flow(spark, d, text)


@query("""SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS count FROM events GROUP BY 1""")
def nested_group(spark, d):
    return g.group(events(spark, d).select(F.from_json("props", "k bigint").alias("p")), ["p.k"])


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey FROM orders WHERE o_totalprice > 200000")
def branch_merge(spark, d):
    df = read(spark, d, "orders")
    return r.union(r.where(df, F.col("o_orderpriority") == "1-URGENT").select("o_orderkey"), r.where(df, F.col("o_totalprice") > 200000).select("o_orderkey"))


@query("SELECT n_nationkey AS k, n_name AS name, NULL AS bal FROM nation UNION ALL SELECT s_nationkey, NULL, s_acctbal FROM supplier")
def merge_by_name(spark, d):
    return r.union(read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), read(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("bal")))


# Joins


@query("SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, d):
    return j.join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), [("o_custkey", "c_custkey")])


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_left(spark, d):
    return j.join(read(spark, d, "documents").select("doc_id", "lang"), read(spark, d, "labels"), ["doc_id"], "left")


@query("SELECT n.k, n.n_name, s.s_suppkey FROM (SELECT CASE WHEN n_regionkey < 2 THEN n_nationkey ELSE n_nationkey + 100 END AS k, n_name FROM nation) n RIGHT JOIN supplier s ON n.k = s.s_nationkey".replace("n.k,", "coalesce(n.k, s.s_nationkey) AS k,"))
def join_right(spark, d):
    """Three regions' keys are shifted, so that their suppliers find no nation."""
    nation = read(spark, d, "nation").select(F.when(F.col("n_regionkey") < 2, F.col("n_nationkey")).otherwise(F.col("n_nationkey") + 100).alias("k"), "n_name")
    return j.join(nation, read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), [("k", "s_nationkey")], "right")


@query("SELECT coalesce(a.k, b.doc_id) AS k, a.quality, b.lang FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE -1 - doc_id END AS k, quality FROM labels) a FULL JOIN (SELECT doc_id, lang FROM documents) b ON a.k = b.doc_id")
def join_full(spark, d):
    """Two thirds of the labels' ids are made negative, so that both sides have rows without a match."""
    labels = read(spark, d, "labels").select(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).otherwise(-1 - F.col("doc_id")).alias("k"), "quality")
    return j.join(labels, read(spark, d, "documents").select("doc_id", "lang"), [("k", "doc_id")], "full")


@query("SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, r.l_tax FROM lineitem l JOIN lineitem r ON l.l_orderkey = r.l_orderkey AND l.l_linenumber = r.l_linenumber WHERE r.l_tax > 0.05")
def join_composite(spark, d):
    df = read(spark, d, "lineitem")
    return j.join(df.select("l_orderkey", "l_linenumber", "l_quantity"), df.filter("l_tax > 0.05").select("l_orderkey", "l_linenumber", "l_tax"), ["l_orderkey", "l_linenumber"])


@query("SELECT a.n_nationkey AS k, a.n_name AS name, b.r_name AS name_r FROM nation a JOIN region b ON a.n_regionkey = b.r_regionkey")
def join_clash_suffix(spark, d):
    left = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return j.join(left, read(spark, d, "region").select(F.col("r_regionkey").alias("rk"), F.col("r_name").alias("name")), [("region", "rk")]).drop("region")


@query("SELECT e.event_id, n.n_name FROM (SELECT event_id, CASE WHEN user_id % 4 = 0 THEN NULL ELSE CAST(user_id % 25 AS VARCHAR) END AS k FROM events) e JOIN nation n ON e.k = CAST(n.n_nationkey AS VARCHAR)")
def join_null_and_text_keys(spark, d):
    left = events(spark, d).select("event_id", F.when(F.col("user_id") % 4 != 0, (F.col("user_id") % 25).cast("string")).alias("k"))
    return j.join(left, read(spark, d, "nation").select(F.col("n_nationkey").alias("nk"), "n_name"), [("k", "nk")]).drop("k")


_ASOF = """SELECT l.event_id, l.user_id, {value} AS value_r FROM (SELECT * FROM events WHERE event_type = 'purchase') l
ASOF LEFT JOIN (SELECT user_id, ts, max_by(value, event_id) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2) r ON l.user_id = r.user_id AND l.ts >= r.ts"""


def _asof(spark, d, within=None):
    df = events(spark, d)
    trades, quotes = df.filter("event_type = 'purchase'").select("event_id", "user_id", "ts", "value"), df.filter("event_type = 'click'").select("user_id", "ts", "value", F.col("event_id").alias("quote_id"))
    return j.asof(trades, quotes, ["user_id"], "ts", within, ["quote_id"]).select("event_id", "user_id", "value_r")


@query(_ASOF.format(value="r.value"))
def asof_backward(spark, d):
    return _asof(spark, d)


@query(_ASOF.format(value="CASE WHEN l.ts - r.ts <= INTERVAL 1 HOUR THEN r.value END"))
def asof_within(spark, d):
    return _asof(spark, d, "1h")


@query("""SELECT l.event_id, r.value AS value_r FROM (SELECT * FROM events WHERE event_type = 'purchase') l
ASOF LEFT JOIN (SELECT ts, max_by(value, event_id) AS value FROM events WHERE event_type = 'click' GROUP BY 1) r ON l.ts >= r.ts""")
def asof_without_keys(spark, d):
    df = events(spark, d)
    trades, quotes = df.filter("event_type = 'purchase'").select("event_id", "ts", "value"), df.filter("event_type = 'click'").select("ts", "value", F.col("event_id").alias("quote_id"))
    return j.asof(trades, quotes, [], "ts", None, ["quote_id"]).select("event_id", "value_r")


# Groups


@query("""SELECT l_returnflag, l_linestatus, count(*) AS count, round(sum(l_quantity), 2) AS sum_l_quantity, round(avg(l_extendedprice), 4) AS avg_l_extendedprice,
  min(l_discount) AS min_l_discount, max(l_tax) AS max_l_tax, count(l_partkey) AS count_l_partkey FROM lineitem GROUP BY 1, 2""")
def group_multi(spark, d):
    out = g.group(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], [("sum", "l_quantity"), ("avg", "l_extendedprice"), ("min", "l_discount"), ("max", "l_tax"), ("count", "l_partkey")])
    return out.withColumns({"sum_l_quantity": F.round("sum_l_quantity", 2), "avg_l_extendedprice": F.round("avg_l_extendedprice", 4)})


@query("SELECT o_orderstatus, count(*) AS count, CAST(sum(o_custkey) AS BIGINT) AS sum_o_custkey FROM orders GROUP BY 1")
def group_sum_int(spark, d):
    return g.group(read(spark, d, "orders"), ["o_orderstatus"], [("sum", "o_custkey")])


@query("SELECT event_type, count(*) AS count, count(DISTINCT user_id) AS count_distinct_user_id FROM events GROUP BY 1")
def group_count_distinct(spark, d):
    return g.group(events(spark, d), ["event_type"], [("count_distinct", "user_id")])


@query("SELECT p_brand, count(*) AS count, round(stddev_samp(p_retailprice), 4) AS std_p_retailprice FROM part GROUP BY 1")
def group_std(spark, d):
    return g.group(read(spark, d, "part"), ["p_brand"], [("std", "p_retailprice")]).withColumn("std_p_retailprice", F.round("std_p_retailprice", 4))


@query("SELECT l_returnflag, count(*) AS count, round(quantile_cont(l_extendedprice, 0.5), 4) AS median_l_extendedprice, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90_l_extendedprice FROM lineitem GROUP BY 1")
def group_median_p90(spark, d):
    out = g.group(read(spark, d, "lineitem"), ["l_returnflag"], [("median", "l_extendedprice"), ("p90", "l_extendedprice")])
    return out.withColumns({c: F.round(c, 4) for c in ("median_l_extendedprice", "p90_l_extendedprice")})


@query("SELECT user_id, count(*) AS count, first(event_type ORDER BY ts, event_id) AS first_event_type, last(event_type ORDER BY ts, event_id) AS last_event_type FROM events GROUP BY 1")
def group_first_last(spark, d):
    return g.group(events(spark, d), ["user_id"], [("first", "event_type"), ("last", "event_type")], BY_TIME)


@query("SELECT user_id, count(*) AS count, array_to_string(list(event_type ORDER BY ts, event_id), ',') AS types FROM events GROUP BY 1")
def group_array_agg(spark, d):
    out = g.group(events(spark, d), ["user_id"], [("array_agg", "event_type")], BY_TIME)
    return out.select("user_id", "count", F.array_join("array_agg_event_type", ",").alias("types"))


@query("SELECT CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 3 = 1 THEN '' ELSE event_type END AS k, count(*) AS count, count(CASE WHEN event_id % 7 <> 0 THEN value END) AS count_v FROM events GROUP BY 1")
def group_null_key(spark, d):
    key = F.when(F.col("user_id") % 3 == 0, F.lit(None).cast("string")).when(F.col("user_id") % 3 == 1, "").otherwise(F.col("event_type"))
    return g.group(events(spark, d).select(key.alias("k"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v")), ["k"], [("count", "v")])


@query("""SELECT o_orderstatus, count(*) AS count, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price,
  CAST(max(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS max_price FROM orders GROUP BY 1""")
def group_decimal(spark, d):
    out = g.group(read(spark, d, "orders").select("o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("price")), ["o_orderstatus"], [("sum", "price"), ("max", "price")])
    return out.withColumns({c: F.col(c).cast("double") for c in ("sum_price", "max_price")})


@query("SELECT event_type, count(*) AS count, min(ts) AS min_ts, max(ts) AS max_ts FROM events GROUP BY 1")
def group_min_max_datetime(spark, d):
    return g.group(events(spark, d), ["event_type"], [("min", "ts"), ("max", "ts")])


# Order, distinct


@query("SELECT event_id, v, row_number() OVER (ORDER BY v DESC NULLS FIRST, event_id) - 1 AS place FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)")
def sort_nulls_first(spark, d):
    """The whole table in order, written in parts and read again: each row with the place it has there."""
    df = events(spark, d).select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    parts = materialize(r.sort(df, ("v", "desc"), order_by=["event_id"]).withColumn("at", F.monotonically_increasing_id()), "sorted")
    counts = parts.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    placed = parts.withColumn("part", F.shiftright("at", 33)).join(before, "part")
    return placed.select("event_id", "v", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def take_topk(spark, d):
    return r.take(r.sort(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), ("o_totalprice", "desc"), order_by=["o_orderkey"]), 10)


@query("SELECT event_id, user_id FROM events ORDER BY ts, event_id LIMIT 100")
def take_first(spark, d):
    return r.take(events(spark, d), 100, BY_TIME).select("event_id", "user_id")


@query("SELECT DISTINCT p_brand, p_size FROM part")
def distinct_all(spark, d):
    return r.distinct(read(spark, d, "part").select("p_brand", "p_size"))


@query("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def distinct_by_key(spark, d):
    return r.distinct(events(spark, d), "user_id", order_by=BY_TIME)


# Row windows

_W = "(PARTITION BY user_id ORDER BY ts, event_id)"


def _window(kind: str, column: str, n: int, name: str) -> Query:
    return lambda spark, d: w.with_window(events(spark, d).select("event_id", "user_id", "ts", "value"), name, kind, column, n, ["user_id"], BY_TIME).select("event_id", name)


for _name, _kind, _sql in (
    ("lag", "lag", f"lag(value, 2) OVER {_W}"),
    ("lead", "lead", f"lead(value, 1) OVER {_W}"),
    ("diff", "diff", f"round(value - lag(value, 1) OVER {_W}, 4)"),
    ("pct_change", "pct_change", f"round((value - lag(value) OVER {_W}) / nullif(lag(value) OVER {_W}, 0), 6)"),
):
    _n = 2 if _name == "lag" else 1
    _digits = {"diff": 4, "pct_change": 6}.get(_name)
    _q = _window(_kind, "value", _n, "x")
    QUERIES[_name] = (lambda q, digits: lambda spark, d: q(spark, d).withColumn("x", F.round("x", digits)) if digits else q(spark, d))(_q, _digits)
    ORACLES[_name] = f"SELECT event_id, {_sql} AS x FROM events"

for _of in ("sum", "avg", "min", "max"):
    QUERIES[f"rolling_{_of}"] = (lambda q: lambda spark, d: q(spark, d).withColumn("x", F.round("x", 4)))(_window(f"rolling_{_of}", "value", 5, "x"))
    ORACLES[f"rolling_{_of}"] = f"SELECT event_id, round(CASE WHEN count(*) OVER w = 5 THEN {_of}(value) OVER w END, 4) AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING)"


_ALL = "(ORDER BY ts, event_id)"


@query(f"SELECT event_id, lag(value, 2) OVER {_ALL} AS prev, lead(value) OVER {_ALL} AS next, round(CASE WHEN count(*) OVER w = 4 THEN sum(value) OVER w END, 4) AS s FROM events WINDOW w AS (ORDER BY ts, event_id ROWS 3 PRECEDING)")
def windows_of_all_rows(spark, d):
    """Without keys: one order over the whole table, in blocks."""
    df = events(spark, d).select("event_id", "ts", "value")
    for name, kind, n in (("prev", "lag", 2), ("next", "lead", 1), ("s", "rolling_sum", 4)):
        df = w.with_window(df, name, kind, "value", n, [], BY_TIME)
    return df.select("event_id", "prev", "next", F.round("s", 4).alias("s"))


@query(f"SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER {_W} AS gap FROM events")
def diff_datetime(spark, d):
    out = w.with_window(events(spark, d), "gap", "diff", "ts", 1, ["user_id"], BY_TIME)
    return out.select("event_id", t.interval_us(F.col("gap")).alias("gap"))


_SESSION = """WITH a AS (SELECT user_id, event_id, ts, lag(ts) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT user_id, event_id, ts, last_value(CASE WHEN p IS NULL OR ts - p > INTERVAL 30 MINUTE THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM a) """


@query(_SESSION + "SELECT user_id, event_id, session FROM b")
def session(spark, d):
    return w.with_session(events(spark, d), "session", "ts", "30m", ["user_id"], BY_TIME).select("user_id", "event_id", "session")


@query(_SESSION.replace("PARTITION BY user_id ", "") + "SELECT event_id, session FROM b")
def session_of_all_rows(spark, d):
    return w.with_session(events(spark, d), "session", "ts", "30m", [], BY_TIME).select("event_id", "session")


@query(_SESSION + "SELECT user_id, session, count(*) AS count, max(ts) AS max_ts FROM b GROUP BY 1, 2")
def session_group(spark, d):
    return g.group(w.with_session(events(spark, d), "session", "ts", "30m", ["user_id"], BY_TIME), ["user_id", "session"], [("max", "ts")])


# Time


@query("SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS w, count(*) AS count FROM events GROUP BY 1")
def bucket(spark, d):
    return g.group(events(spark, d).select(t.bucket(F.col("ts"), "15m").alias("w")), ["w"])


@query("SELECT time_bucket(INTERVAL 7 MINUTE, ts, TIMESTAMP '1970-01-01') AS w, count(*) AS count FROM events GROUP BY 1")
def bucket_odd_width(spark, d):
    return g.group(events(spark, d).select(t.bucket(F.col("ts"), "7m").alias("w")), ["w"])


@query("SELECT time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '2024-01-01 00:05:00') AS w, count(*) AS count FROM events GROUP BY 1")
def date_bin_origin(spark, d):
    origin = F.lit("2024-01-01 00:05:00").cast("timestamp_ntz")
    return g.group(events(spark, d).select(t.bucket(F.col("ts"), "15m", origin).alias("w")), ["w"])


@query("""SELECT w, count(*) AS count, round(avg(value), 4) AS avg_value FROM (SELECT value, unnest(generate_series(time_bucket(INTERVAL 1 MINUTE, ts) - INTERVAL 4 MINUTE, time_bucket(INTERVAL 1 MINUTE, ts), INTERVAL 1 MINUTE)) AS w FROM events) GROUP BY 1""")
def hops_group(spark, d):
    return g.hop_group(events(spark, d), "ts", "5m", "1m", [], [("avg", "value")]).withColumn("avg_value", F.round("avg_value", 4))


@query("SELECT event_id, unnest(generate_series(time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 2 HOUR, time_bucket(INTERVAL 1 HOUR, ts), INTERVAL 1 HOUR)) AS w FROM events")
def hops(spark, d):
    return shape.explode(events(spark, d).select("event_id", t.hops(F.col("ts"), "3h", "1h").alias("w")), "w")


@query("SELECT event_id, date_trunc('day', ts) AS day, date_trunc('hour', ts) AS hour, date_trunc('month', ts) AS month, date_trunc('second', ts) AS second FROM events")
def trunc(spark, d):
    return events(spark, d).select("event_id", *[t.trunc(F.col("ts"), u).alias(u) for u in ("day", "hour", "month", "second")])


@query("SELECT event_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, minute(ts) AS minute, second(ts) AS second FROM events")
def extractors(spark, d):
    return events(spark, d).select("event_id", *[t.part(p, F.col("ts")).alias(p) for p in ("year", "month", "day", "hour", "minute", "second")])


@query("SELECT event_id, CAST(isodow(ts) - 1 AS BIGINT) AS wd, isodow(ts) >= 6 AS we FROM events")
def weekday_weekend(spark, d):
    return events(spark, d).select("event_id", t.weekday(F.col("ts")).alias("wd"), t.is_weekend(F.col("ts")).alias("we"))


@query("SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS full, strftime(ts, '%a') AS name, strftime(ts, '%f') AS fraction FROM events")
def format_datetime(spark, d):
    ts = F.col("ts")
    return events(spark, d).select("event_id", t.format_instant(ts, "yyyy/MM/dd HH:mm:ss").alias("full"), t.format_instant(ts, "ddd").alias("name"), t.format_instant(ts, "nnnnnn").alias("fraction"))


@query("SELECT event_id, CAST(ts AS DATE) AS day, strftime(ts, '%H:%M:%S') AS tod FROM events")
def date_time_parts(spark, d):
    return events(spark, d).select("event_id", t.date_of(F.col("ts")).alias("day"), t.time_of(F.col("ts")).alias("tod"))


@query("SELECT event_id, date_trunc('second', ts) AS ts FROM events")
def parse_datetime(spark, d):
    text = F.date_format("ts", "yyMMddHHmmss")
    return events(spark, d).select("event_id", t.parse_instant(text, "yyMMddHHmmss").alias("ts"))


@query("SELECT event_id, date_trunc('second', ts) + INTERVAL 90 MINUTE AS later, epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS since, (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 3600000000.0 AS hours FROM events")
def temporal_algebra(spark, d):
    span = F.col("ts") - t.trunc(F.col("ts"), "day")
    return events(spark, d).select("event_id", (t.trunc(F.col("ts"), "second") + t.parse_span(F.lit("01:30:00"))).alias("later"), t.interval_us(span).alias("since"), (t.interval_us(span) / 3600000000.0).alias("hours"))


@query("SELECT event_type, count(*) AS count, sum(us) AS sum_us FROM (SELECT event_type, epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS us FROM events) GROUP BY 1".replace("sum(us)", "CAST(sum(us) AS BIGINT)"))
def group_duration(spark, d):
    out = g.group(events(spark, d).select("event_type", (F.col("ts") - t.trunc(F.col("ts"), "day")).alias("span")), ["event_type"], [("sum", "span")])
    return out.select("event_type", "count", t.interval_us(F.col("sum_span")).alias("sum_us"))


# Scalar functions


@query("""SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, length(p_type) AS len, substr(p_name, 3, 4) AS sub, substr(p_name, 1, 2) AS head,
  replace(p_type, ' ', '_') AS rep, concat(p_brand, '/', p_size) AS cat, trim('  ' || p_brand || ' ') AS tri FROM part""")
def str_functions(spark, d):
    n, b, k = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return read(spark, d, "part").select(
        "p_partkey", s.upper(n).alias("up"), s.lower(b).alias("low"), s.length(k).alias("len"), s.substr(n, F.lit(3), F.lit(4)).alias("sub"), s.substr(n, F.lit(-1), F.lit(2)).alias("head"),
        s.replace(k, F.lit(" "), F.lit("_")).alias("rep"), s.concat(b, F.lit("/"), F.col("p_size")).alias("cat"), s.trim(F.concat(F.lit("  "), b, F.lit(" "))).alias("tri"),
    )


@query("SELECT doc_id, contains(text, 'the ') AS has, starts_with(text, 'Th') AS begins, ends_with(text, '.') AS ends FROM documents")
def str_predicates(spark, d):
    x = F.col("text")
    return read(spark, d, "documents").select("doc_id", s.contains(x, F.lit("the ")).alias("has"), s.starts_with(x, F.lit("Th")).alias("begins"), s.ends_with(x, F.lit(".")).alias("ends"))


@query("SELECT p_partkey, p_name LIKE '%a_e%' AS lk, regexp_full_match(p_name, '(?s)[a-m].*') AS gl, regexp_matches(p_brand, '#[1-3][0-9]$') AS re FROM part")
def like_glob_regex(spark, d):
    n = F.col("p_name")
    return read(spark, d, "part").select("p_partkey", s.like(n, "%a_e%").alias("lk"), s.glob(n, "[a-m]*").alias("gl"), s.matches(F.col("p_brand"), "#[1-3][0-9]$").alias("re"))


@query("SELECT page_id, split_part(url, '/', 3) AS host, split_part(url, '/', -1) AS last, split_part(url, '/', 99) AS none FROM pages")
def split_part(spark, d):
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", *[s.split_part(u, F.lit("/"), F.lit(n)).alias(a) for n, a in ((3, "host"), (-1, "last"), (99, "none"))])


@query(r"SELECT page_id, regexp_extract(url, '([^/\\]*)$', 1) AS base, regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '^(.+)\.[^.]*$', '\1') AS st, regexp_replace(url, '[/\\][^/\\]*$', '') AS dir, regexp_extract(url, '^([a-z]+)://', 1) AS scheme FROM pages")
def path_functions(spark, d):
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", s.basename(u).alias("base"), s.stem(u).alias("st"), s.dirname(u).alias("dir"), s.scheme(u).alias("scheme"))


@query("SELECT event_id, abs(value - 50) AS a, CAST(round(value) AS BIGINT) AS r, CAST(floor(value) AS BIGINT) AS f, CAST(ceil(value) AS BIGINT) AS c FROM events")
def num_functions(spark, d):
    v = F.col("value")
    return events(spark, d).select("event_id", s.whole("abs", v - 50).alias("a"), s.whole("round", v).alias("r"), s.whole("floor", v).alias("f"), s.whole("ceil", v).alias("c"))


@query("SELECT d.doc_id, CAST(coalesce(l.quality, l.toxic, -1) AS BIGINT) AS q FROM documents d LEFT JOIN labels l USING (doc_id)")
def coalesce(spark, d):
    return _flow(spark, d, 'D: open "@/documents.parquet" ; L: open "@/labels.parquet" ; X: D &left L on doc_id |> doc_id (coalesce(quality, toxic, -1)) as q ;')


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE CAST(round(CAST(o_totalprice AS DECIMAL(38,9)), 2) AS DECIMAL(18,2)) >= 150000.25")
def decimal_literal(spark, d):
    out = _flow(spark, d, 'X: open "@/orders.parquet" cast o_totalprice:decimal(2) |? o_totalprice >= 150000.25 |> o_orderkey o_totalprice ;')
    return out.withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@query(r"SELECT page_id, url AS handle, url AS cast_url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme FROM pages")
def resource(spark, d):
    out = _flow(spark, d, 'X: open "@/pages.parquet" |> page_id (resource(url)) as handle (url:resource) as cast_url ;')
    return out.withColumn("scheme", s.scheme(F.col("handle")))


@query("SELECT k, count(*) AS count, sum(v) AS sum_v, avg(v) AS avg_v, min(v) AS min_v, count(v) AS count_v FROM (SELECT event_type AS k, CASE WHEN event_type <> 'click' THEN CAST(user_id AS BIGINT) END AS v FROM events) GROUP BY 1".replace("sum(v)", "CAST(sum(v) AS BIGINT)").replace("avg(v)", "round(avg(v), 4)"))
def group_all_null(spark, d):
    """One group has no value at all."""
    rows = events(spark, d).select(F.col("event_type").alias("k"), F.when(F.col("event_type") != "click", F.col("user_id")).alias("v"))
    return g.group(rows, ["k"], [("sum", "v"), ("avg", "v"), ("min", "v"), ("count", "v")]).withColumn("avg_v", F.round("avg_v", 4))


# Whole flows


@query("""SELECT l_returnflag, l_linestatus, count(*) AS count, CAST(sum(l_linenumber) AS BIGINT) AS sum_l_linenumber, round(avg(l_quantity), 4) AS avg_l_quantity,
  round(quantile_cont(l_extendedprice, 0.9), 4) AS p90_l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_discount <= 0.07 GROUP BY 1, 2""")
def flagship(spark, d):
    kept = r.where(read(spark, d, "lineitem"), F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"), F.col("l_discount") <= 0.07)
    out = g.group(kept, ["l_returnflag", "l_linestatus"], [("sum", "l_linenumber"), ("avg", "l_quantity"), ("p90", "l_extendedprice")])
    return out.withColumns({c: F.round(c, 4) for c in ("avg_l_quantity", "p90_l_extendedprice")})


@query("""SELECT c_mktsegment, o_orderpriority, count(*) AS count, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'F' GROUP BY 1, 2""")
def filter_join_group(spark, d):
    orders = r.where(read(spark, d, "orders"), F.col("o_orderstatus") == "F").select("o_custkey", "o_orderpriority", "o_totalprice")
    joined = j.join(orders, read(spark, d, "customer").select("c_custkey", "c_mktsegment"), [("o_custkey", "c_custkey")])
    return g.group(joined, ["c_mktsegment", "o_orderpriority"], [("sum", "o_totalprice")]).withColumn("sum_o_totalprice", F.round("sum_o_totalprice", 2))


# The same through the language, and through files


def _compiled(df: DataFrame, expression: str, views: dict) -> Column:
    from millrace.plans.engine import _expression
    from millrace.plans.expressions import Compiler

    return Compiler(df, views)(_expression(expression))[0]


def _flow(spark: SparkSession, d: str, program: str, label: str = "X") -> DataFrame:
    from millrace.plans.engine import run

    return run(program.replace("@", d), spark, write=False).outputs[label]


@query("""SELECT o_orderpriority, count(*) AS count, CAST(sum(o_custkey) AS BIGINT) AS sum_o_custkey, count(DISTINCT o_custkey) AS count_distinct_o_custkey
FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'P' GROUP BY 1""")
def flow_filter_group(spark, d):
    return _flow(spark, d, 'X: open "@/orders.parquet" |? o_totalprice >= 100000, o_orderstatus != "P" |# o_orderpriority sum:o_custkey count_distinct:o_custkey ;')


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS band, year(o_orderdate) AS y,
  upper(o_orderstatus) || '-' || CAST(o_custkey AS VARCHAR) AS tag, o_custkey % 10 AS last, o_custkey / 4 AS q FROM orders WHERE (o_custkey * 2 + 1) > 500""")
def flow_expressions(spark, d):
    return _flow(spark, d, """X: open "@/orders.parquet" |? (o_custkey * 2 + 1) > 500
        |> o_orderkey (case when o_totalprice > 300000 then "big" when o_totalprice > 100000 then "mid" else "small" end) as band (year(o_orderdate)) as y
           (concat(upper(o_orderstatus), "-", o_custkey)) as tag (o_custkey % 10) as last (o_custkey / 4) as q ;""")  # fmt: skip


@query("""SELECT c_mktsegment, n_name, count(*) AS count, max(c_acctbal) AS max_c_acctbal FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def flow_join_group(spark, d):
    return _flow(spark, d, 'C: open "@/customer.parquet" ; N: open "@/nation.parquet" ; X: C &left N on c_nationkey:n_nationkey |# c_mktsegment n_name max:c_acctbal ;')


@query("""SELECT l.event_id, CASE WHEN l.ts - r.ts <= INTERVAL 2 HOUR THEN r.quote END AS quote FROM (SELECT * FROM events WHERE event_type = 'purchase') l
ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS quote FROM events WHERE event_type = 'click' GROUP BY 1, 2) r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def flow_asof(spark, d):
    return _flow(spark, d, """E: open "@/events.parquet" ; P: E |? event_type == "purchase" |> event_id user_id ts ;
        Q: E |? event_type == "click" |# user_id ts max:value |> user_id ts max_value :quote ; X: P &asof Q on user_id by ts within "2h" |> event_id quote ;""")  # fmt: skip


@query(f"SELECT event_id, lag(value) OVER {_W} AS prev, round(CASE WHEN count(*) OVER w = 3 THEN avg(value) OVER w END, 4) AS ma FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING)")
def flow_windows(spark, d):
    out = _flow(spark, d, 'X: open "@/events.parquet" sort ts event_id |> * (lag(value) over user_id) as prev (rolling_avg(value, 3) over user_id) as ma |> event_id prev ma ;')
    return out.withColumn("ma", F.round("ma", 4))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS h, event_type, count(*) AS count FROM events WHERE ts >= TIMESTAMP '2024-01-02' GROUP BY 1, 2")
def flow_bucket(spark, d):
    return _flow(spark, d, 'X: open "@/events.parquet" |? ts >= "2024-01-02" |> (bucket(ts, "1h")) as h event_type |# h event_type ;')


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal >= 1000 AND s_acctbal <= 6000")
def flow_holes(spark, d):
    return _flow(spark, d, 'R: open "@/supplier.parquet" |? s_acctbal >= $low, s_acctbal <= $high |> s_suppkey s_acctbal ; X: open "@/supplier.parquet" | R low=1000 high=6000 ;')


@query("SELECT n_name FROM nation WHERE n_regionkey = 0 UNION ALL SELECT n_name FROM nation WHERE n_nationkey < 5")
def flow_branch_merge(spark, d):
    return _flow(spark, d, 'N: open "@/nation.parquet" -> A: |? n_regionkey == 0 ; -> B: |? n_nationkey < 5 ; ; X: A + B |> n_name ;')


@query("SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, n_name FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name DESC) AS k FROM nation) WHERE k = 1")
def flow_sort_distinct(spark, d):
    return _flow(spark, d, 'X: open "@/nation.parquet" sort n_name desc distinct n_regionkey |> n_regionkey n_name ;')


def _round_trip(fmt: str, **options) -> Query:
    """Supplier written as ``fmt`` into the shared folder and read again, types inferred."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        from millrace.sources import sinks, text

        path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}.{fmt}"
        df = read(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_name")).alias("s_name"), "s_acctbal")
        sinks.save(df, path, fmt, **options)
        if fmt in ("csv", "tsv"):
            return text.read_csv(spark, path, sep="\t" if fmt == "tsv" else ",")
        return text.read_parquet(spark, path) if fmt == "parquet" else text.read_json(spark, path)

    return run


for _fmt in ("csv", "tsv", "json", "jsonl", "parquet"):
    QUERIES[f"round_trip_{_fmt}"] = _round_trip(_fmt)
    ORACLES[f"round_trip_{_fmt}"] = "SELECT s_suppkey, CASE WHEN s_suppkey % 7 <> 0 THEN s_name END AS s_name, s_acctbal FROM supplier"
QUERIES["round_trip_csv_parts"] = _round_trip("csv", single=False)
ORACLES["round_trip_csv_parts"] = ORACLES["round_trip_csv"]


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def partitioned_save_and_read(spark, d):
    """Files by region, found again by ``ls`` and united by ``read``."""
    return _routed(spark, read(spark, d, "nation"), "hive")


_NATION = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"


def _routed(spark, df: DataFrame, layout: str) -> DataFrame:
    from millrace.sources import files, sinks

    folder = f"{scratch_dir(spark)}/{uuid.uuid4().hex}".removeprefix("file://")
    if layout == "template":
        sinks.save_template(df, f"{folder}/r{{n_regionkey}}/{{n_name}}.csv", lambda e: F.substring(F.col(e).cast("string"), 1, 1))
    else:
        sinks.save_by(df, folder, {"n_regionkey": F.col("n_regionkey")}, layout=layout)
    return files.read(files.ls(spark, f"{folder}/**/*.csv"), "path", "csv")


@query(_NATION)
def save_flat(spark, d):
    return _routed(spark, read(spark, d, "nation"), "flat")


@query(_NATION)
def save_template(spark, d):
    return _routed(spark, read(spark, d, "nation"), "template")


def _put(spark: SparkSession, name: str, data: bytes) -> str:
    """Bytes as a file in the shared folder."""
    from io import BytesIO

    from millrace.sources import files

    return files.piped(spark, BytesIO(data), name)


def _nation_lines(spark, d, sep: str = ",") -> list[str]:
    rows = read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()
    return [sep.join(map(str, r)) for r in rows]


_LINES = "SELECT CAST(n_nationkey AS BIGINT) AS c0, n_name AS c1, CAST(n_regionkey AS BIGINT) AS c2 FROM nation"


@query(_LINES)
def open_noheader(spark, d):
    path = _put(spark, "csv", "\n".join(_nation_lines(spark, d)).encode())
    return _flow(spark, d, f'X: open "{path}" noheader ;')


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CAST(n_regionkey AS DOUBLE) AS region FROM nation")
def open_declared(spark, d):
    path = _put(spark, "tsv", "\n".join(["x\ty\tz", *_nation_lines(spark, d, "\t")]).encode())
    return _flow(spark, d, f'X: open "{path}" (id:str name region:float) ;')


@query("SELECT event_id, date_trunc('second', ts) AS at FROM events")
def open_datetime_format(spark, d):
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}.csv"
    events(spark, d).select("event_id", F.date_format("ts", "yyMMddHHmmss").alias("at")).write.csv(path, header=True)
    return _flow(spark, d, f'X: open "{path}" (event_id:int at:datetime("yyMMddHHmmss")) ;')


@query("SELECT event_id, user_id FROM events")
def open_gzip(spark, d):
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}.csv"
    events(spark, d).select("event_id", "user_id").write.csv(path, header=True, compression="gzip")
    return _flow(spark, d, f'X: open "{path}/*.csv.gz" ;')


@query(_LINES)
def open_zstd(spark, d):
    import pyarrow as pa

    data = pa.compress("\n".join(_nation_lines(spark, d)).encode(), "zstd", asbytes=True)
    return _flow(spark, d, f'X: open "{_put(spark, "csv.zst", data)}" noheader ;')


@query(_LINES)
def open_stdin(spark, d):
    import io
    import sys
    from unittest import mock

    with mock.patch.object(sys, "stdin", io.TextIOWrapper(io.BytesIO("\n".join(_nation_lines(spark, d)).encode()))):
        return _flow(spark, d, "X: open stdin as csv noheader ;")


@query(_LINES)
def open_web(spark, d):
    import http.server
    import threading

    body = "\n".join(_nation_lines(spark, d)).encode()

    class Page(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        return _flow(spark, d, f'X: open "http://127.0.0.1:{server.server_address[1]}/n.csv" noheader ;')
    finally:
        server.shutdown()


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, 'n_regionkey=' || n_regionkey AS folder, 'file' AS scheme, TRUE AS same FROM nation")
def open_with_filename(spark, d):
    from millrace.sources import sinks

    folder = f"{scratch_dir(spark)}/{uuid.uuid4().hex}".removeprefix("file://")
    sinks.save_by(read(spark, d, "nation"), folder, {"n_regionkey": F.col("n_regionkey")})
    out = _flow(spark, d, f'X: open "{folder}/*/*.csv" as csv with filename |> n_nationkey filename (source.uri) as uri (source.scheme) as scheme ;')
    return out.select("n_nationkey", F.element_at(F.split("filename", "/"), -2).alias("folder"), F.coalesce(F.nullif("scheme", F.lit("")), F.lit("file")).alias("scheme"), (F.col("filename") == F.col("uri")).alias("same"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def watch_files(spark, d):
    """A stream of files that ends by take, each read as it comes."""
    folder = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    read(spark, d, "nation").select("n_nationkey", "n_name").repartition(3, "n_nationkey").write.csv(folder, header=True)
    n = spark.read.format("binaryFile").load(f"{folder}/*.csv").count()
    return _flow(spark, d, f'X: watch "{folder.removeprefix("file://")}/*.csv" take {n} read as csv ;')


@query("SELECT '' AS value WHERE FALSE")
def stream_stub(spark, d):
    return _flow(spark, d, "X: stream nothing ;")


@query("SELECT range AS id, printf('person-%05d', range) AS name FROM range(5000)")
def generated(spark, d):
    from millrace.sources.generate import generate

    path = _put(spark, "csv", "\n".join(generate("clean", 5000)).encode())
    return _flow(spark, d, f'X: open "{path}" |> id name ;')


@query("SELECT n_nationkey || ',' || n_name AS line FROM nation UNION ALL SELECT 'n_nationkey,n_name'")
def save_stdout(spark, d):
    import contextlib
    import io

    from millrace.plans.engine import run

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        run(f'X: open "{d}/nation.parquet" |> n_nationkey n_name save stdout as csv ;', spark)
    return spark.createDataFrame([(x,) for x in out.getvalue().splitlines()], "line string")


_REFUSED = {
    "parquet sink": ('X: open "@/nation.parquet" save "x.parquet" ;', "parquet"),
    "blocking step of a stream": ('X: watch "/x/*.csv" sort name ;', "unbounded"),
    "unknown scope": ("X: Nothing ;", "isn't defined"),
    "unknown column": ("X: open a.csv (id:int) |? idd > 1 ;", "unknown column"),
    "route hook": ('X: open a.csv on error severity >= error: route "b.csv" ; ;', "route"),
    "retired spelling": ("X: open a.csv limit 3 ;", "retired"),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', TRUE)" for k in _REFUSED) + ") AS v(program, refused)")
def refusals(spark, d):
    """Programs that are refused before anything runs, each with its reason."""
    from millrace.plans.engine import run
    from millrace.plans.ir import FlowError

    def refused(text: str, reason: str) -> bool:
        try:
            run(text.replace("@", d), spark)
        except FlowError as e:
            return reason in str(e)
        return False

    return spark.createDataFrame([(name, refused(*case)) for name, case in _REFUSED.items()], "program string, refused boolean")


@query("SELECT TRUE AS printed, TRUE AS literate, count(*) AS rows FROM nation WHERE n_regionkey = 1")
def program_forms(spark, d):
    """A program printed, parsed again, and taken from a document gives the same plan."""
    from millrace.plans.engine import run
    from millrace.plans.ir import to_source
    from millrace.plans.literate import flow_of
    from millrace.plans.parser import parse

    text = f'A: open "{d}/nation.parquet" ; X: A! |? n_regionkey == 1 ;'
    program = parse(text)
    document = f"# Title\n\n```flow\n{text}\n```\n"
    rows = run(parse(to_source(program)), spark, write=False).outputs["X"]
    return rows.agg(F.lit(parse(to_source(program)) == program).alias("printed"), F.lit(parse(flow_of(document)) == program).alias("literate"), F.count(F.lit(1)).alias("rows"))


@query("SELECT 'degraded' AS mode, count(*) FILTER (o_totalprice <= 50000) AS lost FROM orders")
def hooks(spark, d):
    """A hook changes the run's mode once rows have been lost."""
    from millrace.plans.engine import run

    text = f'X: open "{d}/orders.parquet" |! o_totalprice > 50000 reject on error severity >= error: transition degraded ; save "{scratch_dir(spark)}/{uuid.uuid4().hex}.csv" ;'
    result = run(text, spark)
    lost = sum(e.count for e in result.events)
    return spark.createDataFrame([(result.mode, lost)], "mode string, lost bigint")


@query("SELECT 'X' AS scope, 'source' AS step, count(*) AS rows FROM orders UNION ALL SELECT 'X', 'filter', count(*) FROM orders WHERE o_totalprice > 50000 UNION ALL SELECT 'X', 'project', count(*) FROM orders WHERE o_totalprice > 50000")
def telemetry(spark, d):
    from millrace.plans.engine import run

    result = run(f'X: open "{d}/orders.parquet" |? o_totalprice > 50000 |> o_orderkey ;', spark, write=False, telemetry=True)
    materialize(result.outputs["X"], "counted")
    return spark.createDataFrame(result.telemetry, "scope string, step string, rows bigint")


_WINDOWS = {
    "stream_tumbling": ("tumbling", ("1 hour",), "time_bucket(INTERVAL 1 HOUR, ts)"),
    "stream_sliding": ("sliding", ("2 hours", "1 hour"), "unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR])"),
}


def _streamed(name: str, kind: str, sizes: tuple[str, ...]) -> Query:
    """The table as a stream of its files, windowed in the stream, and what the sink has at its end."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        from millrace.streaming import windows

        rows = spark.readStream.schema(events(spark, d).schema).parquet(f"{d}/events.parq*")
        out = getattr(windows, kind)(rows, "ts", *sizes, ["event_type"], [F.count(F.lit(1)).alias("n")], lateness=None)
        table = f"{name}_{uuid.uuid4().hex}"
        out.writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", f"{scratch_dir(spark)}/{table}").trigger(availableNow=True).start().awaitTermination()
        return spark.table(table)

    return run


for _name, (_kind, _sizes, _sql) in _WINDOWS.items():
    QUERIES[_name] = _streamed(_name, _kind, _sizes)
    ORACLES[_name] = f"SELECT window_start, event_type, count(*) AS n FROM (SELECT {_sql} AS window_start, event_type FROM events) GROUP BY ALL"


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS DOUBLE) / 2 AS half, n_regionkey > 1 AS big FROM nation")
def binary_records(spark, d):
    """Fixed-width records written by the byte and decoded."""
    import struct

    from millrace.sources import files

    rows = read(spark, d, "nation").select("n_nationkey", "n_regionkey").collect()
    path = _put(spark, "bin", b"".join(struct.pack("<idB", k, r / 2, r > 1) for k, r in rows))
    return files.read_binary(spark, path, [("id", "i32"), ("half", "f64"), ("big", "bool")])
