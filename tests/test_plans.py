"""Plans: what reaches the reader, what is shuffled, and that Python stays out of hot paths."""

import os
import re

import pytest
from pyspark.sql import functions as F

from millrace import queries as q
from millrace.operators import rows as r

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def plan(spark, df):
    return df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_and_columns_reach_the_reader(spark):
    for name in ("filter_comma", "flow_filter_group", "flagship"):
        text = plan(spark, q.QUERIES[name](spark, DATA))
        pushed = re.search(r"PushedFilters: \[(.*)\]", text)[1]
        assert "GreaterThanOrEqual" in pushed, name
        assert "l_comment" not in text and len(re.search(r"ReadSchema: struct<(.*)>", text)[1].split(",")) <= 7, name


def test_top_k_keeps_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(spark, q.QUERIES["take_topk"](spark, DATA))


def test_no_python_in_relational_operators(spark):
    for name in q.QUERIES:
        if name != "binary_records":
            text = plan(spark, q.QUERIES[name](spark, DATA))
            assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|MapInArrow|FlatMapGroups", text), name


def test_no_cartesian_products(spark):
    for name in q.QUERIES:
        assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan(spark, q.QUERIES[name](spark, DATA))), name


def test_groups_are_reduced_before_the_shuffle(spark):
    text = plan(spark, q.QUERIES["group_multi"](spark, DATA))
    assert text.count("HashAggregate") >= 2 and text.count("Exchange") == 2  # in the tree and in the details


def test_asof_shuffles_once(spark):
    tree = plan(spark, q.QUERIES["asof_backward"](spark, DATA)).split("\n\n")[0]
    assert tree.count("Exchange") == 1 and "Join" not in tree


def test_filter_is_two_valued(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "a int")
    assert r.where(df, F.col("a") != 1).count() == 1
    assert r.where(df, (F.col("a") > 5) | (F.col("a") == 3)).count() == 1
