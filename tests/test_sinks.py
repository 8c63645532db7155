"""Sinks keep every row, whatever the session's limits, and split hot keys."""

import json
import os

import pytest
from pyspark.sql import functions as F

from millrace.sources import files, sinks, text


@pytest.fixture
def small_files(spark):
    """A session that writes ten rows a file and splits partitions of a few KB."""
    settings = {"spark.sql.files.maxRecordsPerFile": "10", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2048"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


def rows(spark, n=1000):
    return spark.range(n).select("id", (F.col("id") % 2).alias("k"), F.when(F.col("id") % 50 != 0, F.lit("a/b")).alias("t"), F.repeat(F.col("id").cast("string"), 20).alias("x")).repartition(6)


@pytest.mark.parametrize("fmt", ["csv", "tsv", "json", "jsonl", "parquet"])
@pytest.mark.parametrize("single", [True, False])
def test_save_keeps_all_rows(spark, small_files, tmp_path, fmt, single):
    path = f"{tmp_path}/out.{fmt}"
    sinks.save(rows(spark), path, fmt, single=single)
    assert os.path.isfile(path) == single
    parts = [path] if single else [f"{path}/{p}" for p in os.listdir(path) if p.startswith("part-")]
    if fmt == "json":
        assert sorted(r["id"] for p in parts for r in json.load(open(p))) == list(range(1000))
    else:
        df = spark.read.parquet(*parts) if fmt == "parquet" else spark.read.json(parts) if fmt == "jsonl" else spark.read.csv(parts, header=True, sep="\t" if fmt == "tsv" else ",")
        assert sorted(int(r.id) for r in df.select("id").collect()) == list(range(1000))


@pytest.mark.parametrize("fmt", ["csv", "jsonl"])
@pytest.mark.parametrize("layout", ["hive", "flat", "template"])
def test_routed_files_keep_all_rows_and_split_hot_keys(spark, small_files, tmp_path, layout, fmt):
    df = rows(spark, 20_000).withColumn("k", F.when(F.col("id") < 15_000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)))
    out = str(tmp_path / "out")
    for _ in range(2):  # a second run replaces the files of the first
        if layout == "template":
            names = sinks.save_template(df, f"{out}/{{k}}.{fmt}", lambda e: F.col(e), fmt)
        else:
            names = sinks.save_by(df, out, {"k": F.col("k")}, fmt, layout)
    there = [os.path.relpath(os.path.join(d, f), out) for d, _, fs in os.walk(out) for f in fs if not f.startswith(".")]
    assert sorted(there) == names and sum("hot" in n for n in names) > 1
    paths = [f"{out}/{n}" for n in names]
    found = spark.read.json(paths) if fmt == "jsonl" else spark.read.csv(paths, header=True)
    assert found.count() == 20_000 and found.select("id").distinct().count() == 20_000
    assert files.ls(spark, f"{out}/**").count() == len(names)


def test_empty_output(spark, tmp_path):
    none = spark.createDataFrame([], "a bigint, b string")
    for fmt in ("csv", "tsv", "json", "jsonl"):
        sinks.save(none, f"{tmp_path}/e.{fmt}", fmt)
    assert open(f"{tmp_path}/e.csv").read().split() == ["a,b"] and json.load(open(f"{tmp_path}/e.json")) == [] and open(f"{tmp_path}/e.jsonl").read() == ""
    assert text.read_csv(spark, f"{tmp_path}/e.csv").count() == 0


def test_values_that_look_like_parts_do_not_clash(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a=00001", 2), ("a-1", 3), ("{x}[1]", 4)], "k string, v int")
    names = sinks.save_by(df, str(tmp_path / "o"), {"k": F.col("k")}, "csv", "flat")
    assert len(names) == 4 and sorted(open(f"{tmp_path}/o/{n}").read().split()[1][-1] for n in names) == ["1", "2", "3", "4"]
