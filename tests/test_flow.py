"""Flow programs, end to end on small files."""

import pytest

from millrace.plans.engine import run
from millrace.plans.ir import FlowError, to_source
from millrace.plans.parser import parse

USERS = "name,age,country\naki,31,JP\nbob,17,US\nchie,45,JP\ndora,,DE\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "users.csv").write_text(USERS)
    return tmp_path


def rows(result, name):
    return [tuple(r) for r in result.outputs[name].collect()]


def flow(spark, folder, text, name="X", **more):
    return rows(run(text, spark, str(folder), **more), name)


def test_filter_project(spark, folder):
    assert flow(spark, folder, "X: open users.csv |? age >= 18, country == \"JP\" |> name (age * 2) as twice ;") == [("aki", 62), ("chie", 90)]


def test_null_comparison_is_false(spark, folder):
    assert flow(spark, folder, "X: open users.csv |? age != 31 |> name ;") == [("bob",), ("chie",)]


def test_group_order_and_names(spark, folder):
    assert flow(spark, folder, "X: open users.csv |# country sum:age count:age ;") == [("DE", 1, None, 0), ("JP", 2, 76, 2), ("US", 1, 17, 1)]


def test_first_last_array(spark, folder):
    assert flow(spark, folder, "X: open users.csv |# country first:name last:name array_agg:name ;")[1] == ("JP", 2, "aki", "chie", ["aki", "chie"])


def test_sort_take_distinct(spark, folder):
    assert flow(spark, folder, "X: open users.csv sort age desc take 2 |> name ;") == [("dora",), ("chie",)]
    assert flow(spark, folder, "X: open users.csv distinct country |> name ;") == [("aki",), ("bob",), ("dora",)]


def test_branch_and_merge(spark, folder):
    text = "U: open users.csv -> A: |? age >= 20 ; -> B: |? age < 20 ; ; X: B + A |> name ;"
    assert flow(spark, folder, text) == [("bob",), ("aki",), ("chie",)]


def test_joins(spark, folder):
    (folder / "orders.csv").write_text("user,amount,age\naki,5,1\nzed,7,2\naki,6,3\n")
    head = "U: open users.csv ; O: open orders.csv ; X: U "
    assert sorted(flow(spark, folder, head + "& O on name:user |> name amount age_r ;")) == [("aki", 5, 1), ("aki", 6, 3)]
    assert ("zed", 7) in flow(spark, folder, head + "&right O on name:user |> name amount ;")
    assert len(flow(spark, folder, head + "&full O on name:user ;")) == 6
    assert ("bob", None) in flow(spark, folder, head + "&left O on name:user |> name amount ;")


def test_asof(spark, folder):
    (folder / "q.csv").write_text("sym,ts,bid\na,2024-01-01T10:00:00,1\na,2024-01-01T10:05:00,2\nb,2024-01-01T09:00:00,9\n")
    (folder / "t.csv").write_text("sym,ts,px\na,2024-01-01T09:59:00,10\na,2024-01-01T10:05:00,11\na,2024-01-01T10:20:00,12\nb,2024-01-01T09:05:00,13\n")
    head = "Q: open q.csv ; T: open t.csv ; X: T &asof Q on sym by ts "
    assert [r[-1] for r in flow(spark, folder, head + ";")] == [None, 2, 2, 9]
    assert [r[-1] for r in flow(spark, folder, head + 'within "5m" ;')] == [None, 2, None, 9]


def test_windows(spark, folder):
    (folder / "p.csv").write_text("g,v\na,1\nb,10\na,2\na,4\nb,5\n")
    text = "X: open p.csv |> * (lag(v) over g) as prev (rolling_sum(v, 2) over g) as s (lead(v) over g) as n (pct_change(v) over g) as pc ;"
    assert flow(spark, folder, text) == [("a", 1, None, None, 2, None), ("b", 10, None, None, 5, None), ("a", 2, 1, 3, 4, 1.0), ("a", 4, 2, 6, None, 1.0), ("b", 5, 10, 15, None, -0.5)]


def test_session(spark, folder):
    (folder / "s.csv").write_text("ts,u\n2024-01-01T10:00:00,a\n2024-01-01T10:30:00,a\n2024-01-01T11:00:01,a\n")
    found = flow(spark, folder, 'X: open s.csv |> * (session(ts, "30m") over u) as s |# s ;')
    assert [r[1] for r in found] == [2, 1]


def test_fills(spark, folder):
    (folder / "f.csv").write_text("id,c,n\n1,x,1\n2,,\n3,y,4\n4,,\n")
    assert [r[1] for r in flow(spark, folder, "X: open f.csv fill c ffill ;")] == ["x", "x", "y", "y"]
    assert [r[1] for r in flow(spark, folder, "X: open f.csv fill c bfill ;")] == ["x", "y", "y", None]
    assert [r[2] for r in flow(spark, folder, "X: open f.csv fill n mean ;")] == [1.0, 2.5, 4.0, 2.5]
    assert [r[2] for r in flow(spark, folder, "X: open f.csv fill n 0 ;")] == [1, 0, 4, 0]
    assert len(flow(spark, folder, "X: open f.csv dropna ;")) == 2


def test_bad_rows_are_counted(spark, folder):
    (folder / "m.csv").write_text("id,n\n1,2\nbroken\n3,x\n4,5\n")
    result = run("X: open m.csv (id:int n:int) on error severity >= error: transition degraded ; ;", spark, str(folder))
    assert rows(result, "X") == [(1, 2), (3, None), (4, 5)]
    assert {e.count for e in result.events} == {1} and len(result.events) == 2
    assert result.mode == "degraded"


def test_contracts(spark, folder):
    result = run("X: open users.csv |! { age >= 18 reject; age <= 40 warn } |> name ;", spark, str(folder))
    assert rows(result, "X") == [("aki",), ("chie",)]
    assert sorted(e.count for e in result.events) == [1, 2]
    halted = run('X: open users.csv |! age >= 18 halt save "out.csv" ;', spark, str(folder))
    assert halted.mode == "halted" and not (folder / "out.csv").exists()


def test_quotes_and_nulls_round_trip(spark, folder):
    (folder / "n.csv").write_text('a,b\n,""\n"x ""y"", z",k\n')
    run("X: open n.csv save again.csv ;", spark, str(folder))
    assert (folder / "again.csv").read_text() == 'a,b\n,""\n"x ""y"", z",k\n'


def test_json_in_and_out(spark, folder):
    (folder / "j.jsonl").write_text('{"id":1,"user":{"age":5},"tags":[1,2]}\n{"id":2,"user":null,"tags":[]}\nnonsense\n')
    assert flow(spark, folder, "X: open j.jsonl |> id (user.age) as age (tags[0]) as t ($_..age) as deep ;") == [(1, 5, 1, 5), (2, None, None, None)]
    assert flow(spark, folder, "X: open j.jsonl explode tags |> id tags ;") == [(1, 1), (1, 2)]
    run("X: open users.csv |> name age save u.jsonl ; Y: open users.csv |> age save u.json ;", spark, str(folder))
    assert (folder / "u.jsonl").read_text().splitlines()[3] == '{"name":"dora","age":null}'
    import json

    assert json.loads((folder / "u.json").read_text()) == [{"age": 31}, {"age": 17}, {"age": 45}, {"age": None}]
    assert flow(spark, folder, "X: open u.json ;") == [(31,), (17,), (45,), (None,)]


def test_partitioned_saves(spark, folder):
    run('X: open users.csv save "hive/" by country ; Y: open users.csv save "flat/{country}-{substr(name, 1, 1)}.csv" ;', spark, str(folder))
    assert (folder / "hive/country=JP/part.csv").read_text() == "name,age,country\naki,31,JP\nchie,45,JP\n"
    assert sorted(p.name for p in (folder / "flat").iterdir() if p.suffix == ".csv") == ["DE-d.csv", "JP-a.csv", "JP-c.csv", "US-b.csv"]


def test_discovery_and_read(spark, folder):
    (folder / "d").mkdir()
    (folder / "d/a.csv").write_text("id,x\n1,2\n")
    (folder / "d/b.csv").write_text("id,y\n2.5,z\n")
    (folder / "d/c.txt").write_text("no")
    text = f'X: ls "{folder}/d/*.csv" |? size > 0 read as csv with source |> id x y (source.scheme) as s ;'
    assert flow(spark, folder, text) == [(1.0, 2, None, "file"), (2.5, None, "z", "file")]


def test_binary(spark, folder):
    import struct

    (folder / "r.bin").write_bytes(b"".join(struct.pack("<iid4sB", i, i * 10, i / 2, b"ab\0\0", i % 2) for i in range(5)))
    found = flow(spark, folder, "X: open r.bin as bin (id:i32 age:i32 score:f64 tag:char[4] active:bool) |? id >= 3 ;")
    assert found == [(3, 30, 1.5, "ab\0\0", True), (4, 40, 2.0, "ab\0\0", False)]


def test_reuse_and_holes(spark, folder):
    text = "A: open users.csv |? age >= $min |> name age ; X: open users.csv | A min=20 |# age ;"
    assert [r[0] for r in flow(spark, folder, text)] == [31, 45]
    unbound = run("X: open users.csv |? age >= $min ;", spark, str(folder))
    assert rows(unbound, "X") == [] and any("min" in e.message for e in unbound.events)


def test_case_cast_functions(spark, folder):
    text = 'X: open users.csv |> (case when age >= 40 then "old" when age >= 18 then "adult" end) as band (upper(name)) as u (age:str) as t (coalesce(age, 0)) as a (name ~ \'^[ab]\') as ab (age % 2) as m (10 / 4) as q ;'
    assert flow(spark, folder, text)[0] == ("adult", "AKI", "31", 31, True, 1, 2.5)
    assert flow(spark, folder, text)[3][0] == ""


def test_describe_rename_views(spark, folder):
    assert flow(spark, folder, "X: open users.csv describe ;")[1][:5] == ("age", "i64", 4, "17", "45")
    assert run("X: open users.csv rename age years drop country reorder years ;", spark, str(folder)).outputs["X"].columns == ["years", "name"]
    assert flow(spark, folder, "X: open users.csv |> name :str :{ a@0..2 b@2..4 } |> (name.a) as a (name.b) as b ;")[0] == ("ak", None)


def test_datetimes(spark, folder):
    (folder / "t.csv").write_text("a,b\n690101000000,2024-06-03\n681231235959,2024-02-30\nbad,2024-01-01\n")
    found = flow(spark, folder, 'X: open t.csv (a:datetime("yyMMddHHmmss") b:date) |> (year(a)) as y b (format(a, "yyyy/MM/dd ddd")) as f ;')
    assert [r[0] for r in found] == [1969, 2068, None] and found[0][2] == "1969/01/01 Wed" and found[1][1] is None
    spans = flow(spark, folder, 'X: open t.csv (a:datetime("yyMMddHHmmss") b:date) |> (format(a - a)) as z ;')
    assert spans[0] == ("00:00:00",)


def test_refusals(spark, folder):
    for text in (
        "X: open users.csv limit 3 ;", "X: open users.csv |! age > 1 ;", "X: open users.csv |# ;", "X: open users.csv |> (nofunc(age)) as x ;", "X: Y ;", 'X: watch "in/*" sort a ;',
        "X: open a.csv (id:int) |? idd > 1 ;", 'X: open users.csv save "o/{name}.csv" by age ;', "", "X: open users.csv |# a p101:b ;", "X: open a.csv |> (ts:datetime(\"yy\")) as t ;",
    ):
        with pytest.raises(FlowError):
            run(text, spark, str(folder))


def test_print_round_trip():
    text = 'A: open "a b.csv" noheader (id:int t:datetime("yy")) # note\n |? ((a + 1) * 2) > 3, b == "x" or c < 1 |! { a > 1 warn; b > 2 reject } |> a :b :int (case when a > 1 then 2 else 3 end) as z sort a desc b take 3 ;'
    program = parse(text)
    source = to_source(program)
    assert parse(source) == program and to_source(parse(source)) == source and "# note" in source


def test_invariance(spark, folder):
    text = "X: open users.csv |> * (lag(age) over country) as p |# country sum:age first:name sort sum_age desc ;"
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n, adaptive in (("1", "true"), ("7", "false"), ("16", "true")):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        seen.add(tuple(flow(spark, folder, text)))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(seen) == 1


def test_compressed_sources(spark, folder):
    import gzip

    import pyarrow as pa

    with gzip.open(folder / "u.csv.gz", "wt") as f:
        f.write(USERS)
    with pa.CompressedOutputStream(str(folder / "u.csv.zst"), "zstd") as f:
        f.write(USERS.encode())
    for name in ("u.csv.gz", "u.csv.zst"):
        assert len(flow(spark, folder, f"X: open {name} |? age > 20 ;")) == 2


def test_headers_tsv_bom_and_schema(spark, folder):
    (folder / "b.tsv").write_bytes("﻿a\tb\n1\tx\n".encode())
    assert run("X: open b.tsv ;", spark, str(folder)).outputs["X"].columns == ["a", "b"]
    (folder / "h.csv").write_text("1,2\n3,4\n")
    assert flow(spark, folder, "X: open h.csv noheader |> c1 ;") == [(2,), (4,)]
    assert flow(spark, folder, "X: open h.csv noheader (p:int q:float) |> ($_[1]) as q ;") == [(2.0,), (4.0,)]
    warned = run("X: open h.csv (p:int q:int) ;", spark, str(folder))
    assert len(rows(warned, "X")) == 1 and any("noheader" in e.message for e in warned.events)


def test_quarantine_and_filename(spark, folder):
    (folder / "list.csv").write_text(f"filepath\n{folder}/users.csv\n{folder}/gone.csv\n")
    result = run("X: open list.csv |> (resource(filepath)) as path read as csv with filename |> name filename ;", spark, str(folder))
    assert len(rows(result, "X")) == 4 and rows(result, "X")[0][1].endswith("users.csv")
    assert any("gone.csv" in e.message for e in result.events)


def test_decimals_are_exact(spark, folder):
    (folder / "d.csv").write_text("g,a\nx,0.1\nx,0.2\nx,2.345\n")
    found = run("X: open d.csv (g a:decimal(2)) |? a >= 0.1 |# g sum:a avg:a ;", spark, str(folder)).outputs["X"].first()
    assert str(found.sum_a) == "2.64" and str(found.avg_a) == "0.88000000"


def test_stdout_and_hooks(spark, folder, capsys):
    run('X: open users.csv |? age > 40 save - as json ; Y: open users.csv |> name sort name desc take 1 save stdout as csv ;', spark, str(folder))
    assert capsys.readouterr().out == '[\n{"name":"chie","age":45,"country":"JP"}\n]\nname\ndora\n'
    logged = run('X: ls "nothing/*.csv" on error severity >= warning: log "seen" ; ;', spark, str(folder))
    assert [e.message for e in logged.events][-1] == "seen"


def test_fractions_keep_their_digits(spark, folder):
    (folder / "w.csv").write_text("a\n0.123456789012345678\n0.123456789012345679\n")
    assert len(flow(spark, folder, "X: open w.csv (a:decimal(18)) |? a > 0.123456789012345678 ;")) == 1
    source = "X: open w.csv (a:decimal(18)) |? a > 0.123456789012345678 ;"
    assert "0.123456789012345678" in to_source(parse(source)) and parse(to_source(parse(source))) == parse(source)


def test_rows_of_several_files_name_their_own(spark, folder):
    (folder / "p1.csv").write_text("a\n1\n")
    (folder / "p2.csv").write_text("a\n2\n")
    found = flow(spark, folder, f'X: open "{folder}/p*.csv" with filename |> a filename (source.uri) as u ;')
    assert sorted(found) == [(i, f"{folder}/p{i}.csv", f"{folder}/p{i}.csv") for i in (1, 2)]
    assert flow(spark, folder, "X: open p1.csv with filename ;") == [(1, "p1.csv")]


def test_zstd_over_a_glob(spark, folder):
    import pyarrow as pa

    for i in range(3):
        with pa.CompressedOutputStream(str(folder / f"z{i}.csv.zst"), "zstd") as f:
            f.write(USERS.encode() * 1)
    assert len(flow(spark, folder, 'X: open "z*.csv.zst" |? age > 20 ;')) == 6


def test_json_arrays_of_long_objects(spark, folder):
    import json

    (folder / "l.json").write_text(json.dumps([{"z": "x" * 100_000, "b": 1, "a": 2}, {"a": 3, "more": 1}]))
    result = run("X: open l.json |> b a ; Y: open l.json ;", spark, str(folder))
    assert result.outputs["Y"].columns == ["z", "b", "a"] and rows(result, "X") == [(1, 2), (None, 3)]
    assert any("more" in e.message for e in result.events)


def test_telemetry(spark, folder):
    result = run("X: open users.csv |? age > 20 |> name take 1 ;", spark, str(folder), telemetry=True)
    result.outputs["X"].collect()
    assert result.telemetry[0] == ("X", "source", 4) and [s for _, s, _ in result.telemetry] == ["source", "filter", "project", "take"]


def test_gate_follows_names(spark, folder):
    good = "X: open a.csv (id:int v:float) |> id (v * 2) as w rename id key |? key > 1, w > 2 |# key sum:w |? sum_w > 3 ;"
    from millrace.plans.engine import check

    check(parse(good))
    for bad in (good.replace("key > 1", "id > 1"), good.replace("sum_w", "sum_v"), good.replace("w > 2", "v > 2")):
        with pytest.raises(FlowError):
            check(parse(bad))


def test_binary_of_many_records(spark, folder):
    import struct

    (folder / "big.bin").write_bytes(b"".join(struct.pack("<qf", i, i / 4) for i in range(20_011)))
    result = run("X: open big.bin as bin (id:i64 v:f32) ;", spark, str(folder)).outputs["X"]
    assert result.selectExpr("count(*)", "sum(id)", "sum(v)").first() == (20_011, sum(range(20_011)), sum(range(20_011)) / 4)


def test_files_of_one_form_share_a_reader(spark, folder):
    (folder / "m").mkdir()
    for i in range(6):
        (folder / f"m/{i}.jsonl").write_text(f'{{"a":{i},"b":{i}.5}}\n{{"a":{i}}}\n' if i % 2 else f'{{"b":{i},"c":"x"}}\n')
        spark.createDataFrame([(i, "p")], "a bigint, d string").coalesce(1).write.parquet(f"file://{folder}/q{i}")
        next((folder / f"q{i}").glob("part-*")).rename(folder / f"m/{i}.parquet")
    (folder / "m/z.jsonl").write_text("nonsense\n")
    result = run(f'X: ls "{folder}/m/*.*" read with source |> a b c d (source.uri) as u ;', spark).outputs["X"]
    got = result.collect()
    assert len(got) == 3 * 2 + 3 + 6 and sorted(r.a for r in got if r.d) == list(range(6)) and {r.b for r in got if r.c} == {0.0, 2.0, 4.0}
    assert all(r.u.startswith(str(folder)) for r in got)
    tree = result._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("Relation [") <= 4
