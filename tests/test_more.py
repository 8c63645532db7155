"""Generators, streams, literate documents and the command line."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from millrace.plans.literate import flow_of, mermaid
from millrace.plans.parser import parse, transform_only
from millrace.sources.generate import generate
from millrace.streaming import sources, windows


def test_generate_is_seeded():
    a = list(generate("error-heavy", 500, 3, 0.2))
    assert a == list(generate("error-heavy", 500, 3, 0.2)) and a != list(generate("error-heavy", 500, 4, 0.2))
    bad = [x for x in a[1:] if x.count(",") != 5]
    assert 50 < len(bad) < 150
    with pytest.raises(ValueError):
        list(generate("other"))


def test_literate():
    text = "# Title\n```flow\nX: open a.csv\n```\nwords\n```python\nno\n```\n```flow\n |? a > 1 ;\n```\n"
    program = parse(flow_of(text))
    assert [s.op for s in program.scopes[0].steps] == ["filter"]
    assert "X[" in mermaid(program)


def test_transform_only():
    assert transform_only("|? a > 1") and transform_only("sort a") and not transform_only("X: open a.csv ;")


def test_windows_on_a_stream_equal_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [f"{i % 3},2024-01-01 00:{i // 60:02d}:{i % 60:02d},{i}" for i in range(600)]
    (tmp_path / "in/a.csv").write_text("\n".join(lines[:300]) + "\n")
    (tmp_path / "in/b.csv").write_text("\n".join(lines[300:]) + "\n")
    schema = "k int, ts timestamp_ntz, v int"
    own = lambda df: windows.sliding(df, "ts", "2 minutes", "1 minute", ["k"], [F.sum("v").alias("s")])
    batch = sorted(map(tuple, own(spark.read.schema(schema).csv(str(tmp_path / "in"))).collect()))
    stream = own(sources.read_stream(spark, str(tmp_path / "in"), schema, maxFilesPerTrigger="1"))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("w").collect())) == batch
    assert windows.sessions(spark.read.schema(schema).csv(str(tmp_path / "in")), "ts", "1 minute", ["k"], [F.count("v").alias("n")]).count() == 3


def test_watch_ends_by_take(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / f"in/{i}.csv").write_text("a\n1\n")
    (tmp_path / "in/no.txt").write_text("x")
    seen = []
    n = sources.take(sources.watch(spark, f"{tmp_path}/in/*.csv"), 3, lambda df: seen.extend(r.name for r in df.collect()), str(tmp_path / "cp"))
    assert n == 3 and len(seen) == 3 and all(x.endswith(".csv") for x in seen)


def test_watch_is_confined(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("MILLRACE_WATCH_PATHS", "/allowed")
    with pytest.raises(PermissionError):
        sources.watch(spark, f"{tmp_path}/*.csv")


def test_allowlists_take_whole_names(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("MILLRACE_WATCH_PATHS", str(tmp_path / "in"))
    monkeypatch.setenv("MILLRACE_HOSTS", "example.org")
    for name in ("in", "inner"):
        (tmp_path / name).mkdir()
    sources.watch(spark, f"{tmp_path}/in/*.csv")
    for path in (f"{tmp_path}/inner/*.csv", f"{tmp_path}/in/../inner/*.csv"):
        with pytest.raises(PermissionError):
            sources.watch(spark, path)
    for url in ("tcp://example.org.evil:1", "tcp://sub.example.org:1"):
        with pytest.raises(PermissionError):
            sources.subscribe(spark, url)


def test_subscribe_in_a_flow(spark):
    import socket
    import threading

    from millrace.plans.engine import run

    for fmt, lines in (("csv", b"1,x\nbad,y\n"), ("tsv", b"1\tx\nbad\ty\n"), ("json", b'{"a":"1","b":"x"}\n{"a":"bad","b":"y"}\n')):
        server = socket.create_server(("127.0.0.1", 0))

        def serve(server=server, lines=lines):
            client, _ = server.accept()
            with client:
                client.sendall(lines)
                threading.Event().wait(8)

        threading.Thread(target=serve, daemon=True).start()
        out = run(f'X: subscribe "tcp://127.0.0.1:{server.getsockname()[1]}" as {fmt} (a:int b) take 2 ;', spark).outputs["X"]
        assert sorted(map(tuple, out.collect()), key=str) == [(1, "x"), (None, "y")]


def test_command_line(tmp_path):
    program = tmp_path / "p.flow"
    program.write_text("X:   open a.csv |? a >= 1 # why\n ;")
    run = lambda *a, stdin=None: subprocess.run([sys.executable, "-m", "millrace", *a], capture_output=True, text=True, input=stdin, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = run("fmt", str(program))
    assert out.returncode == 0 and parse(out.stdout) == parse(program.read_text()) and "# why" in out.stdout
    assert run("check", "-c", "X: nothing").returncode == 2
    assert run("check", "-c", "X: open a.csv (id:int) |? idd > 1 ;").returncode == 2 and run("check", "-c", "X: open a.csv (id:int) |? id > 1 ;").returncode == 0
    assert len(run("gen", "clean", "--rows", "5").stdout.splitlines()) == 6


def test_watch_flow(spark, tmp_path):
    from millrace.plans.engine import run

    (tmp_path / "in").mkdir()
    for i in range(4):
        (tmp_path / f"in/{i}.csv").write_text(f"a\n{i}\n")
    out = run(f'X: watch "{tmp_path}/in/*.csv" take 4 read as csv |# a ; Y: watch "{tmp_path}/in/*.csv" |> name save "{tmp_path}/names" as csv ;', spark)
    assert sorted(r.a for r in out.outputs["X"].collect()) == [0, 1, 2, 3]
    assert spark.read.csv(f"{tmp_path}/names", header=True).count() == 4


def test_fetch(spark, tmp_path, monkeypatch):
    import functools
    import http.server
    import threading

    from millrace.plans.engine import run

    (tmp_path / "a.csv").write_text("a\n1\n2\n")
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    program = f'X: open "http://127.0.0.1:{server.server_address[1]}/a.csv" |? a > 1 ;'
    assert [r.a for r in run(program, spark).outputs["X"].collect()] == [2]
    monkeypatch.setenv("MILLRACE_HOSTS", "example.com")
    with pytest.raises(PermissionError):
        run(program, spark)
    server.shutdown()


def test_subscribe(spark, tmp_path):
    import socket
    import threading

    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        client, _ = server.accept()
        with client:
            client.sendall(b"1,x\n2,y\n")
            threading.Event().wait(8)

    threading.Thread(target=serve, daemon=True).start()
    seen = []
    stream = sources.subscribe(spark, f"tcp://127.0.0.1:{server.getsockname()[1]}", "a int, b string")
    assert sources.take(stream, 2, lambda df: seen.extend(map(tuple, df.collect())), str(tmp_path / "cp")) == 2
    assert sorted(seen) == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError):
        sources.subscribe(spark, "udp://x")
