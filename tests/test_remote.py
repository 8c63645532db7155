"""Flows sent to a serving process."""

import http.client
import json
import os
import subprocess
import sys
import threading

import pytest

from millrace import cli, remote
from millrace.streaming.sources import NotAllowed


@pytest.fixture()
def peer(spark, monkeypatch):
    monkeypatch.delenv("MILLRACE_HOSTS", raising=False)
    with remote.server("127.0.0.1:0", lambda flow, options: cli.remote_flow(spark, flow, options)) as listening:
        thread = threading.Thread(target=listening.serve_forever, daemon=True)
        thread.start()
        yield f"127.0.0.1:{listening.server_port}"
        listening.shutdown()
        thread.join(10)


def send(peer, *args):
    """The command line in a process of its own, which has no Spark."""
    folder = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "PYTHONPATH": folder, "JAVA_HOME": "/nonexistent", "SPARK_HOME": "/nonexistent"}
    return subprocess.run([sys.executable, "-m", "millrace", "run", "--on", peer, *args], env=env, capture_output=True, text=True, timeout=120)


def test_remote_run_prints_what_a_local_one_does(spark, peer, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("user,n\n" + "".join(f"u{i % 3},{i}\n" for i in range(90)) + "u1,x\n")
    flow = f"A: open {tmp_path}/a.csv (user:str n:int) |? n >= 0 |# user sum:n sort user ;"
    code = cli.remote_flow(spark, flow, {"json": True})
    local = capsys.readouterr()
    assert code == 0 and "u0" in local.out and "sum_n" in local.out
    sent = send(peer, "--json", "-c", flow)
    assert sent.returncode == 0 and sent.stdout == local.out
    assert json.loads(sent.stderr.splitlines()[-1])["summary"] and any("count" in json.loads(x) for x in sent.stderr.splitlines())


def test_remote_sinks_stream_and_halts_reach_the_caller(peer, tmp_path):
    (tmp_path / "a.csv").write_text("n\n" + "".join(f"{i}\n" for i in range(5000)))
    sent = send(peer, "-c", f"A: open {tmp_path}/a.csv |? n < 4000 save stdout as csv ;")
    assert sent.returncode == 0 and sent.stdout.splitlines()[:4001] == ["n", *map(str, range(4000))]
    assert send(peer, "-c", f"A: open {tmp_path}/a.csv |! n < 9 halt ;").returncode == 3


def test_remote_errors_leave_the_server_serving(peer, tmp_path):
    (tmp_path / "a.csv").write_text("n\n1\n")
    wrong = send(peer, "-c", f"A: open {tmp_path}/a.csv (n:int) |? m > 1 ;")
    assert wrong.returncode == 2 and "unknown column m" in wrong.stderr
    piped = send(peer, "|? n > 0")
    assert piped.returncode == 2 and "standard input" in piped.stderr
    assert send(peer, "-c", f"A: open {tmp_path}/a.csv ;").returncode == 0


def test_peers_have_to_be_allowed(peer, monkeypatch, capsys):
    for host in ("localhost", "127.0.0.1", "::1"):
        remote.allow_peer(host)
    for host in ("example.org", "10.0.0.1", ""):
        with pytest.raises(NotAllowed):
            remote.allow_peer(host)
    monkeypatch.setenv("MILLRACE_HOSTS", "example.org")
    remote.allow_peer("example.org")
    with pytest.raises(NotAllowed):
        remote.allow_peer("example.org.evil")
    assert cli.main(["run", "--on", "10.0.0.1:9001", "-c", "A: open a.csv ;"]) == 2
    assert "MILLRACE_HOSTS" in capsys.readouterr().err
    with pytest.raises(NotAllowed):
        remote.server("0.0.0.0:0", lambda flow, options: 0)
    with pytest.raises(ValueError):
        remote.address("nowhere")
    assert remote.address("http://[::1]:9001/") == ("::1", 9001)
    assert cli.main(["run", "--on", "127.0.0.1:1", "-c", "A: open a.csv ;"]) == 2
    assert "127.0.0.1:1" in capsys.readouterr().err
    assert cli.main(["fmt", "absent/flow.txt"]) == 2


def test_a_reader_that_leaves_ends_its_flow_only(peer, tmp_path):
    (tmp_path / "a.csv").write_text("n\n" + "".join(f"{i}\n" for i in range(200_000)))
    flow = f"A: open {tmp_path}/a.csv save stdout as csv ;"
    link = http.client.HTTPConnection(peer)
    link.request("POST", "/run", json.dumps({"flow": flow}), {"Content-Type": remote.CONTENT})
    answer = link.getresponse()
    assert json.loads(answer.readline()) == {"out": "n\n"}
    answer.close()
    link.close()
    assert send(peer, "-c", f"A: open {tmp_path}/a.csv |? n < 5 ;").returncode == 0


@pytest.mark.parametrize(
    "path, headers, body, status",
    [
        ("/run", {"Content-Type": "text/plain"}, "{}", 400),
        ("/run", {"Content-Type": remote.CONTENT}, "[]", 400),
        ("/run", {"Content-Type": remote.CONTENT}, "{", 400),
        ("/", {"Content-Type": remote.CONTENT}, "{}", 400),
        ("/run", {"Content-Type": remote.CONTENT, "Host": "evil.example:80"}, "{}", 403),
        ("/run", {"Content-Type": remote.CONTENT, "Host": "evil.example"}, "{}", 403),
        ("/run", {"Content-Type": remote.CONTENT, "Host": "localhost"}, "{}", 400),
    ],
)
def test_other_requests_are_refused(peer, path, headers, body, status):
    link = http.client.HTTPConnection(peer)
    link.request("POST", path, body, headers)
    assert link.getresponse().status == status
    link.close()
