"""Flows run by another machine: their text goes there, what they print comes back.

``serve`` answers from its own Spark session, one flow at a time; paths are those of the serving
machine. Peers have to be on the loopback interface or listed in MILLRACE_HOSTS, on both sides.
The channel is plain HTTP: beyond one machine, put it on a protected network.
"""

from __future__ import annotations

import http.client
import ipaddress
import json
import socket
import sys
from collections.abc import Callable
from contextlib import redirect_stderr, redirect_stdout
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import urlsplit

from millrace.streaming.sources import NotAllowed, _listed

#: Not a type that a browser sends to another site without asking it first.
CONTENT = "application/x-millrace-flow"
LONGEST = 16 << 20
OPTIONS = ("json", "telemetry", "parts", "preview")


def allow_peer(host: str) -> None:
    """Unlike a host that is only read from, a peer that isn't this machine has to be listed."""
    host = host.lower().strip("[]")
    try:
        own = ipaddress.ip_address(host).is_loopback
    except ValueError:
        own = host == "localhost"
    if not own and host not in {h.lower() for h in _listed("MILLRACE_HOSTS")}:
        raise NotAllowed(f"{host} is neither this machine nor among MILLRACE_HOSTS")


def address(text: str) -> tuple[str, int]:
    host, _, port = text.removeprefix("http://").rstrip("/").rpartition(":")
    if not host or not port.isdigit():
        raise ValueError(f"expected host:port, found {text}")
    return host.strip("[]"), int(port)


class _Lines:
    """A text stream whose pieces become lines of a chunked answer; a slow reader holds the flow back."""

    def __init__(self, out, name: str):
        self.out, self.name = out, name

    def write(self, text: str) -> int:
        if text:
            _chunk(self.out, {self.name: text})
        return len(text)

    def flush(self) -> None:
        self.out.flush()


def _chunk(out, message: dict) -> None:
    line = json.dumps(message).encode() + b"\n"
    out.write(f"{len(line):x}\r\n".encode() + line + b"\r\n")


def server(bind: str, execute: Callable[[str, dict], int]) -> HTTPServer:
    """A server that isn't running yet; ``execute`` takes a flow's text and options and gives the exit code."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"
        timeout = 60

        def refuse(self, code: int, why: str) -> None:
            self.close_connection = True
            body = why.encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self) -> None:
            try:
                allow_peer(self.client_address[0])
                allow_peer(urlsplit(f"//{self.headers.get('Host', '')}").hostname or "")
            except (NotAllowed, ValueError) as e:
                return self.refuse(403, str(e))
            length = self.headers.get("Content-Length", "")
            if self.path != "/run" or self.headers.get("Content-Type") != CONTENT or not length.isdigit() or int(length) > LONGEST:
                return self.refuse(400, f"expected POST /run of {CONTENT}, of at most {LONGEST} bytes")
            try:
                job = json.loads(self.rfile.read(int(length)))
                flow, options = str(job["flow"]), {k: v for k, v in job.get("options", {}).items() if k in OPTIONS}
            except (ValueError, KeyError, TypeError, AttributeError) as e:
                return self.refuse(400, f"not a job: {e}")
            self.close_connection = True
            # Only a request has to come in time: a reader may pause as long as it lives.
            self.connection.settimeout(None)
            self.connection.setsockopt(socket.SOL_SOCKET, socket.SO_KEEPALIVE, 1)
            self.send_response(200)
            self.send_header("Transfer-Encoding", "chunked")
            self.end_headers()
            with redirect_stdout(_Lines(self.wfile, "out")), redirect_stderr(_Lines(self.wfile, "err")):
                try:
                    code = execute(flow, options)
                except ConnectionError:
                    raise
                except Exception as e:  # the session lives on for the next flow
                    print(f"error: {e}", file=sys.stderr)
                    code = 2
            _chunk(self.wfile, {"exit": code})
            self.wfile.write(b"0\r\n\r\n")

        def log_message(self, form: str, *args) -> None:
            pass

    class Server(HTTPServer):
        address_family = socket.AF_INET6 if ":" in address(bind)[0] else socket.AF_INET

    allow_peer(address(bind)[0])
    return Server(address(bind), Handler)


def run_on(peer: str, flow: str, options: dict) -> int:
    """Have ``peer`` run a flow; print what it prints and return its exit code."""
    host, port = address(peer)
    allow_peer(host)
    link = http.client.HTTPConnection(host, port)
    try:
        link.request("POST", "/run", json.dumps({"flow": flow, "options": options}), {"Content-Type": CONTENT})
        answer = link.getresponse()
        if answer.status != 200:
            print(f"error: {peer}: {answer.read().decode(errors='replace')}", file=sys.stderr)
            return 2
        while line := answer.readline():
            message = json.loads(line)
            if "exit" in message:
                return message["exit"]
            sys.stdout.write(message.get("out", ""))
            sys.stderr.write(message.get("err", ""))
        raise ConnectionError("the answer ends before the flow's end")
    except (OSError, http.client.HTTPException) as e:
        print(f"error: {peer}: {e}", file=sys.stderr)
        return 2
    finally:
        link.close()
