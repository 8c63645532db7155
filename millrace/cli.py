"""Command line: run, explain, check, fmt, gen, serve."""

from __future__ import annotations

import argparse
import json
import os
import sys

from millrace.plans.ir import FlowError, to_source
from millrace.plans.literate import flow_of, mermaid
from millrace.plans.parser import parse, transform_only
from millrace.sources.generate import generate


def _program(args: argparse.Namespace) -> tuple[str, str]:
    """The program's text, and the folder that its paths are relative to."""
    if args.command_text is not None:
        return args.command_text, os.getcwd()
    if args.program in ("-", "stdin"):
        return sys.stdin.read(), os.getcwd()
    if not os.path.exists(args.program) and ("|" in args.program or " " in args.program):
        return args.program, os.getcwd()
    with open(args.program, encoding="utf-8-sig") as f:
        text = f.read()
    return (flow_of(text) if args.program.endswith(".md") else text), os.getcwd()


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] not in ("run", "explain", "check", "fmt", "gen", "serve", "-h", "--help"):
        argv.insert(0, "run")
    parser = argparse.ArgumentParser(prog="millrace")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for name in ("run", "explain", "check", "fmt"):
        sub = verbs.add_parser(name)
        sub.add_argument("program", nargs="?", default="-")
        sub.add_argument("-c", "--command", dest="command_text")
        sub.add_argument("--json", action="store_true")
        sub.add_argument("--master")
        sub.add_argument("--telemetry", action="store_true", help="report the rows that leave each step")
        sub.add_argument("--parts", action="store_true", help="let every task write its own part file")
        sub.add_argument("-w", "--write", action="store_true")
        for ignored in ("--chunk-size", "--memory"):
            sub.add_argument(ignored, help="accepted; Spark decides")
        sub.add_argument("--no-opt", action="store_true", help="accepted; Catalyst always optimises")
        sub.add_argument("--preview", type=int, default=20)
        if name == "run":
            sub.add_argument("--on", metavar="HOST:PORT", help="let a machine that serves run the flow")
    serve = verbs.add_parser("serve")
    serve.add_argument("--bind", default="127.0.0.1:9001")
    serve.add_argument("--master")
    gen = verbs.add_parser("gen")
    gen.add_argument("shape")
    gen.add_argument("--rows", type=int, default=1000)
    gen.add_argument("--seed", type=int, default=42)
    gen.add_argument("--ratio", type=float, default=0.1)
    args = parser.parse_args(argv)
    try:
        if args.verb == "gen":
            for line in generate(args.shape, args.rows, args.seed, args.ratio):
                print(line)
            return 0
        if args.verb == "serve":
            return _serve(args)
        text, base = _program(args)
        if args.verb == "run" and transform_only(text):
            text = f"Main: open stdin {text} save stdout as csv ;"
        program = parse(text)
        if args.verb == "check":
            from millrace.plans.engine import check

            check(program)
            print("ok", file=sys.stderr)
            return 0
        if args.verb == "fmt":
            source = to_source(program)
            if parse(source) != program:
                print("this program can't be printed without loss", file=sys.stderr)
                return 1
            if args.write:
                with open(args.program, "w", encoding="utf-8") as f:
                    f.write(source)
            else:
                print(source, end="")
            return 0
        if args.verb == "run" and args.on:
            from millrace.remote import run_on

            return run_on(args.on, to_source(program), {"json": args.json, "telemetry": args.telemetry, "parts": args.parts, "preview": args.preview})
        return _execute(args, program, base, _session(args))
    except (FlowError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def _session(args: argparse.Namespace):
    from millrace.session import session

    spark = session(args.master or os.environ.get("SPARK_MASTER") or "local[*]", **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _serve(args: argparse.Namespace) -> int:
    from millrace.remote import server

    spark = _session(args)

    with server(args.bind, lambda flow, options: remote_flow(spark, flow, options)) as listening:
        print(f"serving on {args.bind}", file=sys.stderr)
        try:
            listening.serve_forever()
        except KeyboardInterrupt:
            pass
    return 0


def remote_flow(spark, flow: str, options: dict) -> int:
    """Run a flow that another machine sent; standard input doesn't travel with it."""
    program = parse(flow)
    if any(scope.head.op == "open" and scope.head.args["path"] in ("-", "stdin") for scope in program.scopes):
        raise FlowError("a remote flow can't open standard input")
    asked = {"json": False, "telemetry": False, "parts": False, "preview": 20} | options
    return _execute(argparse.Namespace(verb="run", **asked), program, os.getcwd(), spark)


def _execute(args: argparse.Namespace, program, base: str, spark) -> int:
    from millrace.plans.engine import halted, run

    result = run(program, spark, base, write=args.verb == "run", single=False if args.parts else None, telemetry=args.telemetry)
    if args.verb == "explain":
        print(to_source(program))
        print(mermaid(program))
        for name, df in result.outputs.items():
            print(f"-- {name}")
            df.explain("formatted")
        return 0
    for name in result.leaves:
        try:
            result.outputs[name].show(args.preview, truncate=False)
        except Exception as e:
            if not halted(e, name, result.ledger):
                raise
    for e in result.events:
        line = {"severity": e.severity.name.lower(), "scope": e.scope, "message": e.message, "count": e.count}
        print(json.dumps(line) if args.json else f"[{line['severity']}] {e.scope}: {e.message}", file=sys.stderr)
    for scope, step, count in result.telemetry:
        print(json.dumps({"scope": scope, "step": step, "rows": count}) if args.json else f"{scope} {step}: {count} row(s)", file=sys.stderr)
    if args.json:
        print(json.dumps({"summary": True, "mode": result.mode, "scopes": sorted(result.outputs)}), file=sys.stderr)
    return 3 if result.mode == "halted" else 0
