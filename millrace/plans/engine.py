"""Runs programs: checks the plan, compiles scopes to DataFrames, writes the sinks."""

from __future__ import annotations

import difflib
import re
import sys
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.events import Event, Ledger, Severity
from millrace.operators import group as g
from millrace.operators import join as j
from millrace.operators import rows as r
from millrace.operators import shape
from millrace.operators import window as w
from millrace.plans.expressions import HIDDEN, ORDER, SOURCE, Compiler, bind, columns
from millrace.plans.ir import Expr, FlowError, Program, Scope, Step
from millrace.plans.parser import parse
from millrace.scratch import scratch_dir
from millrace.sources import files, sinks, text

BLOCKING = {"sort", "group", "describe", "join", "asof"}
_ORDERED = {"sort", "take", "distinct", "merge", "asof"}


@dataclass
class RunResult:
    """``outputs`` are lazy; ``events`` has what plans and finished actions reported."""

    outputs: dict[str, DataFrame]
    ledger: Ledger
    leaves: list[str] = field(default_factory=list)
    hooks: list[tuple[str, Step]] = field(default_factory=list)
    counters: list[tuple[str, str, Observation]] = field(default_factory=list)

    @property
    def telemetry(self) -> list[tuple[str, str, int]]:
        """``(scope, step, rows)`` of each step that finished actions have run."""
        self.ledger.collect()
        return [(scope, step, seen.get["rows"]) for scope, step, seen in self.counters if getattr(seen, "_jo", None) and seen._jo.future().isCompleted()]

    @property
    def events(self) -> list[Event]:
        self.ledger.collect()
        _fire(self.hooks, self.ledger)
        return self.ledger.events

    @property
    def mode(self) -> str:
        self.events  # noqa: B018  hooks change the mode
        return self.ledger.mode


def _fire(hooks: list[tuple[str, Step]], ledger: Ledger) -> None:
    if any(e.severity == Severity.FATAL for e in ledger.events):
        ledger.mode = "halted"
        return
    for label, hook in hooks:
        least = Severity[hook.args.get("severity", "info").upper()]
        hit = [e for e in ledger.events if e.severity >= least and e.scope == label]
        if hook.args["event"] != "error" or not hit:
            continue
        if hook.args["action"] == "transition":
            ledger.mode = hook.args["value"]
        elif hook.args["action"] == "log" and not any(e.message == hook.args["value"] for e in ledger.events):
            ledger.add(Severity.INFO, label, hook.args["value"])


def _all_steps(steps: list[Step]):
    for s in steps:
        yield s
        if s.op == "branch":
            yield from _all_steps(s.args["steps"])


def needs_order(program: Program, single: bool = True) -> bool:
    """Whether any result depends on the source's order; if not, no order column is carried.

    One output file shows the order of a join's left side; plain pipelines keep their order by
    themselves, and many part files have none.
    """
    heads = {scope.head.op for scope in program.scopes}
    if single and "join" in heads and any(s.op == "save" for scope in program.scopes for s in _all_steps(scope.steps)):
        return True
    for scope in program.scopes:
        for s in (scope.head, *_all_steps(scope.steps)):
            if s.op in _ORDERED or (s.op == "fill" and s.args.get("method") in ("ffill", "bfill")):
                return True
            if s.op == "group" and any(f in ("first", "last", "array_agg", "list_agg", "arr") for f, _ in s.args["aggregates"]):
                return True
            if s.op == "project" and any(i["kind"] == "expr" and i["expr"].kind == "window" for i in s.args["items"]):
                return True
    return False


def check(program: Program) -> None:
    """Refuses what can be known to be wrong before anything runs."""
    known: set[str] = set()
    unbounded: set[str] = set()
    for scope in program.scopes:
        head = scope.head
        used = [head.args[k] for k in ("name", "left", "right") if k in head.args and head.op in ("ref", "materialize", "join", "asof")] + list(head.args.get("names", []))
        for name in used:
            if name not in known:
                near = difflib.get_close_matches(name, known, 1)
                raise FlowError(f"scope {name} isn't defined" + (f"; did you mean {near[0]}?" if near else ""))
        endless = head.op in ("watch", "subscribe") or bool(unbounded & set(used))
        for s in _all_steps(scope.steps):
            if s.op == "on" and s.args["action"] == "route":
                raise FlowError("on … route is reserved")
            if endless and s.op == "take":
                endless = False
            if endless and (s.op in BLOCKING or (s.op == "fill" and s.args.get("method") in ("bfill", "mean", "median"))):
                raise FlowError(f"{s.op} waits for an end that an unbounded source never has")
            if s.op == "branch":
                known.add(s.args["label"])
        if endless and head.op in BLOCKING:
            raise FlowError(f"{head.op} waits for an end that an unbounded source never has")
        if scope.label:
            known.add(scope.label)
            if endless:
                unbounded.add(scope.label)
        _check_names(scope)


def _check_names(scope: Scope) -> None:
    """Names in filters against a declared schema, followed through the steps that change names."""
    if scope.head.op != "open" or not scope.head.args.get("schema") or scope.head.args.get("with"):
        return
    have = [n for n, _ in scope.head.args["schema"]]

    def need(name: str) -> None:
        if name.split(".")[0] not in have and name.split(".")[0] != "source":
            near = difflib.get_close_matches(name, have, 1)
            raise FlowError(f"unknown column {name}" + (f"; did you mean {near[0]}?" if near else ""))

    def walk(e) -> None:
        if isinstance(e, Expr):
            if e.kind == "col":
                need(e.args[0])
            for a in e.args:
                walk(a)
        elif isinstance(e, tuple):
            for x in e:
                walk(x)

    for s in scope.steps:
        if s.op == "filter":
            for p in s.args["predicates"]:
                walk(p)
        elif s.op == "project":
            if any(i["kind"] == "column" and i["column"].split(".")[0] not in (*have, "source") for i in s.args["items"]):
                return  # such a projection is passed over, with a warning
            names = [[*have] if i["kind"] == "all" else [i.get("alias") or i["column"].split(".")[-1]] if i["kind"] == "column" else [i["name"], f"{i['name']}_r"] for i in s.args["items"]]
            have = [n for own in names for n in own]
        elif s.op == "rename":
            have = [s.args["names"].get(n, n) for n in have]
        elif s.op == "drop":
            have = [n for n in have if n not in s.args["columns"]]
        elif s.op == "group":
            have = [k.split(".")[-1] for k in s.args["keys"]] + ["count"] + [f"{f}_{c.replace('.', '_')}" for f, c in s.args["aggregates"]]
        elif s.op == "describe":
            have = ["column", "type", "count", "min", "max", "mean"]
        elif s.op not in ("validate", "sort", "take", "dropna", "fill", "distinct", "print", "save", "on", "cast", "reorder", "explode", "branch"):
            return  # reused steps and read files bring names that aren't known here


class Engine:
    def __init__(self, spark: SparkSession, base: str = "", single: bool | None = None, telemetry: bool = False):
        self.spark, self.base, self.single = spark, base, sinks.one_file(spark) if single is None else single
        self.ledger = Ledger()
        self.scopes: dict[str, DataFrame] = {}
        self.steps: dict[str, list[Step]] = {}
        self.views: dict[str, dict] = {}
        self.hooks: list[tuple[str, Step]] = []
        self.sinks: list[tuple[str, DataFrame, Step]] = []
        self.used: set[str] = set()
        self.ordered = False
        self.sorted: dict[str, bool] = {}
        self.telemetry = telemetry
        self.counters: list[tuple[str, str, Observation]] = []

    def run(self, program: Program | str, write: bool = True) -> RunResult:
        program = parse(program) if isinstance(program, str) else program
        check(program)
        self.ordered = needs_order(program, self.single)
        for i, scope in enumerate(program.scopes):
            label = scope.label or f"_{i}"
            self.body(label, self.head(label, scope.head), scope.steps)
            self.steps[label] = [s for s in scope.steps if s.op not in ("save", "print", "on", "branch")]
        if write:
            for label, df, step in self.sinks:
                self.save(label, df, step)
        sunk = {label for label, _, _ in self.sinks}
        leaves = [n for n in self.scopes if n not in self.used and n not in sunk]
        outputs = {n: self.visible(df, self.single or self.sorted.get(n, False)) for n, df in self.scopes.items()}
        return RunResult(outputs, self.ledger, leaves, self.hooks, self.counters)

    def visible(self, df: DataFrame, in_order: bool) -> DataFrame:
        """The columns a user sees; a cluster sorts only what the program sorts."""
        return (df.orderBy(ORDER) if in_order and ORDER in df.columns else df).select(*[F.col(f"`{c}`") for c in columns(df)])

    def path(self, path: str) -> str:
        return path if "://" in path or path.startswith("/") or not self.base else f"{self.base}/{path}"

    # Heads

    def scope(self, name: str) -> DataFrame:
        self.used.add(name)
        return self.scopes[name]

    def head(self, label: str, head: Step) -> DataFrame:
        a = head.args
        if head.op == "open":
            return self.open(label, a)
        if head.op == "ls":
            df = files.ls(self.spark, self.path(a["path"]), self.ledger, label)
            return self.with_order(df, F.struct(F.col("path").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("c")))
        if head.op in ("watch", "subscribe"):
            from millrace.streaming import sources

            if head.op == "watch":
                return sources.watch(self.spark, self.path(a["path"]))
            if a.get("schema"):
                return sources.subscribe_fields(self.spark, a["path"], a["schema"], a.get("format") or "csv")
            if a.get("format"):
                self.ledger.add(Severity.WARNING, label, f"subscribe as {a['format']} has no field list (name:type …): lines stay as they are, in value")
            return sources.subscribe(self.spark, a["path"])
        if head.op == "stream":
            if a["name"] in self.scopes:
                return self.scope(a["name"])
            self.ledger.add(Severity.WARNING, label, f"stream {a['name']} gives no rows")
            return self.spark.createDataFrame([], "value string")
        if head.op in ("ref", "materialize"):
            return self.scope(a["name"])
        if head.op == "merge":
            frames = [self.scope(n) for n in a["names"]]
            if self.ordered:
                frames = [self.with_order(df, F.struct(F.concat(F.lit(f"{i:06d}\u0001"), F.col(f"{ORDER}.a")).alias("a"), F.col(f"{ORDER}.b"), F.col(f"{ORDER}.c"))) if ORDER in df.columns else df for i, df in enumerate(frames)]
            return files.widened(frames)
        left, right = self.scope(a["left"]), self.scope(a["right"])
        bare = right.select(*[F.col(f"`{c}`") for c in columns(right)])
        if head.op == "asof":
            order = None
            if ORDER in right.columns:
                bare, order = right.drop(SOURCE).withColumnRenamed(ORDER, "__ro"), ["__ro"]
            out = j.asof(left, bare, a["on"], a["by"], a.get("within"), order)
            return out.drop("__ro")
        out = j.join(left, bare, a["on"], a["how"])
        if ORDER in out.columns:
            late = F.struct(F.lit("￿").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("c"))
            out = out.withColumn(ORDER, F.coalesce(F.col(ORDER), late))
        return out

    def with_order(self, df: DataFrame, order) -> DataFrame:
        return df.withColumn(ORDER, order) if self.ordered else df

    def open(self, label: str, a: dict) -> DataFrame:
        path = a["path"]
        if path == "-":
            path = files.piped(self.spark, sys.stdin.buffer, {"jsonl": "json", "ndjson": "json"}.get(a.get("format", ""), a.get("format") or "csv"))
        if path.startswith(("http://", "https://")):
            path = files.fetch(self.spark, path)
        path = self.path(path)
        fmt = {"jsonl": "json", "ndjson": "json"}.get(a.get("format", ""), a.get("format")) or files.format_of(path)
        if re.search(r"\.zstd?$", path):
            path = files.unpacked(self.spark, path)
        if fmt in ("csv", "tsv"):
            df = text.read_csv(self.spark, path, not a.get("noheader"), a.get("schema"), "\t" if fmt == "tsv" else ",", self.ledger, label)
        elif fmt == "json":
            df = text.read_json(self.spark, path, self.ledger, label)
        elif fmt == "parquet":
            df = text.read_parquet(self.spark, path)
        else:
            df = files.read_binary(self.spark, path, a["schema"], bool(a.get("be")), bool(a.get("aligned")))
        plain = fmt != "bin"
        origin = files.plain(F.input_file_name()) if plain else F.lit(path)
        block = F.input_file_block_start() if plain else F.lit(0).cast("bigint")
        df = self.with_order(df, F.struct(origin.alias("a"), block.alias("b"), F.monotonically_increasing_id().alias("c")))
        if a.get("with"):
            # One file goes by the name it was opened with, of several each row by its own.
            several = plain and (re.search(r"[*?\[{]", a["path"]) or not re.search(r"\.[^/.]+$", a["path"])) and a["path"] not in ("-", "stdin")
            df = df.withColumn(SOURCE, origin if several else F.lit(a["path"]))
            if a["with"] == "filename":
                df = df.withColumn("filename_r" if "filename" in df.columns else "filename", F.col(SOURCE))
        return df

    # Steps

    def body(self, label: str, df: DataFrame, steps: list[Step]) -> None:
        self.sorted[label] = any(s.op == "sort" for s in steps)
        views: dict[str, dict] = {}
        df = self.counted(label, "source", df)
        for step in steps:
            if step.op == "branch":
                self.used.add(label)
                self.body(step.args["label"], df, step.args["steps"])
                self.steps[step.args["label"]] = [s for s in step.args["steps"] if s.op not in ("save", "print", "on", "branch")]
            elif step.op in ("save", "print"):
                if step.op == "save":
                    self.sinks.append((label, df, step))
            elif step.op == "on":
                self.hooks.append((label, step))
            elif step.op == "reuse":
                for s in self.steps[step.args["name"]]:
                    df = self.step(label, df, _bound(s, step.args["bindings"]), views)
            else:
                df = self.counted(label, step.op, self.step(label, df, step, views))
        self.scopes[label] = df

    def counted(self, label: str, step: str, df: DataFrame) -> DataFrame:
        """With telemetry, counts the rows that leave a step in the data's own pass."""
        if not self.telemetry or df.isStreaming:
            return df
        seen = Observation()
        self.counters.append((label, step, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def order_of(self, df: DataFrame) -> list:
        return [ORDER] if ORDER in df.columns else []

    def step(self, label: str, df: DataFrame, step: Step, views: dict) -> DataFrame:
        a, op = step.args, step.op
        compiler = Compiler(df, views, self.ledger, label)
        have = columns(df)

        def known(names: list[str]) -> list[str]:
            for n in names:
                if n.split(".")[0] not in have:
                    compiler.warn(f"unknown column {n}")
            return [n for n in names if n.split(".")[0] in have]

        if op == "filter":
            return r.where(df, *[compiler.filter(p) for p in a["predicates"]])
        if op == "validate":
            from millrace.plans.ir import show

            for rule in a["rules"]:
                name = ", ".join(show(p) for p in rule["predicates"])
                df = r.validate(df, r.s.both(*[compiler.condition(p) for p in rule["predicates"]]), rule["disposition"], name, self.ledger, label)
            return df
        if op == "project":
            return self.project(label, df, a["items"], views, compiler)
        if op == "group":
            keys = known(a["keys"])
            aggregates = [(f, c) for f, c in a["aggregates"] if known([c])]
            out = g.group(df, keys, aggregates, self.order_of(df) or None)
            names = [k.split(".")[-1] for k in keys]
            text_key = F.concat_ws("\u0001", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in names])
            if not (self.ordered or self.single):
                return out
            return out.withColumn(ORDER, F.struct(text_key.alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("c")))
        if op == "take" and df.isStreaming:
            return self.bounded(df, a["n"])
        if op == "take":
            return r.take(df, a["n"], self.order_of(df) or None)
        if op == "sort":
            keys = [(k, d) for k, d in a["keys"] if known([k])]
            if not keys:
                return df
            # The new order is a rank in no window: sorted once, then numbered by place.
            out = r.sort(df, *keys, order_by=self.order_of(df))
            return self.with_order(out, F.struct(F.lit("").alias("a"), F.lit(0).cast("bigint").alias("b"), F.monotonically_increasing_id().alias("c")))
        if op == "distinct":
            keys = known(a["columns"]) or have
            return r.distinct(df, *keys, order_by=self.order_of(df) or None)
        if op == "dropna":
            out = r.dropna(df, *(known(a["columns"]) or ([] if a["columns"] else have)))
            return out
        if op == "fill":
            if not known([a["column"]]):
                return df
            method = a.get("method")
            if method in ("ffill", "bfill"):
                if not isinstance(df.schema[a["column"]].dataType, T.StringType):
                    compiler.warn(f"{method} fills text columns only")
                    return df
                return (r.ffill if method == "ffill" else r.bfill)(df, a["column"], self.order_of(df))
            if method:
                return r.fill_statistic(df, a["column"], method)
            return r.fill(df, a["column"], a["value"])
        if op == "describe":
            return shape.describe(df.select(*[F.col(f"`{c}`") for c in have]))
        if op == "explode":
            if not known([a["column"]]):
                return df
            out = shape.explode(df, a["column"])
            return out
        if op == "rename":
            known(list(a["names"]))
            return shape.rename(df, a["names"])
        if op == "drop":
            return df.drop(*[c for c in a["columns"] if c in have])
        if op == "reorder":
            return shape.reorder(df, *a["columns"])
        if op == "cast":
            known(list(a["types"]))
            out = shape.cast(df, {c: lane for c, lane in a["types"].items() if c in have})
            lost = {}
            for c, lane in a["types"].items():
                if c in have and isinstance(df.schema[c].dataType, T.StringType) and lane != "str":
                    lost[c] = (Severity.WARNING, f"{{n}} cell(s) of column '{c}' don't fit {lane} and became null", (F.trim(F.col(f"`{c}`")) != "") & shape.cast_column(F.col(f"`{c}`"), T.StringType(), lane).isNull())
            return shape.cast(self.ledger.watch(df, label, lost), {c: lane for c, lane in a["types"].items() if c in have}) if lost else out
        if op == "read":
            column = "path" if "path" in have else have[0]
            out = files.read(df, column, a.get("format"), bool(a.get("with")), self.ledger, label)
            if self.ordered:
                out = out.withColumn(ORDER, F.struct(files.plain(F.input_file_name()).alias("a"), F.input_file_block_start().alias("b"), F.monotonically_increasing_id().alias("c")))
            if a.get("with") == "filename":
                out = out.withColumn("filename_r" if "filename" in out.columns else "filename", F.col(SOURCE))
            return out
        raise FlowError(f"unknown step {op}")

    def bounded(self, df: DataFrame, n: int) -> DataFrame:
        """The first ``n`` rows of a stream, once they have come, as a table in the shared folder."""
        from millrace.streaming import sources

        path = f"{scratch_dir(self.spark)}/stream-{uuid.uuid4().hex}"
        sources.take(df, n, lambda rows: rows.write.mode("append").parquet(path), f"{path}-state")
        return self.spark.read.schema(df.schema).parquet(path)

    def project(self, label: str, df: DataFrame, items: list[dict], views: dict, compiler: Compiler) -> DataFrame:
        hidden = [c for c in HIDDEN if c in df.columns]
        have = columns(df)
        missing = [i["column"] for i in items if i["kind"] == "column" and i["column"].split(".")[0] not in have and i["column"].split(".")[0] != "source"]
        if missing:
            compiler.warn(f"unknown column {', '.join(missing)}; the projection is passed over")
            return df
        out, names, after = [], [], []
        for i in items:
            if i["kind"] == "all":
                out += [F.col(f"`{c}`") for c in have]
                names += have
            elif i["kind"] == "column":
                c, kind = compiler(_dotted(i["column"]))
                if i.get("type"):
                    c = shape.cast_column(c, kind, i["type"])
                name = i.get("alias") or i["column"].split(".")[-1]
                if i.get("views"):
                    views[name] = {n: (x, y) for n, x, y in i["views"]}
                out.append(c.alias(name))
                names.append(name)
            elif i["expr"].kind == "window":
                kind, args, by = i["expr"].args
                column = args[0].args[0]
                name = f"{i['name']}_r" if i["name"] in names else i["name"]
                if kind == "session":
                    added = w.with_session(df, "__w", column, str(args[1].args[0]), list(by), self.order_of(df) or [column])
                else:
                    n = int(args[1].args[0]) if len(args) > 1 else 1
                    added = w.with_window(df, "__w", kind, column, n, list(by), self.order_of(df))
                df = added.withColumnRenamed("__w", f"__w{len(after)}")
                out.append(F.col(f"__w{len(after)}").alias(name))
                after.append(name)
                names.append(name)
            else:
                out.append(compiler(i["expr"])[0].alias(i["name"]))
                names.append(i["name"])
        return df.select(*out, *hidden)

    # Sinks

    def save(self, label: str, df: DataFrame, step: Step) -> None:
        a = step.args
        path, fmt = a["path"], a.get("format")
        order = self.order_of(df)
        if df.isStreaming:
            kind = {"tsv": "csv", "jsonl": "json", "ndjson": "json"}.get(fmt or files.format_of(path), fmt or files.format_of(path))
            out = self.path(path)
            stream = df.writeStream.format(kind).option("header", "true").option("checkpointLocation", f"{scratch_dir(self.spark)}/sink-{uuid.uuid4().hex}")
            stream.trigger(availableNow=True).start(out).awaitTermination()  # what is there now; run again for what comes later
            return
        try:
            if path == "-":
                sinks.save(self.visible(df, True), "-", fmt or "csv")
            elif "{" in path:
                views: dict = {}
                bare = self.visible(df, self.single)
                compiler = Compiler(bare, views, self.ledger, label)
                sinks.save_template(bare, self.path(path), lambda e: compiler(_expression(e))[0], fmt)
            elif a.get("by"):
                bare = self.visible(df, self.single)
                sinks.save_by(bare, self.path(path), {k: F.col(f"`{k}`") for k in a["by"]}, fmt or "csv", "flat" if a.get("flat") else "hive")
            else:
                if (fmt or files.format_of(path)) == "parquet":
                    raise FlowError("parquet can't be written by a flow")
                ordered = df.orderBy(*order) if order and (self.single or self.sorted.get(label)) else df
                sinks.save(ordered.select(*[F.col(f"`{c}`") for c in columns(df)]), self.path(path), fmt, single=self.single)
        except Exception as e:
            if not halted(e, label, self.ledger):
                raise


def halted(e: Exception, label: str, ledger: Ledger) -> bool:
    """Whether an action failed because a contract halted it; if so, the ledger is told."""
    if "ContractHalted" not in str(e):
        return False
    found = re.search(r"ContractHalted: ([^\n]*?)(?: SQLSTATE: \w+)?$", str(e), re.MULTILINE)
    ledger.add(Severity.FATAL, label, f"halted: {found[1] if found else ''}")
    return True


def _dotted(name: str) -> Expr:
    first, *rest = name.split(".")
    out = Expr("col", (first,))
    for part in rest:
        out = Expr("path", (out, part))
    return out


def _expression(source: str) -> Expr:
    program = parse(f"X: open x |> ({source}) as x ;")
    return program.scopes[0].steps[0].args["items"][0]["expr"]


def _bound(step: Step, values: dict) -> Step:
    def inner(x):
        if isinstance(x, Expr):
            return bind(x, values)
        if isinstance(x, list):
            return [inner(y) for y in x]
        if isinstance(x, dict):
            return {k: inner(v) for k, v in x.items()}
        return x

    return Step(step.op, inner(step.args)) if values else step


def run(program: Program | str, spark: SparkSession, base: str = "", write: bool = True, single: bool | None = None, telemetry: bool = False) -> RunResult:
    return Engine(spark, base, single, telemetry).run(program, write)
