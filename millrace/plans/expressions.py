"""Expressions of the language as columns of a DataFrame."""

from __future__ import annotations

from dataclasses import replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.events import Ledger, Severity
from millrace.functions import scalar as s
from millrace.functions import temporal as t
from millrace.operators.shape import cast_column
from millrace.plans.ir import Expr, FlowError

SOURCE = "__src"
ORDER = "__ord"
HIDDEN = (SOURCE, ORDER)
_MIRROR = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "==": "==", "!=": "!="}


def columns(df: DataFrame) -> list[str]:
    """The columns that a program sees."""
    return [c for c in df.columns if c not in HIDDEN]


def bind(e: Expr, values: dict) -> Expr:
    """Holes filled with values, as literals."""
    if e.kind == "hole" and e.args[0] in values:
        return Expr("lit", (values[e.args[0]],))

    def inner(x):
        if isinstance(x, Expr):
            return bind(x, values)
        return tuple(inner(y) for y in x) if isinstance(x, tuple) else x

    return replace(e, args=tuple(inner(a) for a in e.args))


class Compiler:
    """Compiles expressions against one DataFrame; ``views`` are character views of text columns."""

    #: In a filter comparisons stay bare: see ``scalar.compare``.
    as_filter = False

    def __init__(self, df: DataFrame, views: dict[str, dict[str, tuple[int, int]]] | None = None, ledger: Ledger | None = None, scope: str = ""):
        self.df, self.views, self.ledger, self.scope = df, views or {}, ledger, scope
        self.fields = {f.name: f.dataType for f in df.schema}

    def type(self, c: Column) -> T.DataType:
        return self.df.select(c).schema[0].dataType

    def warn(self, message: str) -> None:
        if self.ledger is not None:
            self.ledger.add(Severity.WARNING, self.scope, message)

    def condition(self, e: Expr) -> Column:
        c, kind = self(e)
        c = c if isinstance(kind, T.BooleanType) else s.to_bool(c, kind)
        return c if self.as_filter else s.false_if_null(c)

    def filter(self, e: Expr) -> Column:
        """A condition for ``DataFrame.filter``."""
        self.as_filter = True
        try:
            return self.condition(e)
        finally:
            self.as_filter = False

    def __call__(self, e: Expr) -> tuple[Column, T.DataType]:
        found = getattr(self, f"_{e.kind}")(*e.args)
        return found if isinstance(found, tuple) else (found, self.type(found))

    def _lit(self, value):
        if isinstance(value, float):
            # A written fraction is exact where it meets a decimal and a double elsewhere.
            return F.lit(float(value)), T.DoubleType()
        if isinstance(value, bool):
            return F.lit(value), T.BooleanType()
        return (F.lit(value).cast("bigint"), T.LongType()) if isinstance(value, int) else (F.lit(value), T.StringType())

    def _regex(self, pattern):
        return F.lit(pattern), T.StringType()

    def _null(self, message: str):
        self.warn(message)
        return F.lit(None).cast("string"), T.StringType()

    def _col(self, name):
        if name not in self.fields:
            return self._null(f"unknown column {name}; null")
        return F.col(f"`{name}`"), self.fields[name]

    def _item(self, name):
        return self._col(name)

    def _up(self, level, name):
        return self._col(name)

    def _pos(self, at):
        own = columns(self.df)
        return self._col(own[at]) if at < len(own) else self._null(f"no column at place {at}; null")

    def _hole(self, name):
        return self._null(f"hole ${name} has no value; null")

    def _deep(self, name):
        level = [(F.col(f"`{c}`"), self.fields[c], c) for c in columns(self.df)]
        while level:
            found = [x for x in level if x[2] == name]
            if found:
                if len(found) > 1:
                    self.warn(f"$_..{name} is found {len(found)} times; the first counts")
                return found[0][0], found[0][1]
            level = [(c[f.name], f.dataType, f.name) for c, kind, _ in level if isinstance(kind, T.StructType) for f in kind]
        return self._null(f"no field {name}; null")

    def _path(self, of: Expr, name):
        if of == Expr("col", ("source",)) and "source" not in self.fields:
            uri = F.col(SOURCE) if SOURCE in self.df.columns else F.lit(None).cast("string")
            return {"uri": uri, "scheme": s.scheme(uri)}.get(name, F.lit(None).cast("string")), T.StringType()
        if of.kind == "col" and name in self.views.get(of.args[0], {}):
            start, end = self.views[of.args[0]][name]
            return s.sub_view(F.col(f"`{of.args[0]}`"), start, end), T.StringType()
        c, kind = self(of)
        if isinstance(kind, T.StructType) and name in kind.names:
            return c[name], kind[name].dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return c[name], T.ArrayType(kind.elementType[name].dataType)
        return self._null(f"no field {name}; null")

    def _index(self, of: Expr, at):
        c, kind = self(of)
        return (F.get(c, F.lit(at)), kind.elementType) if isinstance(kind, T.ArrayType) else self._null("not a list; null")

    def _cast(self, of: Expr, lane):
        c, kind = self(of)
        return cast_column(c, kind, lane)

    def _case(self, branches, other):
        values = [self(v) for _, v in branches] + ([self(other)] if other is not None else [])
        kinds = {k.simpleString() for _, k in values}
        mixed = len(kinds) > 1 and not kinds <= {"bigint", "double"}
        as_one = lambda c, k: cast_column(c, k, "str") if mixed or other is None else c
        own = [as_one(c, k) for c, k in values]
        return s.case([(self.condition(w), v) for (w, _), v in zip(branches, own)], own[-1] if other is not None else None)

    def _window(self, *_):
        raise FlowError("a window function belongs to |>")

    def _op(self, op, a: Expr, b: Expr):
        if op in ("and", "or"):
            x, y = self.condition(a), self.condition(b)
            return (x & y if op == "and" else x | y), T.BooleanType()
        if op == "~":
            return self._matches(a, b), T.BooleanType()
        (x, kx), (y, ky) = self(a), self(b)
        if op in _MIRROR:
            for mine, other, side in ((a, ky, "x"), (b, kx, "y")):
                if mine.kind == "lit" and isinstance(mine.args[0], float) and isinstance(other, T.DecimalType):
                    exact = F.lit(Decimal(getattr(mine.args[0], "text", str(mine.args[0]))))
                    x, y = (exact, y) if side == "x" else (x, exact)
            return s.compare(op, x, y, kx, ky, self.as_filter), T.BooleanType()
        return self._arithmetic(op, x, kx, y, ky)

    def _arithmetic(self, op, x, kx, y, ky):
        span, instant = T.DayTimeIntervalType, T.TimestampNTZType
        if isinstance(kx, (instant, span)) or isinstance(ky, (instant, span)):
            if op == "/" and isinstance(kx, span) and isinstance(ky, span):
                return s.divide(t.interval_us(x), t.interval_us(y))
            if isinstance(ky, T.StringType):
                y = t.parse_span(y)
            if isinstance(kx, T.StringType):
                x = t.to_instant(x) if isinstance(ky, instant) else t.parse_span(x)
            return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}.get(op, lambda: F.lit(None).cast("double"))()
        if isinstance(kx, T.StringType):
            x, kx = s.to_float(x), T.DoubleType()
        if isinstance(ky, T.StringType):
            y, ky = s.to_float(y), T.DoubleType()
        if op == "/":
            return s.divide(x, y)
        if op == "%":
            return s.modulo(x, y)
        return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)

    def _constant(self, e: Expr, what: str) -> str:
        if e.kind not in ("lit", "regex"):
            raise FlowError(f"{what} has to be a constant")
        return str(e.args[0])

    def _matches(self, text: Expr, pattern: Expr) -> Column:
        c = self(text)[0]
        if pattern.kind in ("lit", "regex"):
            return s.matches(c, str(pattern.args[0]))
        return F.rlike(s.text(c), s.text(self(pattern)[0]))

    def _instant(self, e: Expr) -> Column:
        c, kind = self(e)
        return c if isinstance(kind, (T.TimestampNTZType, T.DateType)) else cast_column(c, kind, "datetime")

    def _call(self, name, args):
        as_filter, self.as_filter = self.as_filter, False  # an argument is a value
        try:
            return self._called(name, args)
        finally:
            self.as_filter = as_filter

    def _called(self, name, args):
        if name in ("regexp", "regex", "matches"):
            return self._matches(*args)
        if name in ("like", "glob"):
            return getattr(s, name)(self(args[0])[0], self._constant(args[1], "a pattern"))
        if name in ("year", "month", "day", "hour", "minute", "second"):
            return t.part(name, self._instant(args[0]))
        if name == "trunc":
            return t.trunc(self._instant(args[0]), self._constant(args[1], "a unit"))
        if name in ("bucket", "date_bin"):
            origin = self._instant(args[2]) if len(args) > 2 else None
            return t.bucket(self._instant(args[0]), self._constant(args[1], "a width"), origin)
        if name == "hops":
            return t.hops(self._instant(args[0]), self._constant(args[1], "a size"), self._constant(args[2], "a hop"))
        if name == "format":
            c, kind = self(args[0])
            if isinstance(kind, T.DayTimeIntervalType):
                return t.format_span(c, len(args) > 1 and self._constant(args[1], "a format") == "iso")
            return t.format_instant(self._instant(args[0]), self._constant(args[1], "a format") if len(args) > 1 else "yyyy-MM-ddTHH:mm:ss")
        if name == "weekday":
            return t.weekday(self._instant(args[0]))
        if name == "is_weekend":
            return t.is_weekend(self._instant(args[0]))
        if name == "date":
            return t.date_of(self._instant(args[0]))
        if name == "time":
            return t.time_of(self._instant(args[0]))
        if name == "resource":
            return s.text(self(args[0])[0])
        if name == "coalesce":
            found = [self(a) for a in args]
            kinds = {k.simpleString() for _, k in found}
            one = len(kinds) == 1 or kinds <= {"bigint", "double"}
            return F.coalesce(*[c if one else cast_column(c, k, "str") for c, k in found])
        if name in ("abs", "round", "floor", "ceil"):
            c, kind = self(args[0])
            return s.whole(name, s.to_float(c) if isinstance(kind, T.StringType) else c)
        own = {"len": s.length}.get(name) or getattr(s, name)
        return own(*[self(a)[0] for a in args])
