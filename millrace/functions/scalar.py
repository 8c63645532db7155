"""Scalar functions as column expressions, with the null and parse rules in one place.

Comparisons are two-valued: false if an operand is null. Text and number compare by the
number that the text holds. Arithmetic passes nulls on, and division by zero gives null.
String functions see a null as the empty text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
WHITE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def false_if_null(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def comparable(left: Column, left_type: T.DataType, right: Column, right_type: T.DataType) -> tuple[Column, Column]:
    """Both sides in one type: a text beside a number is parsed, bad text becomes null."""
    from millrace.functions import temporal as t

    l_text, r_text = isinstance(left_type, T.StringType), isinstance(right_type, T.StringType)
    for mine, other, other_type, flip in ((left, right, right_type, False), (right, left, left_type, True)):
        if not (l_text if not flip else r_text):
            continue
        parsed = None
        if isinstance(other_type, NUMERIC):
            parsed = mine.try_cast("decimal(38,9)" if isinstance(other_type, T.DecimalType) else "double")
        elif isinstance(other_type, (T.TimestampNTZType, T.TimestampType)):
            parsed = t.to_instant(mine)
        elif isinstance(other_type, T.DateType):
            parsed = t.to_date(mine)
        elif isinstance(other_type, T.DayTimeIntervalType):
            parsed = t.parse_span(mine)
        elif isinstance(other_type, T.BooleanType):
            parsed = F.when(F.lower(mine) == "true", True).when(F.lower(mine) == "false", False)
        if parsed is not None:
            return (other, parsed) if flip else (parsed, other)
    return left, right


def compare(op: str, left: Column, right: Column, left_type: T.DataType, right_type: T.DataType, as_filter: bool = False) -> Column:
    """``== != < <= > >=``; false with a null or a NaN operand.

    ``as_filter`` leaves nulls as they are. A filter drops them just the same (there is no
    negation that could turn them round), and only bare comparisons reach the file reader.
    """
    left, right = comparable(left, left_type, right, right_type)
    found = {"==": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
    for side, kind in ((left, left_type), (right, right_type)):
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            found = found & ~F.isnan(side)
    return found if as_filter else false_if_null(found)


def both(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & false_if_null(c)
    return out


def either(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | false_if_null(c)
    return out


def divide(a: Column, b: Column) -> Column:
    """Always a double; null for division by zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of ``a``; null for zero."""
    return F.try_mod(a, b)


def case(branches: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The first branch whose condition holds; empty text if none does and there is no other value."""
    (condition, value), *rest = branches
    out = F.when(false_if_null(condition), value)
    for condition, value in rest:
        out = out.when(false_if_null(condition), value)
    return out.otherwise(F.lit("") if otherwise is None else otherwise)


# Casts


def to_int(c: Column, kind: T.DataType | None = None) -> Column:
    """A whole number; fractions are cut off, what can't be read is null."""
    if isinstance(kind, T.BooleanType):
        return c.cast("bigint")
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        from millrace.functions.temporal import micros

        return F.floor(micros(c) / 1_000_000).cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(kind, NUMERIC):
        return c.try_cast("bigint")
    trimmed = F.regexp_replace(c.cast("string"), WHITE, "")
    return F.coalesce(trimmed.try_cast("bigint"), trimmed.try_cast("double").try_cast("bigint"))


def to_float(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), WHITE, "").try_cast("double")


def to_decimal(c: Column, scale: int) -> Column:
    """Rounded half to even at ``scale`` digits; null if it can't be read."""
    return F.bround(F.regexp_replace(c.cast("string"), WHITE, "").try_cast("decimal(38,18)"), scale).try_cast(f"decimal(38,{scale})")


def to_bool(c: Column, kind: T.DataType | None = None) -> Column:
    if isinstance(kind, NUMERIC):
        return c != 0
    lower = F.lower(F.trim(c.cast("string")))
    return F.when(lower.isin("true", "1"), True).when(lower.isin("false", "0"), False)


# Strings


def upper(c: Column) -> Column:
    return F.upper(text(c))


def lower(c: Column) -> Column:
    return F.lower(text(c))


def trim(c: Column) -> Column:
    return F.regexp_replace(text(c), WHITE, "")


def length(c: Column) -> Column:
    return F.length(text(c)).cast("bigint")


def substr(c: Column, start: Column, count: Column | None = None) -> Column:
    """From the 1-based ``start``, at least 1."""
    begin = F.greatest(start.cast("int"), F.lit(1))
    return F.substring(text(c), begin, count.cast("int") if count is not None else F.lit(2_147_483_647 // 2))


def contains(c: Column, part: Column) -> Column:
    return F.contains(text(c), text(part))


def starts_with(c: Column, part: Column) -> Column:
    return F.startswith(text(c), text(part))


def ends_with(c: Column, part: Column) -> Column:
    return F.endswith(text(c), text(part))


def like_pattern(pattern: str) -> str:
    """``%`` and ``_`` without an escape character, as an anchored regular expression."""
    return "(?s)^" + "".join({"%": ".*", "_": "."}.get(ch) or re.escape(ch) for ch in pattern) + "$"


def glob_pattern(pattern: str) -> str:
    """``* ? [a-z] [!x]`` over the whole text, as an anchored regular expression."""
    out, i = "(?s)^", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\").replace("&", "\\&").replace("[", "\\[").replace("^", "\\^")
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]"
            i = end + 1
            continue
        out += {"*": ".*", "?": "."}.get(ch) or re.escape(ch)
        i += 1
    return out + "$"


def like(c: Column, pattern: str) -> Column:
    return text(c).rlike(like_pattern(pattern))


def glob(c: Column, pattern: str) -> Column:
    return text(c).rlike(glob_pattern(pattern))


def matches(c: Column, pattern: str) -> Column:
    """Whether the expression is found anywhere; always false for a bad one."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    return text(c).rlike(pattern)


def replace(c: Column, old: Column, new: Column) -> Column:
    return F.when(text(old) == "", text(c)).otherwise(F.replace(text(c), text(old), text(new)))


def split_part(c: Column, separator: Column, n: Column) -> Column:
    """The n-th field from 1, from the end if negative; empty out of range and for 0."""
    place = n.cast("int")
    return F.when(place == 0, "").otherwise(F.split_part(text(c), text(separator), F.when(place == 0, 1).otherwise(place)))


def basename(c: Column) -> Column:
    return F.regexp_extract(text(c), r"([^/\\]*)$", 1)


def stem(c: Column) -> Column:
    """The last segment without its extension; a leading dot starts no extension."""
    return F.regexp_replace(basename(c), r"^(.+)\.[^.]*$", "$1")


def dirname(c: Column) -> Column:
    """All before the last segment; ``.`` without a separator."""
    t = text(c)
    return F.when(~t.rlike(r"[/\\]"), ".").when(t.rlike(r"^[/\\][^/\\]*$"), F.substring(t, 1, 1)).otherwise(F.regexp_replace(t, r"[/\\][^/\\]*$", ""))


def concat(*parts: Column) -> Column:
    return F.concat(*[text(p) for p in parts])


def scheme(uri: Column) -> Column:
    found = F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    return F.when(uri.isNull(), F.lit(None).cast("string")).when(found == "", "file").otherwise(found)


def sub_view(c: Column, start: int, end: int) -> Column:
    """Characters ``start`` to ``end``; null if the text is shorter."""
    return F.when(F.length(c) >= end, F.substring(c, start + 1, end - start))


# Numbers


def whole(name: str, c: Column) -> Column:
    """``abs``, ``round`` (ties away from zero), ``floor`` or ``ceil``."""
    return {"abs": F.abs, "round": lambda x: F.round(x, 0).try_cast("bigint"), "floor": lambda x: F.floor(x).cast("bigint"), "ceil": lambda x: F.ceil(x).cast("bigint")}[name](c)
