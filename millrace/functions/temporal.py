"""Dates, times, spans and time windows as column expressions.

An instant is a ``timestamp_ntz``, a span a day-time interval, a date a ``date``, and a time
of day its canonical text ``HH:mm:ss``, which sorts, groups and prints as it should.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of span units, and their microseconds.
UNITS = {
    "ns": 0.001, "us": 1, "ms": 1_000, "s": 1_000_000, "sec": 1_000_000, "second": 1_000_000, "seconds": 1_000_000,
    "m": 60_000_000, "min": 60_000_000, "minute": 60_000_000, "minutes": 60_000_000,
    "h": 3_600_000_000, "hour": 3_600_000_000, "hours": 3_600_000_000, "d": 86_400_000_000, "day": 86_400_000_000, "days": 86_400_000_000,
}
# Formats that an instant without a declared format may have, in this order.
AUTO_FORMATS = ("yyyy-MM-ddTHH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyyMMddHHmmss", "yyMMddHHmmss", "yyyyMMdd")
# Zone abbreviations that are unambiguous, and their hours from UTC.
ZONES = {"UTC": 0, "GMT": 0, "JST": 9, "MST": -7, "HST": -10}
# Japanese weekday names from Monday.
JA_DAYS = ("月", "火", "水", "木", "金", "土", "日")
_TOKENS = re.compile(r"yyyy|yy|MM|ddd|dd|HH|hh|mm|ss|n+|.", re.DOTALL)
_PATTERNS = {"yyyy": r"\d{4}", "yy": r"\d{2}", "MM": r"\d{2}", "dd": r"\d{2}", "HH": r"\d{2}", "hh": r"\d{2}", "mm": r"\d{2}", "ss": r"\d{2}"}
_TRUNC = ("year", "month", "day", "hour", "minute", "second")


def span_us(text: str) -> int | None:
    """Microseconds of ``15m``, ``2 hours`` or ``[-][Nd ]HH:MM:SS[.f]``; None if it is no span."""
    text = text.strip()
    if m := re.fullmatch(r"(-?\d+)\s*([a-z]+)", text):
        return int(int(m[1]) * UNITS[m[2]]) if m[2] in UNITS else None
    if m := re.fullmatch(r"(-)?(?:(\d+)d )?(\d+):(\d{2}):(\d{2})(?:\.(\d{1,9}))?", text):
        us = ((int(m[2] or 0) * 24 + int(m[3])) * 60 + int(m[4])) * 60_000_000 + int(m[5]) * 1_000_000 + int((m[6] or "0").ljust(6, "0")[:6])
        return -us if m[1] else us
    return None


def micros(ts: Column) -> Column:
    """Microseconds of an instant since 1970."""
    return F.unix_micros(ts.cast("timestamp_ltz"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def interval(us: Column) -> Column:
    """A span of so many microseconds."""
    return from_micros(us) - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def interval_us(span: Column) -> Column:
    return micros(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + span)


def parse_span(text: Column) -> Column:
    """A span from ``[-][Nd ]HH:MM:SS[.f]`` or a number with a unit; null if it is neither."""
    human = r"^(-?)(?:(\d+)d )?(\d+):(\d{2}):(\d{2})(?:\.(\d{1,9}))?$"
    part = lambda i: F.coalesce(F.regexp_extract(text, human, i).try_cast("bigint"), F.lit(0))
    fraction = F.substring(F.rpad(F.regexp_extract(text, human, 6), 6, "0"), 1, 6).cast("bigint")
    us = ((part(2) * 24 + part(3)) * 60 + part(4)) * 60_000_000 + part(5) * 1_000_000 + fraction
    us = F.when(F.regexp_extract(text, human, 1) == "-", -us).otherwise(us)
    unit = F.regexp_extract(text, r"^-?\d+\s*([a-z]+)$", 1)
    scale = F.lit(None).cast("double")
    for name, size in UNITS.items():
        scale = F.when(unit == name, float(size)).otherwise(scale)
    counted = (F.regexp_extract(text, r"^(-?\d+)", 1).try_cast("bigint") * scale).cast("bigint")
    return F.when(text.rlike(human), interval(us)).otherwise(interval(counted))


def _split(fmt: str) -> tuple[str, list[str]]:
    locale = ""
    if m := re.match(r"\[([^\]]*)\]", fmt):
        locale, fmt = m[1], fmt[m.end() :]
        if locale != "ja-jp":
            raise ValueError(f"unknown locale tag [{locale}]")
    return locale, _TOKENS.findall(fmt)


def parse_instant(text: Column, fmt: str) -> Column:
    """An instant by a format of ``yyyy yy MM dd ddd HH mm ss n…n``; null where it doesn't fit.

    Years of two digits are 1969 to 2068. A weekday has to be that of the date.
    """
    locale, tokens = _split(fmt)
    days = list(JA_DAYS if locale else ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"))
    groups, names = "", []
    for token in tokens:
        if token == "ddd":
            groups += f"({'|'.join(days)})"
            names.append("ddd")
        elif token[0] == "n" or token in _PATTERNS:
            groups += f"({_PATTERNS.get(token) or rf'\d{{{len(token)}}}'})"
            names.append("n" if token[0] == "n" else token.lower() if token in ("HH", "hh") else token)
        else:
            groups += re.escape(token)
    anchored = f"^{groups}$"
    piece = {name: F.regexp_extract(text, anchored, i + 1) for i, name in enumerate(names)}
    number = lambda name, default: piece[name].try_cast("int") if name in piece else F.lit(default)
    if "yyyy" in piece:
        year = number("yyyy", 0)
    elif "yy" in piece:
        year = F.when(number("yy", 0) >= 69, number("yy", 0) + 1900).otherwise(number("yy", 0) + 2000)
    else:
        year = F.lit(1970)
    fraction = F.substring(F.rpad(piece["n"], 6, "0"), 1, 6) if "n" in piece else F.lit("000000")
    iso = F.format_string("%04d-%02d-%02d %02d:%02d:%02d.%s", year, number("MM", 1), number("dd", 1), number("hh", 0), number("mm", 0), number("ss", 0), fraction)
    found = F.when(text.rlike(anchored), iso).try_cast("timestamp_ntz")
    if "ddd" in piece:
        found = F.when(F.element_at(F.array(*[F.lit(d) for d in days]), F.weekday(found) + 1) == piece["ddd"], found)
    return found


def to_instant(text: Column) -> Column:
    """An instant from any of AUTO_FORMATS, with an optional fraction (cut to seconds) and zone."""
    body = F.trim(text)
    offset = F.regexp_extract(body, r"([+-]\d{2}):?(\d{2})$", 1)
    zoned = body.rlike(r"\d{2}:\d{2}(:\d{2})?(\.\d+)?[+-]\d{2}:?\d{2}$")
    sign = F.when(offset.startswith("-"), -1).otherwise(1)
    minutes = F.when(zoned, F.abs(offset.try_cast("int")) * 60 + F.regexp_extract(body, r"[+-]\d{2}:?(\d{2})$", 1).try_cast("int")).otherwise(0) * sign
    zone = F.regexp_extract(body, r" ([A-Z]{3})$", 1)
    for name, hours in ZONES.items():
        minutes = F.when(zone == name, hours * 60).otherwise(minutes)
    bare = F.regexp_replace(body, f" ({'|'.join(ZONES)})$|Z$", "")
    bare = F.when(zoned, F.regexp_replace(bare, r"[+-]\d{2}:?\d{2}$", "")).otherwise(bare)
    bare = F.regexp_replace(bare, r"(:\d{2})\.\d+$", "$1")
    found = F.coalesce(*[parse_instant(bare, f) for f in AUTO_FORMATS])
    return from_micros(micros(found) - minutes.cast("bigint") * 60_000_000)


def to_date(text: Column) -> Column:
    """A date from ``yyyy-MM-dd``; null for anything else."""
    return F.when(F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.trim(text)).try_cast("date")


def to_time(text: Column) -> Column:
    """A time of day as ``HH:mm:ss``; null if it is out of range."""
    pattern = r"^(\d{1,2}):(\d{1,2}):(\d{1,2})(?:\.\d+)?$"
    h, m, s = (F.regexp_extract(F.trim(text), pattern, i).try_cast("int") for i in (1, 2, 3))
    return F.when((h < 24) & (m < 60) & (s < 60), F.format_string("%02d:%02d:%02d", h, m, s))


def part(name: str, ts: Column) -> Column:
    return getattr(F, {"day": "dayofmonth"}.get(name, name))(ts).cast("bigint")


def weekday(ts: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(ts).cast("bigint")


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def date_of(ts: Column) -> Column:
    return ts.cast("date")


def time_of(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def trunc(ts: Column, unit: str) -> Column:
    """Start of the year, month, day, hour or minute; of the second for any other unit."""
    return F.date_trunc(unit if unit in _TRUNC else "second", ts).cast("timestamp_ntz")


def bucket(ts: Column, width: str, origin: Column | None = None) -> Column:
    """Start of the tumbling window that holds ``ts``, counted from 1970 or from ``origin``; null for a bad width."""
    us = span_us(width)
    if not us or us <= 0:
        return F.lit(None).cast("timestamp_ntz")
    base = micros(origin) if origin is not None else F.lit(0).cast("bigint")
    return from_micros(micros(ts) - F.pmod(micros(ts) - base, F.lit(us)))


def hops(ts: Column, size: str, hop: str) -> Column:
    """Starts of all sliding windows that hold ``ts``, ascending; empty in a gap between windows."""
    size_us, hop_us = span_us(size), span_us(hop)
    if not size_us or not hop_us or size_us <= 0 or hop_us <= 0:
        return F.lit(None).cast("array<timestamp_ntz>")
    last = micros(ts) - F.pmod(micros(ts), F.lit(hop_us))
    # The first start after ts - size that is a multiple of the hop.
    first = micros(ts) - size_us + hop_us - F.pmod(micros(ts) - size_us, F.lit(hop_us))
    starts = F.when(first <= last, F.sequence(first, F.greatest(first, last), F.lit(hop_us).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(ts.isNotNull(), F.transform(starts, from_micros))


def format_instant(ts: Column, fmt: str) -> Column:
    """Text of an instant by the tokens of ``parse_instant``."""
    locale, tokens = _split(fmt)
    out = []
    for token in tokens:
        if token == "ddd":
            names = JA_DAYS if locale else ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
            out.append(F.element_at(F.array(*[F.lit(d) for d in names]), F.weekday(ts) + 1))
        elif token[0] == "n":
            digits = F.lpad(F.pmod(micros(ts), F.lit(1_000_000)).cast("string"), 6, "0")
            out.append(F.substring(F.rpad(digits, 9, "0"), 1, len(token)))
        elif token in _PATTERNS:
            out.append(F.date_format(ts, {"hh": "HH"}.get(token, token)))
        else:
            out.append(F.lit(token))
    return F.when(ts.isNotNull(), F.concat(*out))


def format_span(span: Column, iso: bool = False) -> Column:
    """``[-][Nd ]HH:MM:SS[.f]``, or ``PT…H…M…S``."""
    us = interval_us(span)
    size = F.abs(us)
    seconds = F.floor(size / 1_000_000).cast("bigint")
    fraction = F.pmod(size, F.lit(1_000_000))
    tail = F.when(fraction > 0, F.concat(F.lit("."), F.lpad(fraction.cast("string"), 6, "0"))).otherwise("")
    sign = F.when(us < 0, "-").otherwise("")
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    if iso:
        return F.concat(sign, F.lit("PT"), h.cast("string"), F.lit("H"), m.cast("string"), F.lit("M"), s.cast("string"), tail, F.lit("S"))
    days = F.floor(h / 24)
    return F.concat(sign, F.when(days > 0, F.concat(days.cast("string"), F.lit("d "))).otherwise(""), F.format_string("%02d:%02d:%02d", h % 24, m, s), tail)
