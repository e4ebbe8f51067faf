"""Paths, options, sizes, durations and other texts of table metadata, as expressions and as plain functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"ms": 1, "millis": 1, "milli": 1, "millisecond": 1, "s": 1000, "sec": 1000, "second": 1000, "min": 60_000, "m": 60_000, "minute": 60_000, "h": 3_600_000, "hour": 3_600_000, "d": 86_400_000, "day": 86_400_000, "week": 604_800_000}
_BYTES = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40}


def duration_ms(text: str) -> int | None:
    """`1 d`, `30 min`, `500ms`; a bare number is milliseconds."""
    m = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]*)\s*", text)
    if not m:
        return None
    unit = m[2].lower() or "ms"
    factor = _UNITS.get(unit) or _UNITS.get(unit.rstrip("s"))
    return int(m[1]) * factor if factor else None


def interval_ms(text: str) -> int | None:
    """`interval 1 week 2 days`."""
    body = re.sub(r"^\s*interval\s+", "", text.strip().lower())
    parts = re.findall(r"([+-]?\d+)\s*([a-z]+)", body)
    if not parts or re.sub(r"([+-]?\d+)\s*([a-z]+)", "", body).strip():
        return None
    total = 0
    for n, unit in parts:
        factor = _UNITS.get(unit) or _UNITS.get(unit.rstrip("s"))
        if not factor:
            return None
        total += int(n) * factor
    return total


def memory_bytes(text: str) -> int | None:
    m = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]*)\s*", text)
    unit = m[2].lower().removesuffix("ytes").removesuffix("yte") if m else ""
    return int(m[1]) * _BYTES[unit] if m and unit in _BYTES else None


def memory_bytes_column(c: Column) -> Column:
    number = F.regexp_extract(c, r"^\s*(\d+)", 1).cast("long")
    unit = F.lower(F.regexp_extract(c, r"([A-Za-z]*)\s*$", 1))
    return number * F.create_map(*[F.lit(x) for pair in _BYTES.items() for x in pair])[unit].cast("long")


def normal_path(c: Column) -> Column:
    """Without the spellings of file:, and without doubled slashes after the scheme."""
    bare = F.regexp_replace(c, r"^file:/+", "/")
    return F.regexp_replace(bare, r"(?<!:)/{2,}", "/")


def metadata_version(name: Column) -> Column:
    """The version in v3.metadata.json or 00003-<uuid>.metadata.json, gzipped or not."""
    found = F.regexp_extract(name, r"(?:^|/)(?:v(\d+)|(\d+)-[^/]*)(?:\.gz)?\.metadata\.json(?:\.gz)?$", 1)
    other = F.regexp_extract(name, r"(?:^|/)(?:v(\d+)|(\d+)-[^/]*)(?:\.gz)?\.metadata\.json(?:\.gz)?$", 2)
    return F.coalesce(F.expr("nullif('', '')"), F.when(found != "", found), F.when(other != "", other)).cast("int")


def partition_time(c: Column, pattern: str | None = None) -> Column:
    """A partition's time by its formatter, or by the usual patterns; null if unreadable."""
    if pattern:
        return F.try_to_timestamp(c, F.lit(pattern))
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")), F.try_to_timestamp(c, F.lit("yyyyMMdd")))


def url_path(c: Column) -> Column:
    """Percent-decoded, a plus sign stays."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def bytes_text(c: Column) -> Column:
    """1,023 B, 1.5 KiB, 2.0 MiB."""
    unit = lambda n, name: F.concat(F.format_number(c / n, 1), F.lit(f" {name}"))
    return F.when(c < 1 << 10, F.concat(F.format_number(c, 0), F.lit(" B"))).when(c < 1 << 20, unit(1 << 10, "KiB")).when(c < 1 << 30, unit(1 << 20, "MiB")).when(c < 1 << 40, unit(1 << 30, "GiB")).otherwise(unit(1 << 40, "TiB"))


def utc_day(c: Column) -> Column:
    return F.date_trunc("DAY", c)
