"""Partition transforms as expressions, and the bucket hash."""

from __future__ import annotations

import datetime
import struct
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- date transforms: ordinals from 1970, floor before it


def year(c: Column) -> Column:
    return F.year(c) - 1970


def month(c: Column) -> Column:
    return (F.year(c) - 1970) * 12 + F.month(c) - 1


def day(c: Column) -> Column:
    return F.unix_date(c.cast("date"))


def hour(c: Column) -> Column:
    """Hours of a timestamp, in UTC."""
    return F.unix_date(c.cast("date")) * 24 + F.hour(c)


def truncate_number(c: Column, width: int) -> Column:
    return c - F.pmod(c, F.lit(width))


def truncate_text(c: Column, width: int) -> Column:
    return F.substring(c, 1, width)


def result_type(transform: str, source: str) -> str:
    name = transform.split("[")[0]
    return {"day": "date", "year": "int", "month": "int", "hour": "int", "bucket": "int"}.get(name, source)


def human(transform: str, c: Column) -> Column:
    """An ordinal as text: 1999, 1999-07, 1999-07-03, 1999-07-03-21."""
    if transform == "year":
        return (c + 1970).cast("string")
    if transform == "month":
        return F.concat_ws("-", (F.floor(c / 12) + 1970).cast("string"), F.lpad((F.pmod(c, F.lit(12)) + 1).cast("string"), 2, "0"))
    if transform == "day":
        return F.date_from_unix_date(c.cast("int")).cast("string")
    if transform == "hour":
        return F.concat_ws("-", F.date_from_unix_date(F.floor(c / 24).cast("int")).cast("string"), F.lpad(F.pmod(c, F.lit(24)).cast("string"), 2, "0"))
    return c.cast("string")


def crosses(transform: str, op: str) -> bool:
    """Whether a comparison with a literal may be asked of the transformed values."""
    name = transform.split("[")[0]
    if name == "identity":
        return True
    if name == "bucket":
        return op == "="
    return op in ("=", "<", "<=", ">", ">=") and name in ("year", "month", "day", "hour", "truncate")


# ---- murmur3 x86 32 bit, seed 0 (Austin Appleby's public algorithm)

_C1, _C2, _M = 0xCC9E2D51, 0x1B873593, 0xFFFFFFFF


def murmur3(data: bytes, seed: int = 0) -> int:
    h, n = seed, len(data)
    for k in range(0, n - n % 4, 4):
        x = int.from_bytes(data[k : k + 4], "little") * _C1 & _M
        x = (x << 15 | x >> 17) * _C2 & _M
        h ^= x
        h = ((h << 13 | h >> 19) & _M) * 5 + 0xE6546B64 & _M
    tail = data[n - n % 4 :]
    if tail:
        x = int.from_bytes(tail, "little") * _C1 & _M
        h ^= (x << 15 | x >> 17) * _C2 & _M
    h ^= n
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & _M
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def bucket_bytes(value: object) -> bytes | None:
    """The bytes that are hashed; None for types that have no bucket."""
    if value is None or isinstance(value, (bool, float)):
        return None
    if isinstance(value, int):
        return struct.pack("<q", value)
    if isinstance(value, str):
        return value.encode()
    if isinstance(value, Decimal):
        unscaled = int(value.scaleb(-value.as_tuple().exponent))
        return unscaled.to_bytes(max(1, (unscaled.bit_length() + 8) // 8), "big", signed=True)
    if isinstance(value, datetime.datetime):
        at = value if value.tzinfo else value.replace(tzinfo=datetime.timezone.utc)
        return struct.pack("<q", (at - datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)) // datetime.timedelta(microseconds=1))
    if isinstance(value, datetime.date):
        return struct.pack("<q", (value - datetime.date(1970, 1, 1)).days)
    return bytes(value)


def bucket_of(value: object, n: int) -> int | None:
    data = bucket_bytes(value)
    return None if data is None else (murmur3(data) & 0x7FFFFFFF) % n


def murmur3_longs(values: np.ndarray) -> np.ndarray:
    """murmur3 of each value's 8 little-endian bytes, vectorised."""
    v = values.astype(np.int64).view(np.uint64)
    h = np.zeros(len(v), np.uint64)
    m = np.uint64(_M)
    for part in (v & m, v >> np.uint64(32)):
        x = part * np.uint64(_C1) & m
        x = (x << np.uint64(15) | x >> np.uint64(17)) * np.uint64(_C2) & m
        h ^= x
        h = ((h << np.uint64(13) | h >> np.uint64(19)) & m) * np.uint64(5) + np.uint64(0xE6546B64) & m
    h ^= np.uint64(8)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(factor) & m
    return h ^ h >> np.uint64(16)


def bucket(c: Column, n: int) -> Column:
    """bucket[n] of an integer column, by Arrow batches."""

    @F.pandas_udf("int")
    def run(values: pd.Series) -> pd.Series:
        known = values.notna()
        out = pd.Series([None] * len(values), dtype="Int32")
        out[known] = ((murmur3_longs(values[known].to_numpy(np.int64)) & np.uint64(0x7FFFFFFF)) % np.uint64(n)).astype(np.int32)
        return out

    return run(c.cast("long"))
