"""Public binary formats: hashes, Z85, roaring bitmaps, Puffin, single values, bit-sliced and other row indexes."""

from __future__ import annotations

import datetime
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- hashes


def xxhash64(data: bytes, seed: int = 0) -> int:
    h = xxhash.xxh64_intdigest(data, seed)
    return h - (1 << 64) if h >> 63 else h


@F.pandas_udf(T.LongType())
def xxhash64_column(values: pd.Series) -> pd.Series:
    """XXH64 with seed 0 of a string's UTF-8 bytes (Spark's own function has seed 42)."""
    return values.map(lambda v: None if v is None else xxhash64(v.encode() if isinstance(v, str) else bytes(v))).astype("Int64")


def wang_longs(values: np.ndarray) -> np.ndarray:
    """Thomas Wang's 64-bit mix, in wrapping arithmetic."""
    u = np.uint64
    key = values.astype(np.int64).view(np.uint64)
    key = ~key + (key << u(21))
    key = key ^ key >> u(24)
    key = key + (key << u(3)) + (key << u(8))
    key = key ^ key >> u(14)
    key = key + (key << u(2)) + (key << u(4))
    key = key ^ key >> u(28)
    return (key + (key << u(31))).view(np.int64)


def wang(c: Column) -> Column:
    @F.pandas_udf(T.LongType())
    def run(values: pd.Series) -> pd.Series:
        known = values.notna()
        out = pd.Series([None] * len(values), dtype="Int64")
        out[known] = wang_longs(values[known].to_numpy(np.int64))
        return out

    return run(c.cast("long"))


def wang_int(key: int) -> int:
    m = (1 << 64) - 1
    key &= m
    key = (~key + (key << 21)) & m
    key ^= key >> 24
    key = (key + (key << 3) + (key << 8)) & m
    key ^= key >> 14
    key = (key + (key << 2) + (key << 4)) & m
    key ^= key >> 28
    key = (key + (key << 31)) & m
    return key - (1 << 64) if key >> 63 else key


# ---- Z85 (ZeroMQ RFC 32)

#: The alphabet of the public Z85 specification.
Z85 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.-:+=^!/*?&<>()[]{}@%$#"


def z85_decode(text: str) -> bytes:
    if len(text) % 5:
        raise ValueError("Z85 text comes in fives")
    out = b""
    for k in range(0, len(text), 5):
        n = 0
        for c in text[k : k + 5]:
            n = n * 85 + Z85.index(c)
        out += n.to_bytes(4, "big")
    return out


def z85_encode(data: bytes) -> str:
    out = ""
    for k in range(0, len(data), 4):
        n, some = int.from_bytes(data[k : k + 4], "big"), ""
        for _ in range(5):
            n, r = divmod(n, 85)
            some = Z85[r] + some
        out += some
    return out


# ---- roaring bitmaps (the public format specification)


def roaring32(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """Values of a serialized 32-bit bitmap, and where it ends."""
    cookie = struct.unpack_from("<I", data, at)[0]
    start = at
    runs = b""
    if cookie & 0xFFFF == 12347:
        n = (cookie >> 16) + 1
        at += 4
        runs = data[at : at + (n + 7) // 8]
        at += (n + 7) // 8
    elif cookie == 12346:
        n = struct.unpack_from("<I", data, at + 4)[0]
        at += 8
    else:
        raise ValueError(f"not a roaring bitmap: cookie {cookie}")
    heads = [struct.unpack_from("<HH", data, at + 4 * k) for k in range(n)]
    at += 4 * n
    if not runs or n >= 4:
        at += 4 * n  # offsets
    out = [np.zeros(0, np.uint64)]
    for k, (key, less) in enumerate(heads):
        if runs and runs[k // 8] >> k % 8 & 1:
            count = struct.unpack_from("<H", data, at)[0]
            pairs = np.frombuffer(data, "<u2", 2 * count, at + 2).reshape(-1, 2).astype(np.int64)
            at += 2 + 4 * count
            low = np.concatenate([np.arange(a, a + b + 1) for a, b in pairs]) if count else np.zeros(0, np.int64)
        elif less + 1 <= 4096:
            low = np.frombuffer(data, "<u2", less + 1, at).astype(np.int64)
            at += 2 * (less + 1)
        else:
            low = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, 8192, at), bitorder="little"))
            at += 8192
        out.append((low + (key << 16)).astype(np.uint64))
    del start
    return np.concatenate(out), at


def roaring64(data: bytes, at: int = 0) -> np.ndarray:
    """Values of the portable 64-bit form: a count, then (high word, 32-bit bitmap)."""
    n = struct.unpack_from("<Q", data, at)[0]
    at += 8
    out = [np.zeros(0, np.uint64)]
    for _ in range(n):
        high = struct.unpack_from("<I", data, at)[0]
        low, at = roaring32(data, at + 4)
        out.append(low + np.uint64(high << 32))
    return np.concatenate(out)


def roaring32_encode(values: list[int]) -> bytes:
    """Array and bitmap containers, for round trips."""
    groups: dict[int, list[int]] = {}
    for v in sorted(set(values)):
        groups.setdefault(v >> 16, []).append(v & 0xFFFF)
    body, offsets = [], []
    at = 8 + 8 * len(groups)
    for low in groups.values():
        if len(low) <= 4096:
            piece = np.array(low, "<u2").tobytes()
        else:
            bits = np.zeros(65536, np.uint8)
            bits[low] = 1
            piece = np.packbits(bits, bitorder="little").tobytes()
        offsets.append(at)
        body.append(piece)
        at += len(piece)
    heads = b"".join(struct.pack("<HH", k, len(v) - 1) for k, v in groups.items())
    return struct.pack("<II", 12346, len(groups)) + heads + struct.pack(f"<{len(offsets)}I", *offsets) + b"".join(body)


def roaring64_encode(values: list[int]) -> bytes:
    groups: dict[int, list[int]] = {}
    for v in values:
        groups.setdefault(v >> 32, []).append(v & 0xFFFFFFFF)
    return struct.pack("<Q", len(groups)) + b"".join(struct.pack("<I", k) + roaring32_encode(v) for k, v in sorted(groups.items()))


VECTOR_MAGIC = b"\xd1\xd3\x39\x64"


def vector_blob(data: bytes) -> np.ndarray:
    """Positions of a framed deletion vector: length, magic, 64-bit bitmap, CRC-32; big-endian frame, checked."""
    size = struct.unpack_from(">I", data)[0]
    body = data[4 : 4 + size]
    if body[:4] != VECTOR_MAGIC:
        raise ValueError("not a deletion vector")
    if struct.unpack_from(">I", data, 4 + size)[0] != zlib.crc32(body):
        raise ValueError("the deletion vector's checksum differs")
    return roaring64(body, 4)


def vector_blob_encode(positions: list[int]) -> bytes:
    body = VECTOR_MAGIC + roaring64_encode(positions)
    return struct.pack(">I", len(body)) + body + struct.pack(">I", zlib.crc32(body))


def inline_vector(text: str, size: int | None = None) -> np.ndarray:
    """Positions of a Z85-encoded inline vector: magic (little-endian number) and 64-bit bitmap."""
    data = z85_decode(text)[:size]
    return roaring64(data, 4)


# ---- Puffin (the public specification)

PUFFIN = b"PFA1"


def puffin_footer(data: bytes) -> dict:
    """The footer's JSON: {blobs: [...], properties}."""
    if data[:4] != PUFFIN or data[-4:] != PUFFIN:
        raise ValueError("not a Puffin file")
    size, flags = struct.unpack("<iI", data[-12:-4])
    start = len(data) - 12 - size
    if data[start - 4 : start] != PUFFIN:
        raise ValueError("the footer's magic is missing")
    if flags & 1:
        raise ValueError("the footer is compressed")
    return json.loads(data[start : start + size])


def puffin_sizes(data: bytes) -> tuple[int, int]:
    size = struct.unpack("<i", data[-12:-8])[0]
    return len(data), size + 16


def puffin_encode(blobs: list[tuple[dict, bytes]]) -> bytes:
    out, listed = PUFFIN, []
    for meta, body in blobs:
        listed.append({**meta, "offset": len(out), "length": len(body)})
        out += body
    footer = json.dumps({"blobs": listed}).encode()
    return out + PUFFIN + footer + struct.pack("<iI", len(footer), 0) + PUFFIN


# ---- single values (the public single-value serialization)


def single_value(data: bytes | None, kind: str):
    """Bytes of a bound as a value of the column's type; narrower bytes of a promoted column are widened."""
    if data is None:
        return None
    if kind == "boolean":
        return data != b"\x00"
    if kind in ("int", "long", "date", "time", "timestamp", "timestamptz"):
        n = int.from_bytes(data, "little", signed=True)
        if kind == "date":
            return datetime.date(1970, 1, 1) + datetime.timedelta(days=n)
        if kind == "time":
            return (datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=n)).time()
        if kind.startswith("timestamp"):
            zone = datetime.timezone.utc if kind == "timestamptz" else None
            return datetime.datetime(1970, 1, 1, tzinfo=zone) + datetime.timedelta(microseconds=n)
        return n
    if kind in ("float", "double"):
        return struct.unpack("<f" if len(data) == 4 else "<d", data)[0]
    if kind == "string":
        return data.decode()
    if kind == "uuid":
        return str(uuid.UUID(bytes=data))
    if kind.startswith("decimal"):
        scale = int(kind.split(",")[1].rstrip(") "))
        return Decimal(int.from_bytes(data, "big", signed=True)).scaleb(-scale)
    return data


# ---- row indexes


class BitSliced:
    """Bit slices of signed numbers: every comparison is answered by at most 64 word operations a block."""

    def __init__(self, values: list[int | None]):
        v = np.array([0 if x is None else x for x in values], np.int64)
        self.known = np.array([x is not None for x in values])
        self.low = int(v[self.known].min()) if self.known.any() else 0
        shifted = (v - self.low).astype(np.uint64)
        self.bits = max(1, int(shifted[self.known].max()).bit_length()) if self.known.any() else 1
        self.slices = [((shifted >> np.uint64(b)) & np.uint64(1)).astype(bool) for b in range(self.bits)]

    def rows(self, op: str, value: int | None = None) -> np.ndarray:
        if op == "is null":
            return np.flatnonzero(~self.known)
        if op == "is not null":
            return np.flatnonzero(self.known)
        x = value - self.low
        equal, less = self.known.copy(), np.zeros_like(self.known)
        if x < 0:
            equal[:] = False
        elif x >> self.bits:
            equal, less = np.zeros_like(self.known), self.known.copy()
        else:
            for b in range(self.bits - 1, -1, -1):
                if x >> b & 1:
                    less |= equal & ~self.slices[b]
                    equal &= self.slices[b]
                else:
                    equal &= ~self.slices[b]
        more = self.known & ~equal & ~less
        return np.flatnonzero({"=": equal, "<>": less | more, "<": less, "<=": less | equal, ">": more, ">=": more | equal}[op])


class Bitmaps:
    """A bitmap for each distinct value; exact rows for equality and null tests."""

    def __init__(self, values: list):
        self.n, self.of = len(values), {}
        for k, v in enumerate(values):
            self.of.setdefault(v, []).append(k)

    def rows(self, op: str, value=None) -> np.ndarray | None:
        every, null = np.arange(self.n), np.array(self.of.get(None, []), np.int64)
        own = np.array(self.of.get(value, []), np.int64)
        known = np.setdiff1d(every, null)
        return {"=": own, "<>": np.setdiff1d(known, own), "is null": null, "is not null": known}.get(op)


class RangeBitmaps:
    """A dictionary of ranks over bit slices: comparisons of any ordered type."""

    def __init__(self, values: list):
        self.words = sorted({v for v in values if v is not None})
        rank = {v: k for k, v in enumerate(self.words)}
        self.slices = BitSliced([None if v is None else rank[v] for v in values])

    def rows(self, op: str, value=None) -> np.ndarray:
        from bisect import bisect_left

        if op.startswith("is "):
            return self.slices.rows(op)
        k = bisect_left(self.words, value)
        there = k < len(self.words) and self.words[k] == value
        if there:
            return self.slices.rows(op, k)
        return {"=": np.zeros(0, np.int64), "<>": self.slices.rows("is not null"), "<": self.slices.rows("<", k), "<=": self.slices.rows("<", k), ">": self.slices.rows(">=", k), ">=": self.slices.rows(">=", k)}[op]


class Bloom:
    """k probes from the halves of a 64-bit hash."""

    def __init__(self, bits: np.ndarray, probes: int):
        self.bits, self.probes = bits, probes

    @classmethod
    def of(cls, hashes: list[int] | np.ndarray, size: int, probes: int) -> Bloom:
        out = cls(np.zeros(size, bool), probes)
        for at in out._at(hashes):
            out.bits[at] = True
        return out

    def _at(self, hashes: list[int] | np.ndarray) -> Iterator[np.ndarray]:
        """The places of all hashes, a probe at a time, in wrapping 32-bit arithmetic."""
        if not isinstance(hashes, np.ndarray):
            hashes = np.array([h & (1 << 64) - 1 for h in hashes], np.uint64).view(np.int64)
        one, two = hashes.astype(np.int32), (hashes >> 32).astype(np.int32)
        for k in range(1, self.probes + 1):
            both = one + np.int32(k) * two
            yield np.where(both < 0, ~both, both).astype(np.int64) % len(self.bits)

    def might_contain_each(self, hashes: list[int] | np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self._at(hashes):
            out &= self.bits[at]
        return out

    def might_contain(self, h: int) -> bool:
        return bool(self.might_contain_each([h])[0])


def fold_rows(f, leaf) -> np.ndarray | None:
    """Row sets of a filter: And intersects, Or unites; None: any row may match."""
    from siltstone.operators.predicates import And, Term, push_negation

    f = push_negation(f)
    if isinstance(f, Term):
        return leaf(f)
    found = [fold_rows(p, leaf) for p in f.parts]
    if isinstance(f, And):
        known = [x for x in found if x is not None]
        out = known[0] if known else None
        for x in known[1:]:
            out = np.intersect1d(out, x)
        return out
    if any(x is None for x in found):
        return None
    out = found[0]
    for x in found[1:]:
        out = np.union1d(out, x)
    return out


def vector_blob_raw(data: bytes) -> np.ndarray:
    """Positions of a stored vector: big-endian length, little-endian magic, 64-bit bitmap, CRC-32; checked."""
    size = struct.unpack_from(">I", data)[0]
    body = data[4 : 4 + size]
    if struct.unpack_from(">I", data, 4 + size)[0] != zlib.crc32(body):
        raise ValueError("the deletion vector's checksum differs")
    return roaring64(body, 4)


#: Magics of the two bitmaps, and magic and version of the file-index container.
BITMAP32_MAGIC = 1581511376
FILE_INDEX_MAGIC, FILE_INDEX_VERSION = 1493475289347502, 1


def bucket_vector(data: bytes, offset: int, length: int) -> np.ndarray:
    """Positions of one vector of a bucket's index file: a version byte, and at the offset a big-endian size, magic, bitmap
    and CRC-32. The recorded length of a 32-bit bitmap is that size, that of a 64-bit one the whole blob."""
    if not data or data[0] != 1:
        raise ValueError("an index file of another version")
    if offset < 1 or offset + 8 > len(data):
        raise ValueError("the vector lies outside its file")
    size = struct.unpack_from(">i", data, offset)[0]
    body = data[offset + 4 : offset + 4 + max(size, 0)]
    if size < 4 or offset + 8 + size > len(data):
        raise ValueError("the vector lies outside its file")
    wide = body[:4] == VECTOR_MAGIC
    if length != size + (8 if wide else 0):
        raise ValueError(f"{length} bytes are recorded for a vector of {size}")
    if struct.unpack_from(">I", data, offset + 4 + size)[0] != zlib.crc32(body):
        raise ValueError("the deletion vector's checksum differs")
    if wide:
        return roaring64(body, 4)
    if struct.unpack_from(">i", body)[0] != BITMAP32_MAGIC:
        raise ValueError("not a deletion vector")
    return roaring32(body, 4)[0]


def bucket_vectors_encode(vectors: list[tuple[list[int], bool]]) -> tuple[bytes, list[tuple[int, int]]]:
    """An index file of (positions, wide) vectors and the (offset, length) of each, for fixtures and round trips."""
    out, ranges = b"\x01", []
    for positions, wide in vectors:
        body = VECTOR_MAGIC + roaring64_encode(positions) if wide else struct.pack(">i", BITMAP32_MAGIC) + roaring32_encode(positions)
        ranges.append((len(out), len(body) + (8 if wide else 0)))
        out += struct.pack(">i", len(body)) + body + struct.pack(">I", zlib.crc32(body))
    return out, ranges


def file_index(data: bytes) -> dict[str, list[tuple[str, bytes | None]]]:
    """The indexes (type, bytes; None: left empty) of each column of a file-index container. Its head gives every index's
    place, measured from the container's start."""
    magic, version, head = struct.unpack_from(">qii", data)
    if magic != FILE_INDEX_MAGIC or version != FILE_INDEX_VERSION:
        raise ValueError("not a file index of this version")
    at = 16

    def number() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(">i", data, at - 4)[0]

    def word() -> str:
        nonlocal at
        n = struct.unpack_from(">H", data, at)[0]
        at += 2 + n
        return data[at - n : at].decode()

    out: dict[str, list[tuple[str, bytes | None]]] = {}
    for _ in range(number()):
        column = word()
        own = out.setdefault(column, [])
        for _ in range(number()):
            kind, start, length = word(), number(), number()
            if start != -1 and (start < head or start + length > len(data)):
                raise ValueError(f"the {kind} index of {column} lies outside its container")
            own.append((kind, None if start == -1 else data[start : start + length]))
    return out


def file_index_encode(columns: dict[str, list[tuple[str, bytes | None]]]) -> bytes:
    """A container, for fixtures and round trips."""
    word = lambda s: struct.pack(">H", len(s.encode())) + s.encode()
    size = 20 + sum(len(word(c)) + 4 + sum(len(word(k)) + 8 for k, _ in own) for c, own in columns.items())
    head, body = struct.pack(">i", len(columns)), b""
    for c, own in columns.items():
        head += word(c) + struct.pack(">i", len(own))
        for kind, content in own:
            head += word(kind) + struct.pack(">ii", -1 if content is None else size + len(body), len(content or b""))
            body += content or b""
    return struct.pack(">qii", FILE_INDEX_MAGIC, FILE_INDEX_VERSION, size) + head + body


def bloom_bytes(bloom: Bloom) -> bytes:
    """A stored filter: the number of probes, then the bits, lowest first in each byte."""
    return struct.pack(">i", bloom.probes) + np.packbits(bloom.bits, bitorder="little").tobytes()


def bloom_of(data: bytes) -> Bloom:
    return Bloom(np.unpackbits(np.frombuffer(data, np.uint8, offset=4), bitorder="little").astype(bool), struct.unpack_from(">i", data)[0])
