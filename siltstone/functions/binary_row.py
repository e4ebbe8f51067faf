"""Binary rows: a big-endian arity, null bits after eight bits of row kind, an 8-byte slot a field, and a tail."""

from __future__ import annotations

import datetime
import struct
from decimal import Decimal


def _fixed(kind: str) -> str | None:
    return {"BOOLEAN": "<?", "TINYINT": "<b", "SMALLINT": "<h", "INT": "<i", "BIGINT": "<q", "FLOAT": "<f", "DOUBLE": "<d", "DATE": "<i"}.get(kind.split(" ")[0].split("(")[0])


def _null_bytes(arity: int) -> int:
    return (arity + 8 + 63) // 64 * 8


def decode(data: bytes, kinds: list[str]) -> list | None:
    """One value a field; None if the bytes aren't a row of these fields. A field of another type is left as its bytes."""
    if len(data) < 4 or struct.unpack(">i", data[:4])[0] != len(kinds):
        return None
    row, head = data[4:], _null_bytes(len(kinds))
    if len(row) < head + 8 * len(kinds):
        return None
    out = []
    for k, kind in enumerate(kinds):
        at = head + 8 * k
        if row[(k + 8) // 8] >> (k + 8) % 8 & 1:
            out.append(None)
        elif form := _fixed(kind):
            v = struct.unpack_from(form, row, at)[0]
            out.append(datetime.date(1970, 1, 1) + datetime.timedelta(days=v) if kind.startswith("DATE") else v)
        elif kind.startswith("DECIMAL") and int(kind.split("(")[1].split(",")[0]) <= 18:
            scale = int(kind.split(",")[1].rstrip(") ").split(")")[0])
            out.append(Decimal(struct.unpack_from("<q", row, at)[0]).scaleb(-scale))
        else:
            if row[at + 7] & 0x80:  # up to seven bytes in the slot
                body = row[at : at + (row[at + 7] & 0x7F)]
            else:
                n, offset = struct.unpack_from("<II", row, at)
                body = row[offset : offset + n]
            out.append(body.decode() if kind.startswith(("STRING", "VARCHAR", "CHAR")) else body)
    return out


def encode(values: list, kinds: list[str]) -> bytes:
    """For fixtures and round trips."""
    head, slots, tail = bytearray(_null_bytes(len(kinds))), b"", b""
    base = len(head) + 8 * len(kinds)
    for k, (v, kind) in enumerate(zip(values, kinds, strict=True)):
        if v is None:
            head[(k + 8) // 8] |= 1 << (k + 8) % 8
            slots += bytes(8)
        elif form := _fixed(kind):
            n = (v - datetime.date(1970, 1, 1)).days if isinstance(v, datetime.date) else v
            slots += struct.pack(form, n).ljust(8, b"\0")
        elif isinstance(v, Decimal):
            slots += struct.pack("<q", int(v.scaleb(int(kind.split(",")[1].rstrip(") ")))))
        else:
            body = v.encode() if isinstance(v, str) else v
            if len(body) <= 7:
                slots += body.ljust(7, b"\0") + bytes([0x80 | len(body)])
            else:
                slots += struct.pack("<II", len(body), base + len(tail))
                tail += body.ljust((len(body) + 7) // 8 * 8, b"\0")
    return struct.pack(">i", len(kinds)) + bytes(head) + slots + tail


def partition_path(values: list, names: list[str], default: str = "__DEFAULT_PARTITION__") -> str:
    """name=value/... as folders are named; a legacy date is its day number."""
    text = lambda v: default if v is None else str((v - datetime.date(1970, 1, 1)).days) if isinstance(v, datetime.date) else str(v).lower() if isinstance(v, bool) else str(v)
    return "/".join(f"{n}={text(v)}" for n, v in zip(names, values, strict=True))


def bounds(least: bytes, greatest: bytes, nulls: list[int], names: list[str], kinds: list[str]) -> list[tuple] | None:
    """(name, least, greatest, nulls) of each field, or None if a row doesn't fit the fields."""
    a, b = decode(least, kinds), decode(greatest, kinds)
    return None if a is None or b is None else list(zip(names, a, b, nulls, strict=True))
