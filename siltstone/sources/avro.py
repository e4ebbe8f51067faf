"""Avro object container files (the public specification), decoded in Python: Spark's own reader is a separate jar.

Every record keeps its own error: one that fails to decode becomes an error row and ends its block; other blocks go on.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

MAGIC = b"Obj\x01"


class Reader(io.BytesIO):
    def long(self) -> int:
        n = shift = 0
        while True:
            b = self.read(1)
            if not b:
                raise EOFError("a number is cut off")
            n |= (b[0] & 0x7F) << shift
            if not b[0] & 0x80:
                return n >> 1 ^ -(n & 1)
            shift += 7

    def bytes(self) -> bytes:
        n = self.long()
        out = self.read(n)
        if n < 0 or len(out) < n:
            raise EOFError("bytes are cut off")
        return out


def value(r: Reader, schema, named: dict):
    kind = schema if isinstance(schema, str) else "union" if isinstance(schema, list) else schema["type"]
    if isinstance(kind, (dict, list)):
        return value(r, kind, named)
    if kind in ("int", "long"):
        return r.long()
    if kind == "string":
        return r.bytes().decode()
    if kind == "bytes":
        return r.bytes()
    if kind == "null":
        return None
    if kind == "boolean":
        return r.read(1) == b"\x01"
    if kind == "float":
        return struct.unpack("<f", r.read(4))[0]
    if kind == "double":
        return struct.unpack("<d", r.read(8))[0]
    if kind == "union":
        return value(r, schema[r.long()], named)
    if kind == "fixed":
        named[schema["name"]] = schema
        return r.read(schema["size"])
    if kind == "enum":
        named[schema["name"]] = schema
        return schema["symbols"][r.long()]
    if kind == "record":
        named[schema["name"]] = schema
        return {f["name"]: value(r, f["type"], named) for f in schema["fields"]}
    if kind in ("array", "map"):
        out: list | dict = [] if kind == "array" else {}
        while n := r.long():
            if n < 0:
                n = -n
                r.long()
            for _ in range(n):
                if kind == "array":
                    out.append(value(r, schema["items"], named))
                else:
                    key = r.bytes().decode()
                    out[key] = value(r, schema["values"], named)
        return out
    return value(r, named[kind], named)


def _unpack(block: bytes, codec: str) -> bytes:
    if codec == "null":
        return block
    if codec == "deflate":
        return zlib.decompress(block, -15)
    if codec == "zstandard":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(block)
    if codec == "bzip2":
        import bz2

        return bz2.decompress(block)
    if codec == "xz":
        import lzma

        return lzma.decompress(block)
    if codec == "snappy":
        import pyarrow as pa

        size = shift = k = 0
        while True:  # the length in front of a raw snappy block
            size |= (block[k] & 0x7F) << shift
            k += 1
            if not block[k - 1] & 0x80:
                break
            shift += 7
        return pa.decompress(block[:-4], size, "snappy").to_pybytes()
    raise ValueError(f"unknown codec {codec}")


def _press(block: bytes, codec: str) -> bytes:
    if codec == "null":
        return block
    if codec == "deflate":
        press = zlib.compressobj(wbits=-15)
        return press.compress(block) + press.flush()
    if codec == "zstandard":
        import zstandard

        return zstandard.ZstdCompressor().compress(block)
    if codec == "bzip2":
        import bz2

        return bz2.compress(block)
    if codec == "xz":
        import lzma

        return lzma.compress(block)
    raise ValueError(f"no writer for codec {codec}")


def _number(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = b""
    while n & ~0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def transcode(data: bytes, codec: str = "deflate") -> bytes:
    """The same container under another codec. Blocks are unpacked and packed again; no record is decoded."""
    _, meta, r = header(data)
    old = meta.get("avro.codec", b"null").decode()
    meta = {**meta, "avro.codec": codec.encode()}
    sync = r.read(16)
    heads = _number(len(meta)) + b"".join(_number(len(k.encode())) + k.encode() + _number(len(v)) + v for k, v in meta.items()) + _number(0)
    out = [MAGIC, heads, sync]
    while r.tell() < len(data):
        n, block = r.long(), r.bytes()
        if r.read(16) != sync:
            raise ValueError("a sync marker is missing")
        block = _press(_unpack(block, old), codec)
        out += [_number(n), _number(len(block)), block, sync]
    return b"".join(out)


def header(data: bytes) -> tuple[dict, dict[str, bytes], Reader]:
    """The schema, the key-value header, and a reader behind them."""
    r = Reader(data)
    if r.read(4) != MAGIC:
        raise ValueError("not an Avro file")
    meta = value(r, {"type": "map", "values": "bytes"}, {})
    return json.loads(meta["avro.schema"]), meta, r


def records(data: bytes) -> Iterator[tuple[dict | None, str | None]]:
    """(record, error) of each record."""
    schema, meta, r = header(data)
    codec = meta.get("avro.codec", b"null").decode()
    sync = r.read(16)
    while r.tell() < len(data):
        n, block = r.long(), r.bytes()
        if r.read(16) != sync:
            yield None, "a sync marker is missing"
            return
        try:
            inner = Reader(_unpack(block, codec))
        except Exception as e:  # noqa: BLE001  a block's error is data here
            yield None, f"{type(e).__name__}: {e}"
            continue
        for _ in range(n):
            try:
                yield value(inner, schema, {}), None
            except Exception as e:  # noqa: BLE001
                yield None, f"{type(e).__name__}: {e}"
                break


def column_tree(schema, name: str = "", field_id: int | None = None) -> dict:
    """{name, id, kind, children} of an Avro schema; nullable unions are read through."""
    if isinstance(schema, list):
        schema = next((s for s in schema if s != "null"), "null")
    kind = schema if isinstance(schema, str) else schema["type"]
    if isinstance(kind, dict):
        return column_tree(kind, name, field_id)
    children = []
    if kind == "record":
        children = [column_tree(f["type"], f["name"], f.get("field-id")) for f in schema["fields"]]
    elif kind == "array":
        children = [column_tree(schema["items"], "element", schema.get("element-id"))]
    elif kind == "map":
        children = [column_tree("string", "key", schema.get("key-id")), column_tree(schema["values"], "value", schema.get("value-id"))]
    return {"name": name, "id": field_id, "kind": {"record": "struct", "array": "list"}.get(kind, kind if kind == "map" else "primitive"), "children": children}


def _plain(x):
    if isinstance(x, bytes):
        return x.hex()
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, list) else x


def read_avro(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, row_index, record as JSON with bytes in hex, error); one task's memory holds one file."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = [(path, k, None if rec is None else json.dumps(_plain(rec)), error) for k, (rec, error) in enumerate(records(content))]
                except Exception as e:  # noqa: BLE001
                    found = [(path, 0, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(found, columns=["path", "row_index", "record", "error"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(run, "path string, row_index long, record string, error string")


def write_records(schema: dict, rows: list[dict], codec: str = "null", meta: dict[str, bytes] | None = None) -> bytes:
    """A container file, for fixtures and round trips."""
    named: dict[str, dict] = {}

    def put(x, s) -> bytes:
        if isinstance(s, dict) and "name" in s:
            named[s["name"]] = s
        s = named.get(s, s) if isinstance(s, str) else s
        kind = s if isinstance(s, str) else "union" if isinstance(s, list) else s["type"]
        if isinstance(kind, (dict, list)):
            return put(x, kind)
        if kind == "union":
            k = next(i for i, o in enumerate(s) if (o == "null") == (x is None))
            return _number(k) + put(x, s[k])
        if kind == "null":
            return b""
        if kind in ("int", "long"):
            return _number(x)
        if kind in ("string", "bytes"):
            body = x.encode() if isinstance(x, str) else x
            return _number(len(body)) + body
        if kind == "boolean":
            return bytes([x])
        if kind == "float":
            return struct.pack("<f", x)
        if kind == "double":
            return struct.pack("<d", x)
        if kind == "fixed":
            return x
        if kind == "record":
            return b"".join(put(x.get(f["name"]), f["type"]) for f in s["fields"])
        if kind == "array":
            return (_number(len(x)) + b"".join(put(v, s["items"]) for v in x) if x else b"") + _number(0)
        return (_number(len(x)) + b"".join(put(k, "string") + put(v, s["values"]) for k, v in x.items()) if x else b"") + _number(0)

    body = _press(b"".join(put(r, schema) for r in rows), codec)
    sync = bytes(range(16))
    heads = {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode(), **(meta or {})}
    return MAGIC + put(heads, {"type": "map", "values": "bytes"}) + sync + _number(len(rows)) + _number(len(body)) + body + sync
