"""Folders and files through Hadoop's file systems, so that any location Spark can read works; nothing is ever written."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ICEBERG, PAIMON, DELTA, UNKNOWN = "ICEBERG", "PAIMON", "DELTA", "UNKNOWN"
READABLE = ("parquet", "avro", "orc")


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(path))


def detect(spark: SparkSession, folder: str) -> str:
    """The format a folder holds: by metadata/*.metadata.json, snapshot/ and schema/, or _delta_log/ with a version."""
    top = set(names(spark, folder))
    if "metadata" in top and any(".metadata.json" in n for n in names(spark, f"{folder}/metadata")):
        return ICEBERG
    if {"snapshot", "schema"} <= top:
        return PAIMON
    if "_delta_log" in top and any(n.split(".")[0].isdigit() for n in names(spark, f"{folder}/_delta_log")):
        return DELTA
    return UNKNOWN


def tables(spark: SparkSession, root: str, depth: int = 4) -> dict[str, str]:
    """Tables under a warehouse root, with their formats."""
    kind = detect(spark, root)
    if kind != UNKNOWN or depth == 0:
        return {root: kind} if kind != UNKNOWN else {}
    out: dict[str, str] = {}
    for name in names(spark, root):
        if not name.startswith(("_", ".")):
            out |= tables(spark, f"{root}/{name}", depth - 1)
    return out


def glob(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """(path, size) of the files a pattern names, on any file system that Hadoop knows (s3a, gs, abfss, webhdfs, hdfs, file)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted((s.getPath().toString(), s.getLen()) for s in found or [] if s.isFile())


def content(spark: SparkSession, path: str, most: int = 64 << 20) -> bytes:
    """A small file of metadata, whole; a larger one is refused, as it would have to pass through the driver."""
    row = spark.read.format("binaryFile").load(escaped(path)).select("length", F.when(F.col("length") <= most, F.col("content")).alias("content")).first()
    if row.content is None:
        raise ValueError(f"{path} has {row.length} bytes")
    return bytes(row.content)


class ReadOnly:
    """A file system as this engine uses it: listing and reading; whatever would change it is refused by its type."""

    def __init__(self, spark: SparkSession):
        self._spark = spark

    def names(self, folder: str) -> list[str]:
        return names(self._spark, folder)

    def glob(self, pattern: str) -> list[tuple[str, int]]:
        return glob(self._spark, pattern)

    def content(self, path: str) -> bytes:
        return content(self._spark, path)

    def _refuse(self, *_, **__):
        raise PermissionError("tables are only read")

    create = append = delete = rename = mkdirs = copy = set_attribute = _refuse


@dataclass(frozen=True)
class Credential:
    """Keys of one bucket or account. They go to the session's Hadoop settings and nowhere else, and are never shown."""

    scheme: str  # s3a, gs or abfss
    bucket: str
    key: str
    secret: str = field(repr=False)
    endpoint: str | None = None

    def settings(self) -> dict[str, str]:
        if self.scheme in ("s3", "s3a"):
            out = {f"fs.s3a.bucket.{self.bucket}.access.key": self.key, f"fs.s3a.bucket.{self.bucket}.secret.key": self.secret}
            return out | ({f"fs.s3a.bucket.{self.bucket}.endpoint": self.endpoint} if self.endpoint else {})
        if self.scheme == "gs":
            return {"fs.gs.auth.type": "SERVICE_ACCOUNT_JSON_KEYFILE", "fs.gs.auth.service.account.json.keyfile": self.secret}
        if self.scheme == "abfss":
            return {f"fs.azure.account.key.{self.bucket}": self.secret}
        raise ValueError(f"no credentials for scheme {self.scheme}")

    def apply(self, spark: SparkSession) -> None:
        conf = spark._jsc.hadoopConfiguration()
        for k, v in self.settings().items():
            conf.set(k, v)


def root_path(spark: SparkSession, table: str) -> str:
    """The table's folder without scheme and authority."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath().rstrip("/")


def whole_path(path: Column, root: str) -> Column:
    """A decoded path as one below the file system's root: relative ones are the table's, a scheme and authority go."""
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.regexp_replace(F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit(root + "/"), bare)), "/+", "/")


def escaped(path: str) -> str:
    """A path for a reader that would take brackets, braces and stars for a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Every file below a folder (path, size, modified in ms); contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return rows.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified"))


def readable(path: str) -> str:
    """The extension of a data file that can be read; others are refused."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in READABLE:
        raise ValueError(f"not a readable data file: {path}")
    return kind


def data_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One scan over data files of one kind with their path and row number; folder names never become columns."""
    kinds = {readable(p) for p in paths}
    if len(kinds) != 1:
        raise ValueError("data files of several kinds")
    kind = kinds.pop()
    if kind == "avro":
        from siltstone.sources.avro import read_avro

        return read_avro(spark, paths)
    rows = spark.read.format(kind).load(paths)
    extra = [F.col("_metadata.file_path").alias("file_path")]
    if kind == "parquet":
        extra.append(F.col("_metadata.row_index").alias("row_index"))
    return rows.select("*", *extra)


def row_groups(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, row_group, start, rows, bytes) from Parquet footers, read on the executors."""
    import pandas as pd

    def run(batches):
        import io

        import pyarrow.parquet as pq

        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                meta = pq.ParquetFile(io.BytesIO(content)).metadata
                for k in range(meta.num_row_groups):
                    group, first = meta.row_group(k), meta.row_group(k).column(0)
                    start = min(x for x in (first.dictionary_page_offset, first.data_page_offset) if x)
                    out.append((path, k, start, group.num_rows, group.total_byte_size))
            yield pd.DataFrame(out, columns=["path", "row_group", "start", "rows", "bytes"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(run, "path string, row_group int, start long, rows long, bytes long")


def column_tree(schema, name: str = "", field_id: int | None = None) -> dict:
    """{name, id, kind, children} of an Arrow schema or type, with Parquet field ids; list and map wrappers folded."""
    import pyarrow as pa

    def own_id(field) -> int | None:
        text = (field.metadata or {}).get(b"PARQUET:field_id")
        return int(text) if text else None

    if isinstance(schema, pa.Schema):
        return {"name": name, "id": field_id, "kind": "struct", "children": [column_tree(f.type, f.name, own_id(f)) for f in schema]}
    children, kind = [], "primitive"
    if pa.types.is_struct(schema):
        kind, children = "struct", [column_tree(schema.field(k).type, schema.field(k).name, own_id(schema.field(k))) for k in range(schema.num_fields)]
    elif pa.types.is_map(schema):
        kind, children = "map", [column_tree(schema.key_type, "key", own_id(schema.key_field)), column_tree(schema.item_type, "value", own_id(schema.item_field))]
    elif pa.types.is_list(schema) or pa.types.is_large_list(schema):
        kind, children = "list", [column_tree(schema.value_type, "element", own_id(schema.value_field))]
    return {"name": name, "id": field_id, "kind": kind, "children": children}


def parquet_columns(spark: SparkSession, path: str) -> list[tuple[str, int | None, str]]:
    """(dotted name, field id, kind) of a file's columns, from its footer."""
    import io

    import pyarrow.parquet as pq

    content = spark.read.format("binaryFile").load(path).select("content").first().content
    out = []

    def walk(node: dict, prefix: str) -> None:
        for c in node["children"]:
            out.append((prefix + c["name"], c["id"], c["kind"]))
            walk(c, f"{prefix}{c['name']}.")

    walk(column_tree(pq.read_schema(io.BytesIO(content))), "")
    return out


def location(text: str) -> tuple[str, str]:
    """(scheme, path) of a location; an unserved scheme is an error, never a relative path."""
    scheme, found, rest = text.partition("://")
    if not found:
        return ("file", text[len("file:") :]) if text.startswith("file:") else ("file", text)
    if scheme not in ("file", "s3", "s3a", "gs", "hdfs", "webhdfs", "abfss", "viewfs"):
        raise ValueError(f"unserved scheme {scheme}")
    return scheme, rest


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a scratch file (never into a table), through Hadoop's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data))
    out.close()
