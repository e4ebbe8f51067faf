"""Queries of whole snapshot and keyed tables, read end to end: metadata, manifests, delete files, vectors, rows and fates."""

from __future__ import annotations

import json
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import binary_row, codecs
from siltstone.operators import graph, history
from siltstone.plans import tables
from siltstone.plans.facade import open_table
from siltstone.plans.fixtures import frame, scratch, sql
from siltstone.sources import avro, files, iceberg, paimon

_built: dict[tuple, str] = {}


def once(build):
    """A fixture table is written once a session."""

    def run(spark, d) -> str:
        key = (spark.sparkContext.applicationId, d, build.__name__)
        if key not in _built:
            _built[key] = build(spark, d)
        return _built[key]

    return run


def record(name: str, **fields) -> dict:
    return {"type": "record", "name": name, "fields": [{"name": n, "type": t} for n, t in fields.items()]}


def optional(kind) -> list:
    return ["null", kind]


def with_ids(df: DataFrame, **ids: int) -> DataFrame:
    return df.select(*[F.col(c).alias(c, metadata={"parquet.field.id": k}) for c, k in ids.items()])


# ---- a snapshot table of parts: a file for each remainder of the key, and every kind of delete

PARTS = "SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, CAST(p_partkey % 4 AS INT) AS k FROM {part} x"
FATES = """SELECT p_partkey, p_size, CASE WHEN k = 3 AND p_partkey % 29 < 3 THEN 'VECTOR_DELETED' WHEN k = 2 AND p_partkey % 17 = 0 THEN 'POSITION_DELETED'
    WHEN k IN (0, 1) AND p_partkey % 13 = 0 THEN 'EQUALITY_DELETED' WHEN k = 1 AND p_size = 7 THEN 'EQUALITY_DELETED' ELSE 'LIVE' END AS fate FROM (""" + PARTS + ") y"
_BOUND = {"type": "array", "items": record("b", key="int", value="bytes")}
_COUNT = {"type": "array", "items": record("n", key="int", value="long")}
_DATA = record(
    "data_file", content="int", file_path="string", file_format="string", partition=record("part", k=optional("int")), record_count="long", file_size_in_bytes="long", equality_ids=optional({"type": "array", "items": "int"}),
    referenced_data_file=optional("string"), content_offset=optional("long"), content_size_in_bytes=optional("long"), lower_bounds=optional(_BOUND), upper_bounds=optional(_BOUND), null_value_counts=optional(_COUNT),
)
_ENTRY = record("manifest_entry", status="int", snapshot_id=optional("long"), sequence_number=optional("long"), data_file=_DATA)
_LISTED = record("manifest_file", manifest_path="string", manifest_length="long", partition_spec_id="int", content="int", sequence_number="long")


def _one_file(spark, df: DataFrame, folder: str) -> tuple[str, int]:
    df.coalesce(1).write.parquet(folder)
    name = next(n for n in files.names(spark, folder) if n.endswith(".parquet"))
    return f"{folder}/{name}", spark.read.parquet(folder).count()


@once
def snapshot_table(spark, d) -> str:
    """Files 0 and 1 of sequence 1, 2 and 3 of sequence 3. An equality delete of sequence 2 on keys everywhere, one of
    sequence 4 on sizes in partition 1, positions in file 2, and a vector over file 3. File 0 has an older column name."""
    root, own = scratch(spark), sql(spark, d, PARTS)
    data, paths = [], {}
    for k in range(4):
        rows = own.filter(F.col("k") == k).orderBy("p_partkey")
        rows = with_ids(rows.withColumnRenamed("p_size", "old_size"), p_partkey=1, old_size=2, k=3) if k == 0 else with_ids(rows, p_partkey=1, p_size=2, k=3)
        paths[k], n = _one_file(spark, rows, f"{root}/data/{k}")
        ends = rows.agg(F.min("p_partkey").alias("a"), F.max("p_partkey").alias("b")).first()
        low, high = ([{"key": 1, "value": struct.pack("<q", x)}, {"key": 3, "value": struct.pack("<i", k)}] for x in ends)
        data.append((1 if k < 2 else 3, {"content": 0, "file_path": paths[k], "file_format": "PARQUET", "partition": {"k": k}, "record_count": n, "file_size_in_bytes": 100 + k, "lower_bounds": low, "upper_bounds": high, "null_value_counts": [{"key": 1, "value": 0}, {"key": 3, "value": 0}]}))
    at = lambda k, where: spark.read.parquet(paths[k]).select("*", F.col("_metadata.row_index").alias("pos")).filter(where)
    by_key, n_key = _one_file(spark, with_ids(own.filter("p_partkey % 13 = 0"), p_partkey=1), f"{root}/deletes/key")
    by_size, n_size = _one_file(spark, with_ids(own.filter("p_size = 7").select("p_size").distinct(), p_size=2), f"{root}/deletes/size")
    by_pos, n_pos = _one_file(spark, at(2, "p_partkey % 17 = 0").select(F.lit(paths[2]).alias("file_path"), "pos"), f"{root}/deletes/pos")
    marked = [r.pos for r in at(3, "p_partkey % 29 < 3").select("pos").collect()]
    blob = codecs.vector_blob_encode(marked)
    files.put(spark, f"{root}/deletes/v.puffin", codecs.puffin_encode([({"type": "deletion-vector-v1"}, blob)]))
    delete = lambda content, path, n, **more: {"content": content, "file_path": path, "file_format": "PARQUET", "partition": {"k": None}, "record_count": n, "file_size_in_bytes": 9, **more}
    vector = delete(1, f"{root}/deletes/v.puffin", len(marked), referenced_data_file=paths[3], content_offset=4, content_size_in_bytes=len(blob))
    groups = [
        (0, 0, 1, [e for s, e in data if s == 1]), (0, 0, 3, [e for s, e in data if s == 3]), (1, 1, 2, [delete(2, by_key, n_key, equality_ids=[1])]),
        (0, 1, 4, [{**delete(2, by_size, n_size, equality_ids=[2]), "partition": {"k": 1}}, {**delete(1, by_pos, n_pos), "partition": {"k": 2}}, {**vector, "file_format": "PUFFIN", "partition": {"k": 3}}]),
    ]
    listed = []
    for n, (spec, content, sequence, own_files) in enumerate(groups):
        entries = [{"status": 1, "snapshot_id": 4, "data_file": f} for f in own_files]
        if n == 0:
            entries.append({"status": 2, "snapshot_id": 4, "data_file": {**own_files[0], "file_path": f"{root}/data/gone.parquet"}})
        files.put(spark, f"{root}/metadata/m{n}.avro", avro.write_records(_ENTRY, entries, "deflate"))
        listed.append({"manifest_path": f"{root}/metadata/m{n}.avro", "manifest_length": 1, "partition_spec_id": spec, "content": content, "sequence_number": sequence})
    files.put(spark, f"{root}/metadata/snap-4.avro", avro.write_records(_LISTED, listed))
    by_region = frame(spark, d, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("data_record_count"))
    stats, _ = _one_file(spark, by_region.select(F.struct(F.col("n_regionkey").cast("int").alias("region")).alias("partition"), F.lit(0).alias("spec_id"), "data_record_count", F.lit(1).alias("data_file_count")), f"{root}/metadata/stats")
    field = lambda k, name, kind: {"id": k, "name": name, "required": False, "type": kind}
    meta = {
        "format-version": 3, "location": root, "current-schema-id": 0, "current-snapshot-id": 4, "last-sequence-number": 4, "last-column-id": 3, "last-updated-ms": 5,
        "schemas": [{"schema-id": 0, "fields": [field(1, "p_partkey", "long"), field(2, "p_size", "long"), field(3, "k", "int")]}],
        "partition-specs": [{"spec-id": 0, "fields": [{"source-id": 3, "field-id": 1000, "name": "k", "transform": "identity"}]}, {"spec-id": 1, "fields": []}],
        "snapshots": [{"snapshot-id": 4, "sequence-number": 4, "timestamp-ms": 5, "manifest-list": f"{root}/metadata/snap-4.avro", "schema-id": 0}],
        "partition-statistics": [{"snapshot-id": 4, "statistics-path": stats, "file-size-in-bytes": 1}, {"snapshot-id": 3, "statistics-path": f"{root}/gone.parquet", "file-size-in-bytes": 1}],
    }
    files.put(spark, f"{root}/metadata/v1.metadata.json", json.dumps(meta).encode())
    return root


def k2_snapshot(spark, d):
    return open_table(spark, snapshot_table(spark, d)).fates("p_size < 30").select("p_partkey", "p_size", F.col("_fate").alias("fate"))


def k1_snapshot(spark, d):
    return open_table(spark, snapshot_table(spark, d)).lookup("k >= 1 AND p_partkey > 100").select("p_partkey", "p_size")


def c21_snapshot(spark, d):
    return open_table(spark, snapshot_table(spark, d)).scan_plan("k = 2 AND p_partkey > 0").select(F.regexp_extract("path", r"/data/(\d)/", 1).cast("long").alias("k"), "rows", "skipped")


def a32(spark, d):
    rows = iceberg.partition_statistics(spark, snapshot_table(spark, d))
    return rows.select("snapshot_id", "resolution", F.coalesce("partition", F.lit("none")).alias("part"), F.col("data_record_count").alias("rows"))


def i6_bounds(spark, d):
    """The recorded bounds of the key in every file, decoded."""
    live = iceberg.live_files(spark, iceberg.version(spark, snapshot_table(spark, d))).filter("content = 0")

    @F.pandas_udf("bigint")
    def decoded(texts):
        return texts.map(lambda t: codecs.single_value(bytes.fromhex(t), "long"))

    at = lambda c: decoded(F.get(F.filter(c, lambda x: x.key == 1), F.lit(0))["value"])
    return live.select(F.get_json_object("partition", "$.k").cast("long").alias("k"), at("lower_bounds").alias("least"), at("upper_bounds").alias("greatest"))


def a26_snapshot(spark, d):
    v = iceberg.version(spark, snapshot_table(spark, d))
    return iceberg.vectors(spark, v, iceberg.live_files(spark, v)).groupBy(F.regexp_extract("file_id", r"/data/(\d)/", 1).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


def e6_snapshot(spark, d):
    live = iceberg.live_files(spark, iceberg.version(spark, snapshot_table(spark, d)))
    return live.groupBy(F.col("content").cast("long").alias("content"), "sequence").agg(F.count(F.lit(1)).alias("files"))


# ---- a keyed table of records in levels, with manifests and a vector

RECORDS = "SELECT k, s, kind, bucket, level, a, CAST(k % 2 AS INT) AS p FROM {lsm_records} x"
DEAD = "bucket = 0 AND level = 2 AND s % 19 = 0"
_STATS = record("stats", _MIN_VALUES="bytes", _MAX_VALUES="bytes", _NULL_COUNTS=optional({"type": "array", "items": optional("long")}))
_META = record("file", _FILE_NAME="string", _FILE_SIZE="long", _ROW_COUNT="long", _MIN_KEY="bytes", _MAX_KEY="bytes", _KEY_STATS=_STATS, _VALUE_STATS="stats", _MIN_SEQUENCE_NUMBER="long", _MAX_SEQUENCE_NUMBER="long", _SCHEMA_ID="long", _LEVEL="int", _EXTERNAL_PATH=optional("string"))
_ACT = record("entry", _KIND="int", _PARTITION="bytes", _BUCKET="int", _TOTAL_BUCKETS="int", _FILE=_META)
_MANIFEST = record("manifest", _FILE_NAME="string", _FILE_SIZE="long", _NUM_ADDED_FILES="long", _NUM_DELETED_FILES="long", _SCHEMA_ID="long")
_RANGE = record("range", f0="string", f1="int", f2="int", _CARDINALITY=optional("long"))
_INDEX = record("index", _KIND="int", _PARTITION="bytes", _BUCKET="int", _INDEX_TYPE="string", _FILE_NAME="string", _FILE_SIZE="long", _ROW_COUNT="long", _DELETIONS_VECTORS_RANGES=optional({"type": "array", "items": optional(_RANGE)}))


@once
def keyed_table(spark, d) -> str:
    """A file for each bucket and level, those of bucket 3 at an external path; an added and removed file more; a 32-bit
    vector over bucket 0's level 2, a 64-bit one over a file that is gone, and a hash index."""
    root = scratch(spark)
    own = sql(spark, d, RECORDS).withColumnsRenamed({"s": "v"}).select(F.col("v").alias("_SEQUENCE_NUMBER"), F.col("kind").cast("byte").alias("_VALUE_KIND"), "k", F.col("v"), "a", "p", "bucket", "level")
    own.repartition("bucket", "level").sortWithinPartitions("k", "v").write.partitionBy("bucket", "level").parquet(f"{root}/written")
    counts = {(r.bucket, r.level): r for r in own.groupBy("bucket", "level").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("a"), F.max("k").alias("b"), F.min("v").alias("s"), F.max("v").alias("t")).collect()}
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    row = lambda *v: binary_row.encode(list(v), ["BIGINT"] * len(v))
    entries, none = [], {"_MIN_VALUES": row(), "_MAX_VALUES": row(), "_NULL_COUNTS": []}
    for (bucket, level), r in sorted(counts.items()):
        folder = f"{root}/written/bucket={bucket}/level={level}"
        for n, name in enumerate(x for x in files.names(spark, folder) if x.endswith(".parquet")):
            outside, to = bucket == 3, f"{root}/p={bucket % 2}/bucket-{bucket}"
            if not outside:
                fs.mkdirs(path(to))
                fs.rename(path(f"{folder}/{name}"), path(f"{to}/data-{level}-{n}.parquet"))
            file = {"_FILE_NAME": name if outside else f"data-{level}-{n}.parquet", "_FILE_SIZE": 1000 + bucket, "_ROW_COUNT": r.n, "_MIN_KEY": row(r.a), "_MAX_KEY": row(r.b), "_KEY_STATS": {"_MIN_VALUES": row(r.a), "_MAX_VALUES": row(r.b), "_NULL_COUNTS": [0]}, "_VALUE_STATS": none}
            file |= {"_MIN_SEQUENCE_NUMBER": r.s, "_MAX_SEQUENCE_NUMBER": r.t, "_SCHEMA_ID": 0, "_LEVEL": level, "_EXTERNAL_PATH": f"{folder}/{name}" if outside else None}
            entries.append({"_KIND": 0, "_PARTITION": binary_row.encode([bucket % 2], ["INT"]), "_BUCKET": bucket, "_TOTAL_BUCKETS": 4, "_FILE": file})
    stale = {**entries[0], "_FILE": {**entries[0]["_FILE"], "_FILE_NAME": "gone.parquet"}}
    put = lambda name, schema, rows: files.put(spark, f"{root}/manifest/{name}", avro.write_records(schema, rows, "deflate"))
    listed = lambda *names: [{"_FILE_NAME": n, "_FILE_SIZE": 1, "_NUM_ADDED_FILES": 1, "_NUM_DELETED_FILES": 0, "_SCHEMA_ID": 0} for n in names]
    put("manifest-a", _ACT, [stale, *entries[:6]])
    put("manifest-b", _ACT, entries[6:])
    put("manifest-c", _ACT, [{**stale, "_KIND": 1}])
    put("list-base", _MANIFEST, listed("manifest-a", "manifest-b"))
    put("list-delta", _MANIFEST, listed("manifest-c"))
    file = f"{root}/p=0/bucket-0/data-2-0.parquet"
    marked = [r.pos for r in spark.read.parquet(file).select("v", F.col("_metadata.row_index").alias("pos")).filter("v % 19 = 0").orderBy("pos").collect()]
    content, ranges = codecs.bucket_vectors_encode([(marked, False), ([1, 2, 1 << 33], True)])
    files.put(spark, f"{root}/index/index-0", content)
    named = [{"f0": name, "f1": at, "f2": size, "_CARDINALITY": n} for name, (at, size), n in (("data-2-0.parquet", ranges[0], len(marked)), ("gone.parquet", ranges[1], 3))]
    index = {"_KIND": 0, "_PARTITION": binary_row.encode([0], ["INT"]), "_BUCKET": 0, "_FILE_SIZE": len(content), "_ROW_COUNT": 2}
    put("index-manifest", _INDEX, [{**index, "_INDEX_TYPE": "DELETION_VECTORS", "_FILE_NAME": "index-0", "_DELETIONS_VECTORS_RANGES": named}, {**index, "_INDEX_TYPE": "HASH", "_FILE_NAME": "hash-0"}])
    fields = [{"id": k, "name": n, "type": t} for k, (n, t) in enumerate((("k", "BIGINT NOT NULL"), ("v", "BIGINT"), ("a", "BIGINT"), ("p", "INT NOT NULL")))]
    files.put(spark, f"{root}/schema/schema-0", json.dumps({"id": 0, "fields": fields, "highestFieldId": 3, "partitionKeys": ["p"], "primaryKeys": ["k", "p"], "options": {"bucket": "4"}}).encode())
    files.put(spark, f"{root}/snapshot/snapshot-1", json.dumps({"id": 1, "schemaId": 0, "baseManifestList": "list-base", "deltaManifestList": "list-delta", "indexManifest": "index-manifest", "commitKind": "APPEND", "timeMillis": 1}).encode())
    return root


def a20(spark, d):
    rows = paimon.manifests(spark, keyed_table(spark, d), ["manifest-a", "manifest-b", "manifest-c"])
    part = paimon.cells(F.col("_PARTITION"), ["INT"])[0].cast("long")
    return rows.select(F.col("_KIND").cast("long").alias("kind"), part.alias("p"), F.col("_BUCKET").cast("long").alias("bucket"), F.col("_FILE._LEVEL").cast("long").alias("level"), F.col("_FILE._ROW_COUNT").alias("rows"), (F.col("_FILE._FILE_NAME") == "gone.parquet").alias("gone"))


def a21(spark, d):
    rows = paimon.index_manifests(spark, keyed_table(spark, d), ["index-manifest"])
    ranges = F.coalesce("_DELETIONS_VECTORS_RANGES", F.array().cast("array<struct<f0:string,f1:int,f2:int,_CARDINALITY:bigint>>"))
    return rows.select(F.col("_INDEX_TYPE").alias("type"), F.size(ranges).cast("long").alias("files"), F.aggregate(ranges, F.lit(0).cast("bigint"), lambda n, r: n + r["_CARDINALITY"]).alias("positions"))


def a28(spark, d):
    root = keyed_table(spark, d)
    return paimon.vectors(spark, paimon.version(spark, root)).groupBy((F.col("file") == "gone.parquet").alias("gone")).agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"))


def a28_out(spark, d):
    return a28(spark, d).select("gone", "n")


def e30_keyed(spark, d):
    own = paimon.live_files(spark, paimon.version(spark, keyed_table(spark, d)))
    return own.select(F.col("bucket").cast("long").alias("bucket"), F.col("level").cast("long").alias("level"), "rows")


def i9_folders(spark, d):
    """The folders that the partitions' binary rows and the buckets name; external files have their own."""
    own = paimon.live_files(spark, paimon.version(spark, keyed_table(spark, d))).filter("bucket < 3")
    return own.groupBy(F.regexp_extract("path", r"/(p=\d+/bucket-\d+)/", 1).alias("folder")).agg(F.count(F.lit(1)).alias("files"))


def i10_keys(spark, d):
    own = paimon.live_files(spark, paimon.version(spark, keyed_table(spark, d)))
    ends = [paimon.cells(F.col(f"meta._KEY_STATS.{c}"), ["BIGINT"])[0].cast("long").alias(n) for c, n in (("_MIN_VALUES", "least"), ("_MAX_VALUES", "greatest"))]
    return own.select(F.col("bucket").cast("long").alias("bucket"), F.col("level").cast("long").alias("level"), *ends)


def k4_keyed(spark, d):
    return open_table(spark, keyed_table(spark, d)).fates("a IS NULL OR a > 0").select("k", F.col("v").alias("s"), F.col("_fate").alias("fate"))


def k9_keyed(spark, d):
    return open_table(spark, keyed_table(spark, d)).lookup("p = 1 AND k < 500").select("k", F.col("v").alias("s"), "a")


def c25_keyed(spark, d):
    own = open_table(spark, keyed_table(spark, d)).scan_plan("p = 1 AND a > 5")
    return own.groupBy("skipped").agg(F.sum("rows").alias("rows"))


KEYED_FATES = f"""SELECT k, s, a, p, CASE WHEN dead THEN 'VECTOR_DELETED' WHEN kind IN (1, 3) THEN 'RETRACTION' WHEN s = last THEN 'LIVE' ELSE 'SUPERSEDED' END AS fate
    FROM (SELECT y.*, max(CASE WHEN NOT dead THEN s END) OVER (PARTITION BY k) AS last FROM (SELECT z.*, {DEAD} AS dead FROM ({RECORDS}) z) y) w"""


# ---- file indexes, codecs, file systems


def a31(spark, d):
    """A container a file: a filter over its keys, an index left empty, and one of another type; read back and probed."""
    import pandas as pd

    def run(group: pd.DataFrame) -> pd.DataFrame:
        hashes = codecs.wang_longs(group.p_partkey.astype("int64").to_numpy())
        bloom = codecs.Bloom.of(hashes, max(64, len(hashes) * 16), 4)
        data = codecs.file_index_encode({"p_partkey": [("bloom-filter", codecs.bloom_bytes(bloom)), ("bitmap", None)], "p_size": [("bsi", b"xyz")]})
        out = []
        for column, own in codecs.file_index(data).items():
            for kind, body in own:
                found = int(codecs.bloom_of(body).might_contain_each(hashes).sum()) if kind == "bloom-filter" else len(body or b"")
                out.append((int(group.file.iloc[0]), column, kind, body is None, found))
        return pd.DataFrame(out, columns=["file", "name", "type", "empty", "found"])

    own = sql(spark, d, "SELECT p_partkey % 16 AS file, p_partkey FROM {part} x")
    return own.groupBy("file").applyInPandas(run, "file long, name string, type string, empty boolean, found long")


CODECS = ["null", "deflate", "bzip2", "xz", "zstandard"]


def a10(spark, d):
    """Manifests under every codec, packed again as deflate, and read."""
    root, to = tables.metadata_table(spark, d), scratch(spark)
    for codec in CODECS:
        for k in range(5):
            packed = avro.transcode(files.content(spark, f"{root}/metadata/m{k}.avro"), codec)
            files.put(spark, f"{to}/{codec}/m{k}.avro", avro.transcode(packed))
    rows = avro.read_avro(spark, [f"{to}/{c}" for c in CODECS]).filter("error IS NULL")
    return rows.groupBy(F.regexp_extract("path", r"/([a-z0-9]+)/m\d\.avro$", 1).alias("codec")).agg(F.count(F.lit(1)).alias("records"))


def a33(spark, d):
    found = files.glob(spark, f"{tables.log_table(spark, d)}/_delta_log/*.json")
    return spark.createDataFrame([(p.rsplit("/", 1)[1], n > 0) for p, n in found], "name string, has_bytes boolean")


def a35(spark, d):
    """What a table's file system is asked to do, and whether it does."""
    root, fs, out = tables.document_table(spark, d), files.ReadOnly(spark), []
    for verb, *args in (("names", f"{root}/schema"), ("content", f"{root}/schema/schema-0"), ("glob", f"{root}/schema/*"), ("create", f"{root}/x"), ("delete", root), ("rename", root, "/x"), ("mkdirs", f"{root}/y"), ("append", f"{root}/schema/schema-0")):
        try:
            out.append((verb, bool(getattr(fs, verb)(*args))))
        except PermissionError:
            out.append((verb, False))
    return spark.createDataFrame(out, "verb string, done boolean")


def a36(spark, d):
    own = files.Credential("s3a", "b", "id", "hidden", "http://localhost:9")
    own.apply(spark)
    conf = spark._jsc.hadoopConfiguration()
    return spark.createDataFrame([("shown", str("hidden" in repr(own)).lower()), ("key", conf.get("fs.s3a.bucket.b.access.key")), ("endpoint", conf.get("fs.s3a.bucket.b.endpoint"))], "what string, value string")


# ---- lines of history, and drawing

FORKED = "SELECT snapshot_id, parent_id, snapshot_id AS at_ms, snapshot_id AS sequence FROM {snapshots} x UNION ALL SELECT 1000 + snapshot_id, snapshot_id, 5000 + snapshot_id, 5000 + snapshot_id FROM {snapshots} x WHERE snapshot_id % 10 = 0"


def w13(spark, d):
    """A month's snapshots in a row, and a branch of one commit at every tenth."""
    own = sql(spark, d, FORKED)
    tips = own.filter("snapshot_id < 1000").agg(F.lit("main").alias("branch"), F.max("snapshot_id").alias("snapshot_id")).unionAll(own.filter("snapshot_id >= 1000").select(F.concat(F.lit("b"), F.col("snapshot_id")), "snapshot_id"))
    return history.tracks(own, tips.withColumn("made", F.lit(None).cast("long")))


def _pad(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.lpad(F.col(column).cast("string"), 2, "0"))


def _graph(spark, d):
    own = frame(spark, d, "nation")
    regions = own.select(_pad("r", "n_regionkey").alias("id")).distinct()
    nodes = spark.createDataFrame([("t",)], "id string").unionAll(regions).unionAll(own.select(_pad("n", "n_nationkey")))
    edges = regions.select(F.lit("t").alias("parent"), F.col("id").alias("child")).unionAll(own.select(_pad("r", "n_regionkey"), _pad("n", "n_nationkey")))
    return nodes, edges


def _placed(spark, d, kind="TREE"):
    nodes, edges = _graph(spark, d)
    return graph.layout(nodes, edges, "t", kind).select("*", F.lit(100).alias("width"), F.lit(30).alias("height")), edges


def n7(spark, d):
    parts = [_placed(spark, d, k)[0].select(F.lit(k).alias("kind"), "id", "x", "y") for k in ("TREE", "LAYERED")]
    return parts[0].unionAll(parts[1])


def n6(spark, d):
    placed, edges = _placed(spark, d)
    out = None
    for way in ("LEFT", "RIGHT", "UP", "DOWN"):
        own = graph.step(placed, edges, "r02", way).select(F.lit(way).alias("way"), F.col("id").alias("to"))
        out = own if out is None else out.unionAll(own)
    return out


def o3(spark, d):
    placed, edges = _placed(spark, d)
    return graph.to_svg(placed, edges).select(F.col("part").cast("long").alias("part"), "line")


_LEAF = "SELECT 'n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS id, 'r' || lpad(CAST(n_regionkey AS VARCHAR), 2, '0') AS r, (row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1) AS n FROM nation"
_TREE = f"SELECT id, CAST(400 AS BIGINT) AS x, CAST(n * 40 AS BIGINT) AS y, r AS parent FROM ({_LEAF}) l UNION ALL SELECT r, 200, CAST(floor((min(n) + max(n)) * 20) AS BIGINT), 't' FROM ({_LEAF}) l GROUP BY r UNION ALL SELECT 't', 0, CAST(floor(max(n) * 20) AS BIGINT), NULL FROM ({_LEAF}) l"
_LAYERED = f"SELECT id, CAST(400 AS BIGINT) AS x, CAST(n * 40 AS BIGINT) AS y FROM ({_LEAF}) l UNION ALL SELECT r, 200, (row_number() OVER (ORDER BY r) - 1) * 40 FROM (SELECT DISTINCT r FROM ({_LEAF}) l) m UNION ALL SELECT 't', 0, 0"
_NEAR = f"""WITH p AS ({_TREE}), h AS (SELECT * FROM p WHERE id = 'r02')
    SELECT 'LEFT' AS way, 't' AS "to" UNION ALL SELECT 'RIGHT', (SELECT p.id FROM p, h WHERE p.parent = 'r02' ORDER BY abs(p.y - h.y), p.id LIMIT 1)
    UNION ALL SELECT 'UP', (SELECT p.id FROM p, h WHERE p.x = 200 AND p.y < h.y ORDER BY h.y - p.y, p.id LIMIT 1) UNION ALL SELECT 'DOWN', (SELECT p.id FROM p, h WHERE p.x = 200 AND p.y > h.y ORDER BY p.y - h.y, p.id LIMIT 1)"""
_SVG = f"""WITH p AS ({_TREE}) SELECT CAST(0 AS BIGINT) AS part, printf('<svg xmlns="http://www.w3.org/2000/svg" width="%d" height="%d">', max(x) + 100, max(y) + 30) AS line FROM p
    UNION ALL SELECT 1, printf('<line x1="%d" y1="%d" x2="%d" y2="%d"/>', a.x + 100, a.y + 15, b.x, b.y + 15) FROM p b JOIN p a ON b.parent = a.id
    UNION ALL SELECT 2, printf('<g><rect x="%d" y="%d" width="100" height="30"/><text x="%d" y="%d">%s</text></g>', x, y, x + 4, y + 15, id) FROM p UNION ALL SELECT 3, '</svg>'"""
_FILES = "(SELECT bucket % 2 AS p, bucket, CAST(level AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS rows FROM {lsm_records} x GROUP BY bucket, level)"

QUERIES = {
    "k2_fates_of_a_snapshot": (k2_snapshot, f"SELECT * FROM ({FATES}) f WHERE p_size < 30"),
    "k1_lookup_in_a_snapshot": (k1_snapshot, f"SELECT p_partkey, p_size FROM ({FATES}) f WHERE p_partkey % 4 >= 1 AND p_partkey > 100 AND fate = 'LIVE'"),
    "c21_plan_of_a_snapshot": (c21_snapshot, f"SELECT CAST(k AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS rows, k <> 2 AS skipped FROM ({PARTS}) y GROUP BY k"),
    "i6_bounds_of_files": (i6_bounds, f"SELECT CAST(k AS BIGINT) AS k, min(p_partkey) AS least, max(p_partkey) AS greatest FROM ({PARTS}) y GROUP BY k"),
    "a26_vectors_of_a_snapshot": (a26_snapshot, f"SELECT CAST(3 AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n FROM ({PARTS}) y WHERE k = 3 AND p_partkey % 29 < 3"),
    "e6_live_files_of_a_snapshot": (e6_snapshot, "SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST(2 AS BIGINT)), (0, 3, 2), (2, 2, 1), (2, 4, 1), (1, 4, 2)) t(content, sequence, files)"),
    "i9_partition_folders": (i9_folders, f"SELECT 'p=' || p || '/bucket-' || bucket AS folder, CAST(count(*) AS BIGINT) AS files FROM {_FILES} f WHERE bucket < 3 GROUP BY 1"),
    "i10_key_bounds_of_files": (i10_keys, "SELECT bucket, CAST(level AS BIGINT) AS level, min(k) AS least, max(k) AS greatest FROM {lsm_records} x GROUP BY bucket, level"),
    "a32_partition_statistics_rows": (a32, "SELECT CAST(4 AS BIGINT) AS snapshot_id, 'RECORDED' AS resolution, 'region=' || n_regionkey AS part, CAST(count(*) AS BIGINT) AS rows FROM nation GROUP BY n_regionkey UNION ALL SELECT 3, 'MISSING', 'none', NULL"),
    "a20_keyed_manifests": (a20, f"SELECT CAST(0 AS BIGINT) AS kind, p, bucket, level, rows, FALSE AS gone FROM {_FILES} f UNION ALL SELECT k, p, bucket, level, rows, TRUE FROM {_FILES} f CROSS JOIN (VALUES (0), (1)) t(k) WHERE bucket = 0 AND level = 0"),
    "a21_index_manifest": (a21, f"SELECT 'DELETION_VECTORS' AS type, CAST(2 AS BIGINT) AS files, CAST(count(*) + 3 AS BIGINT) AS positions FROM ({RECORDS}) x WHERE {DEAD} UNION ALL SELECT 'HASH', 0, 0"),
    "a28_bucket_vectors": (a28_out, f"SELECT FALSE AS gone, CAST(count(*) AS BIGINT) AS n FROM ({RECORDS}) x WHERE {DEAD} UNION ALL SELECT TRUE, 3"),
    "e30_live_files_of_manifests": (e30_keyed, f"SELECT bucket, level, rows FROM {_FILES} f"),
    "k4_fates_of_a_keyed_table": (k4_keyed, f"SELECT k, s, fate FROM ({KEYED_FATES}) f WHERE a IS NULL OR a > 0"),
    "k9_lookup_in_a_keyed_table": (k9_keyed, f"SELECT k, s, a FROM ({KEYED_FATES}) f WHERE fate = 'LIVE' AND p = 1 AND k < 500"),
    "c25_plan_of_a_keyed_table": (c25_keyed, f"SELECT p = 0 AS skipped, CAST(sum(rows) AS BIGINT) AS rows FROM {_FILES} f GROUP BY p"),
    "a31_file_index_containers": (a31, "SELECT p_partkey % 16 AS file, 'p_partkey' AS name, 'bloom-filter' AS type, FALSE AS empty, CAST(count(*) AS BIGINT) AS found FROM part GROUP BY 1 UNION ALL SELECT DISTINCT p_partkey % 16, 'p_partkey', 'bitmap', TRUE, 0 FROM part UNION ALL SELECT DISTINCT p_partkey % 16, 'p_size', 'bsi', FALSE, 3 FROM part"),
    "a10_transcoded_containers": (a10, "SELECT codec, CAST(count(*) AS BIGINT) AS records FROM nation CROSS JOIN (VALUES ('null'), ('deflate'), ('bzip2'), ('xz'), ('zstandard')) t(codec) GROUP BY codec"),
    "a33_glob": (a33, "SELECT lpad(CAST(k AS VARCHAR), 20, '0') || '.json' AS name, TRUE AS has_bytes FROM range(7) t(k)"),
    "a35_read_only": (a35, "SELECT * FROM (VALUES ('names', TRUE), ('content', TRUE), ('glob', TRUE), ('create', FALSE), ('delete', FALSE), ('rename', FALSE), ('mkdirs', FALSE), ('append', FALSE)) t(verb, done)"),
    "a36_credential": (a36, "SELECT * FROM (VALUES ('shown', 'false'), ('key', 'id'), ('endpoint', 'http://localhost:9')) t(what, value)"),
    "w13_history_tracks": (w13, "WITH m AS (SELECT snapshot_id FROM {snapshots} x) SELECT snapshot_id, snapshot_id AS line, CAST(0 AS BIGINT) AS track FROM m UNION ALL SELECT 1000 + snapshot_id, (SELECT count(*) FROM m) + row_number() OVER (ORDER BY snapshot_id DESC) - 1, CAST(snapshot_id // 10 + 1 AS BIGINT) FROM m WHERE snapshot_id % 10 = 0"),
    "n6_nearest_steps": (n6, _NEAR),
    "n7_layouts": (n7, f"SELECT 'TREE' AS kind, id, x, y FROM ({_TREE}) t UNION ALL SELECT 'LAYERED', id, x, y FROM ({_LAYERED}) l"),
    "o3_drawing": (o3, _SVG),
}
