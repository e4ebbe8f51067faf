"""Queries of sources: small tables of each layout are written to a scratch folder and read back through the sources."""

from __future__ import annotations

import json
import struct

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siltstone.functions import codecs
from siltstone.plans.facade import open_table
from siltstone.plans.fixtures import frame, scratch, sql
from siltstone.sources import avro, delta, files, iceberg, paimon


def nations(spark, d) -> list:
    """25 rows: enough for a table's metadata."""
    return frame(spark, d, "nation").orderBy("n_nationkey").collect()


def log_table(spark, d) -> str:
    """A log: version k adds the nations of region k, version 5 removes every third, version 6 gives one file a vector."""
    root = scratch(spark)
    schema = json.dumps({"type": "struct", "fields": [{"name": "n_nationkey", "type": "integer", "nullable": True, "metadata": {}}]})
    add = lambda r, **more: {"add": {"path": f"f%20{r.n_nationkey}.parquet", "partitionValues": {}, "size": 10 + r.n_nationkey, "dataChange": True, "stats": json.dumps({"numRecords": r.n_nationkey + 1}), **more}}
    remove = lambda r: {"remove": {"path": f"f%20{r.n_nationkey}.parquet", "dataChange": True}}
    rows = nations(spark, d)
    commits = [[add(r) for r in rows if r.n_regionkey == k] for k in range(5)]
    commits[0] = [{"protocol": {"minReaderVersion": 3, "minWriterVersion": 7, "readerFeatures": ["deletionVectors"]}}, {"metaData": {"id": "m", "schemaString": schema, "partitionColumns": [], "configuration": {"delta.checkpointInterval": "3"}}}, *commits[0]]
    commits.append([remove(r) for r in rows if r.n_nationkey % 3 == 0])
    vector = codecs.z85_encode((struct.pack("<I", 1681511377) + codecs.roaring64_encode([0])).ljust(40, b"\0"))
    commits.append([remove(rows[4]), add(rows[4], deletionVector={"storageType": "i", "pathOrInlineDv": vector, "sizeInBytes": 40, "cardinality": 1}), {"txn": {"appId": "a", "version": 3}}, {"domainMetadata": {"domain": "x", "configuration": "{}", "removed": False}}])
    for k, actions in enumerate(commits):
        files.put(spark, f"{root}/_delta_log/{k:020}.json", "\n".join(json.dumps(a) for a in [*actions, {"commitInfo": {"timestamp": 1000 * k, "operation": "WRITE"}}]).encode())
    files.put(spark, f"{root}/_delta_log/{4:020}.checkpoint.{1:010}.{2:010}.parquet", b"")
    files.put(spark, f"{root}/_delta_log/_last_checkpoint", b'{"version": 4}')
    return root


ENTRY = {"type": "record", "name": "manifest_entry", "fields": [{"name": "status", "type": "int", "field-id": 0}, {"name": "snapshot_id", "type": ["null", "long"], "field-id": 1}, {"name": "sequence_number", "type": ["null", "long"], "field-id": 3}, {"name": "data_file", "field-id": 2, "type": {"type": "record", "name": "f", "fields": [{"name": "content", "type": "int", "field-id": 134}, {"name": "file_path", "type": "string", "field-id": 100}, {"name": "file_format", "type": "string", "field-id": 101}, {"name": "partition", "field-id": 102, "type": {"type": "record", "name": "p", "fields": [{"name": "region", "type": ["null", "int"], "field-id": 1000}]}}, {"name": "record_count", "type": "long", "field-id": 103}, {"name": "file_size_in_bytes", "type": "long", "field-id": 104}]}}]}
LIST = {"type": "record", "name": "manifest_file", "fields": [{"name": "manifest_path", "type": "string"}, {"name": "manifest_length", "type": "long"}, {"name": "partition_spec_id", "type": "int"}, {"name": "content", "type": "int"}, {"name": "added_files_count", "type": "int"}, {"name": "added_rows_count", "type": "long"}]}


def metadata_table(spark, d) -> str:
    """Five manifests, one a region, under one snapshot with a parent."""
    root, rows, listed = scratch(spark), nations(spark, d), []
    for k in range(5):
        own = [{"status": 2 if r.n_nationkey % 5 == 4 else 1, "snapshot_id": 2, "sequence_number": None, "data_file": {"content": 0, "file_path": f"data/{r.n_nationkey}.parquet", "file_format": "PARQUET", "partition": {"region": k}, "record_count": r.n_nationkey + 1, "file_size_in_bytes": 100 + r.n_nationkey}} for r in rows if r.n_regionkey == k]
        files.put(spark, f"{root}/metadata/m{k}.avro", avro.write_records(ENTRY, own, "deflate"))
        listed.append({"manifest_path": f"{root}/metadata/m{k}.avro", "manifest_length": 100 + k, "partition_spec_id": 0, "content": 0, "added_files_count": sum(e["status"] == 1 for e in own), "added_rows_count": sum(e["data_file"]["record_count"] for e in own if e["status"] == 1)})
    files.put(spark, f"{root}/metadata/snap-2.avro", avro.write_records(LIST, listed))
    files.put(spark, f"{root}/metadata/bad.avro", b"Obj\x01broken")
    meta = {"format-version": 2, "last-column-id": 2, "last-sequence-number": 2, "current-snapshot-id": 2, "last-updated-ms": 20, "properties": {"a": "b"}, "snapshots": [{"snapshot-id": 1, "sequence-number": 1, "timestamp-ms": 10, "manifest-list": f"{root}/metadata/snap-1.avro"}, {"snapshot-id": 2, "parent-snapshot-id": 1, "sequence-number": 2, "timestamp-ms": 20, "manifest-list": f"{root}/metadata/snap-2.avro", "summary": {"operation": "append"}}], "snapshot-log": [{"timestamp-ms": 10, "snapshot-id": 1}, {"timestamp-ms": 20, "snapshot-id": 2}], "refs": {"main": {"snapshot-id": 2, "type": "branch"}, "old": {"snapshot-id": 1, "type": "tag"}}, "schemas": [{"schema-id": 0, "fields": [{"id": 1, "name": "a", "required": True, "type": "int"}, {"id": 2, "name": "b", "required": False, "type": "string"}]}]}
    files.put(spark, f"{root}/metadata/v2.metadata.json", json.dumps(meta).encode())
    files.put(spark, f"{root}/metadata/v1.metadata.json", json.dumps({**meta, "last-updated-ms": 10, "snapshots": meta["snapshots"][:1], "current-snapshot-id": 1}).encode())
    return root


def document_table(spark, d) -> str:
    root = scratch(spark)
    for r in nations(spark, d)[:10]:
        k = r.n_nationkey + 1
        files.put(spark, f"{root}/snapshot/snapshot-{k}", json.dumps({"id": k, "schemaId": 0, "timeMillis": 100 * k, "commitKind": "APPEND", "totalRecordCount": k * k, "deltaRecordCount": 2 * k - 1}).encode())
    files.put(spark, f"{root}/schema/schema-0", json.dumps({"id": 0, "fields": [{"id": 0, "name": "k", "type": "INT NOT NULL"}, {"id": 1, "name": "v", "type": "STRING"}], "highestFieldId": 1, "primaryKeys": ["k"], "options": {"merge-engine": "partial-update"}}).encode())
    files.put(spark, f"{root}/consumer/consumer-c1", b'{"nextSnapshot": 4}')
    files.put(spark, f"{root}/tag/tag-t1", json.dumps({"id": 3, "timeMillis": 300}).encode())
    return root


def a1(spark, d):
    out = [(k, files.detect(spark, f(spark, d))) for k, f in (("log", log_table), ("metadata", metadata_table), ("documents", document_table))]
    return spark.createDataFrame([*out, ("none", files.detect(spark, "/nonexistent"))], "layout string, format string")


def a2(spark, d):
    out = [(f, open_table(spark, t(spark, d)).snapshots().count()) for f, t in (("DELTA", log_table), ("ICEBERG", metadata_table), ("PAIMON", document_table))]
    return spark.createDataFrame(out, "format string, snapshots long")


def a3(spark, d):
    return iceberg.versions(spark, metadata_table(spark, d)).select("version", F.size("snapshots").alias("snapshots"), F.col("`current-snapshot-id`").alias("current"), F.col("properties")["a"].alias("a"))


def _lists(spark, root):
    return [r.manifest_list for r in iceberg.snapshots(iceberg.newest(spark, root)).filter("snapshot_id = 2").collect()]


def a4(spark, d):
    return iceberg.manifests(spark, _lists(spark, metadata_table(spark, d))).select(F.regexp_extract("manifest_path", r"m(\d)\.avro$", 1).cast("long").alias("region"), F.col("added_files_count").cast("long").alias("files"), F.col("added_rows_count").alias("rows"))


def _entries(spark, d):
    return iceberg.entries(spark, [f"{metadata_table(spark, d)}/metadata/m*.avro"])


def a5(spark, d):
    return _entries(spark, d).select("file_path", F.col("status").cast("long").alias("status"), F.col("record_count").alias("rows"))


def a6(spark, d):
    rows = avro.read_avro(spark, [f"{metadata_table(spark, d)}/metadata/*.avro"])
    return rows.agg(F.count_if(F.col("error").isNull()).alias("read"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def a7(spark, d):
    return _entries(spark, d).select("file_path", F.get_json_object("partition", "$.region").cast("long").alias("region"))


def a8(spark, d):
    tree = avro.column_tree(ENTRY)
    return spark.createDataFrame([(c["name"], c["id"], c["kind"]) for c in tree["children"]], "name string, id long, kind string")


def a9(spark, d):
    rows = avro.read_avro(spark, [f"{metadata_table(spark, d)}/metadata/m0.avro"])
    return rows.orderBy("row_index").limit(3).select("row_index", F.get_json_object("record", "$.data_file.file_path").alias("path"))


def a13(spark, d):
    return spark.createDataFrame([(n, k) for n, _, k in files.parquet_columns(spark, f"{d}/nation.parquet")], "name string, kind string")


def a15(spark, d):
    def ok(p):
        try:
            return files.readable(p)
        except ValueError:
            return None

    return spark.createDataFrame([(p, ok(p)) for p in ("a.parquet", "b.AVRO", "c.csv")], "path string, kind string")


def a18(spark, d):
    return paimon.snapshots(spark, document_table(spark, d)).select("id", F.col("totalRecordCount").alias("total"), F.col("deltaRecordCount").alias("delta"))


def a19(spark, d):
    return paimon.schemas(spark, document_table(spark, d)).select(F.explode("fields").alias("c")).select(F.col("c.id").cast("long").alias("id"), "c.name", "c.type")


def a22(spark, d):
    return delta.log(spark, log_table(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def a23(spark, d):
    own = delta.file_actions(delta.commits(spark, log_table(spark, d)))
    return own.groupBy("version").agg(F.count_if(F.col("action") == "add").alias("adds"), F.count_if(F.col("action") == "remove").alias("removes"))


def a24(spark, d):
    root = scratch(spark)
    rows = spark.createDataFrame([(json.dumps({"add": {"path": f"p{k}", "size": k}}),) for k in range(6)], "j string")
    rows.select(F.from_json("j", delta.ACTIONS).alias("a")).select("a.*").coalesce(1).write.parquet(f"{root}/cp")
    name = next(n for n in files.names(spark, f"{root}/cp") if n.startswith("part"))
    content = spark.read.format("binaryFile").load(f"{root}/cp/{name}").first().content
    files.put(spark, f"{root}/_delta_log/{2:020}.checkpoint.parquet", bytes(content))
    return delta.checkpoint(spark, root, 2).select("add.path", F.col("add.size").alias("size"))


def _puffin(spark) -> str:
    path = f"{scratch(spark)}/s.puffin"
    files.put(spark, path, codecs.puffin_encode([({"type": "deletion-vector-v1", "fields": [], "properties": {"referenced-data-file": "x", "cardinality": "4"}}, codecs.vector_blob_encode([1, 5, 70_000, 1 << 33]))]))
    return path


def _content(spark, path) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).first().content)


def a25(spark, d):
    footer = codecs.puffin_footer(_content(spark, _puffin(spark)))
    return spark.createDataFrame([(b["type"], b["properties"]["cardinality"]) for b in footer["blobs"]], "type string, cardinality string")


def a26(spark, d):
    data = _content(spark, _puffin(spark))
    blob = codecs.puffin_footer(data)["blobs"][0]
    return spark.createDataFrame([(int(p),) for p in codecs.vector_blob(data[blob["offset"] : blob["offset"] + blob["length"]])], "pos long")


def a29(spark, d):
    rows = delta.state(spark, log_table(spark, d)).filter("vector IS NOT NULL").collect()
    return spark.createDataFrame([(r.path, int(p)) for r in rows for p in codecs.inline_vector(r.vector.pathOrInlineDv, r.vector.sizeInBytes)], "path string, pos long")


def a37(spark, d):
    root = scratch(spark)
    for k in range(3):
        files.put(spark, f"{root}/db/t{k}/_delta_log/{0:020}.json", b"{}")
    return spark.createDataFrame([(p.rsplit("/", 1)[1], k) for p, k in files.tables(spark, root).items()], "name string, format string")


def a38(spark, d):
    metadata = iceberg.versions(spark, metadata_table(spark, d))
    return iceberg.snapshots(metadata).select("snapshot_id", "parent_id", "at_ms")


def a39(spark, d):
    table = document_table(spark, d)
    return paimon.snapshots(spark, table).select("id", F.lit("snapshot").alias("kind")).unionAll(paimon.tags(spark, table).select("id", F.lit("tag")))


def a40(spark, d):
    cells = [("/w/t/data/a.parquet", True), ("/gone/t/data/b.parquet", False), ("/x/y.parquet", False)]
    return spark.createDataFrame([(p, *iceberg.resolve(p, "/here/t", lambda _, e=e: e)) for p, e in cells], "recorded string, path string, how string")


def a43(spark, d):
    return paimon.consumers(spark, document_table(spark, d)).select(F.col("nextSnapshot").alias("next"))


def a44(spark, d):
    def at(t):
        try:
            return files.location(t)[0]
        except ValueError:
            return "REFUSED"

    return spark.createDataFrame([(t, at(t)) for t in ("/a/b", "file:/a", "s3://b/k", "ftp://x/y")], "location string, scheme string")


def a46(spark, d):
    size, footer = codecs.puffin_sizes(_content(spark, _puffin(spark)))
    return spark.createDataFrame([(size > footer > 16,)], "plausible boolean")


def e29(spark, d):
    own = delta.commits(spark, log_table(spark, d))
    features = delta.latest(own, "protocol").select(F.lit("feature").alias("fact"), F.explode("readerFeatures").alias("value"))
    return features.unionAll(delta.transactions(own).select(F.lit("txn"), F.concat_ws("=", "appId", F.col("version").cast("string")))).unionAll(delta.domains(own).select(F.lit("domain"), "domain"))


def k8(spark, d):
    return delta.state(spark, log_table(spark, d), 5).select("path", F.col("num_records").alias("rows"))


def i24(spark, d):
    rows = delta.commits(spark, log_table(spark, d))
    return rows.agg(*[F.count(k).alias(k) for k in ("add", "remove", "metaData", "protocol", "txn", "commitInfo")])


def i25(spark, d):
    kinds = delta.schema(delta.commits(spark, log_table(spark, d)))
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in kinds], "name string, type string")


def m5(spark, d):
    return paimon.highest_field_checks(spark, document_table(spark, d)).select("id", F.col("recorded").cast("long").alias("recorded"), F.col("counted").cast("long").alias("counted"), "agrees")


def m4(spark, d):
    return open_table(spark, metadata_table(spark, d)).check().select("figure", "recorded", "counted", "verdict")


def d22(spark, d):
    own = paimon.snapshots(spark, document_table(spark, d))
    return paimon.as_of(own, 450)


def n2(spark, d):
    return open_table(spark, log_table(spark, d)).inventory().select("path", "size", "format")


def b15(spark, d):
    own = sql(spark, d, "SELECT n_nationkey AS snapshot, n_nationkey * 100 AS first_row_id, n_nationkey % 4 AS added FROM {nation} x")
    text = F.when(F.col("added") > 0, F.concat_ws("-", F.col("first_row_id").cast("string"), (F.col("first_row_id") + F.col("added") - 1).cast("string"))).otherwise("none")
    return own.select("snapshot", text.alias("row_ids"))


_N = "CAST(n_nationkey AS BIGINT)"
QUERIES = {
    "a1_format_detection": (a1, "SELECT * FROM (VALUES ('log', 'DELTA'), ('metadata', 'ICEBERG'), ('documents', 'PAIMON'), ('none', 'UNKNOWN')) t(layout, format)"),
    "a2_open_table": (a2, "SELECT * FROM (VALUES ('DELTA', CAST(7 AS BIGINT)), ('ICEBERG', 2), ('PAIMON', 10)) t(format, snapshots)"),
    "a3_metadata_scan": (a3, "SELECT * FROM (VALUES (CAST(1 AS INTEGER), CAST(1 AS INTEGER), CAST(1 AS BIGINT), 'b'), (2, 2, 2, 'b')) t(version, snapshots, current, a)"),
    "a4_manifest_list_scan": (a4, f"SELECT CAST(n_regionkey AS BIGINT) AS region, CAST(count(*) FILTER (WHERE n_nationkey % 5 <> 4) AS BIGINT) AS files, CAST(coalesce(sum(n_nationkey + 1) FILTER (WHERE n_nationkey % 5 <> 4), 0) AS BIGINT) AS rows FROM nation GROUP BY 1"),
    "a5_manifest_scan": (a5, f"SELECT 'data/' || n_nationkey || '.parquet' AS file_path, CAST(CASE WHEN n_nationkey % 5 = 4 THEN 2 ELSE 1 END AS BIGINT) AS status, {_N} + 1 AS rows FROM nation"),
    "a6_records_with_errors": (a6, "SELECT CAST(count(*) + 5 AS BIGINT) AS read, CAST(1 AS BIGINT) AS errors FROM nation"),
    "a7_raw_partition": (a7, "SELECT 'data/' || n_nationkey || '.parquet' AS file_path, CAST(n_regionkey AS BIGINT) AS region FROM nation"),
    "a8_avro_column_tree": (a8, "SELECT * FROM (VALUES ('status', CAST(0 AS BIGINT), 'primitive'), ('snapshot_id', 1, 'primitive'), ('sequence_number', 3, 'primitive'), ('data_file', 2, 'struct')) t(name, id, kind)"),
    "a9_avro_sample_rows": (a9, "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS row_index, 'data/' || n_nationkey || '.parquet' AS path FROM nation WHERE n_regionkey = 0 ORDER BY n_nationkey LIMIT 3"),
    "a13_parquet_column_tree": (a13, "SELECT * FROM (VALUES ('n_nationkey', 'primitive'), ('n_name', 'primitive'), ('n_regionkey', 'primitive')) t(name, kind)"),
    "a15_readable_files": (a15, "SELECT * FROM (VALUES ('a.parquet', 'parquet'), ('b.AVRO', 'avro'), ('c.csv', NULL)) t(path, kind)"),
    "a18_snapshot_documents": (a18, f"SELECT {_N} + 1 AS id, ({_N} + 1) * ({_N} + 1) AS total, 2 * {_N} + 1 AS delta FROM nation WHERE n_nationkey < 10"),
    "a19_schema_documents": (a19, "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'k', 'INT NOT NULL'), (1, 'v', 'STRING')) t(id, name, type)"),
    "a22_log_listing": (a22, "SELECT * FROM (VALUES ('COMMIT', CAST(7 AS BIGINT)), ('INCOMPLETE', 1)) t(kind, n)"),
    "a23_commit_scan": (a23, "SELECT version, CAST(sum(a) AS BIGINT) AS adds, CAST(sum(r) AS BIGINT) AS removes FROM (SELECT CAST(n_regionkey AS BIGINT) AS version, 1 AS a, 0 AS r FROM nation UNION ALL SELECT 5, 0, 1 FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 6, 1, 1) x GROUP BY version"),
    "a24_checkpoint_scan": (a24, "SELECT 'p' || k AS path, CAST(k AS BIGINT) AS size FROM range(6) t(k)"),
    "a25_puffin_footer": (a25, "SELECT 'deletion-vector-v1' AS type, '4' AS cardinality"),
    "a26_puffin_vector": (a26, "SELECT * FROM (VALUES (CAST(1 AS BIGINT)), (5), (70000), (8589934592)) t(pos)"),
    "a29_inline_vector": (a29, "SELECT 'f 4.parquet' AS path, CAST(0 AS BIGINT) AS pos"),
    "a37_table_discovery": (a37, "SELECT * FROM (VALUES ('t0', 'DELTA'), ('t1', 'DELTA'), ('t2', 'DELTA')) t(name, format)"),
    "a38_snapshots_of_all_versions": (a38, "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(NULL AS BIGINT), CAST(10 AS BIGINT)), (2, 1, 20)) t(snapshot_id, parent_id, at_ms)"),
    "a39_documents_of_a_table": (a39, f"SELECT {_N} + 1 AS id, 'snapshot' AS kind FROM nation WHERE n_nationkey < 10 UNION ALL SELECT 3, 'tag'"),
    "a40_recorded_paths": (a40, "SELECT * FROM (VALUES ('/w/t/data/a.parquet', '/w/t/data/a.parquet', 'RECORDED'), ('/gone/t/data/b.parquet', '/here/t/data/b.parquet', 'RELATIVE'), ('/x/y.parquet', '/x/y.parquet', 'MISSING')) t(recorded, path, how)"),
    "a43_consumer_documents": (a43, "SELECT CAST(4 AS BIGINT) AS next"),
    "a44_locations": (a44, "SELECT * FROM (VALUES ('/a/b', 'file'), ('file:/a', 'file'), ('s3://b/k', 's3'), ('ftp://x/y', 'REFUSED')) t(location, scheme)"),
    "a46_puffin_sizes": (a46, "SELECT TRUE AS plausible"),
    "b15_snapshot_row_ids": (b15, "SELECT n_nationkey AS snapshot, CASE WHEN n_nationkey % 4 > 0 THEN (n_nationkey * 100) || '-' || (n_nationkey * 100 + n_nationkey % 4 - 1) ELSE 'none' END AS row_ids FROM nation"),
    "d22_as_of_document": (d22, "SELECT CAST(4 AS BIGINT) AS id"),
    "e29_table_facts": (e29, "SELECT * FROM (VALUES ('feature', 'deletionVectors'), ('txn', 'a=3'), ('domain', 'x')) t(fact, value)"),
    "i24_action_json": (i24, "SELECT CAST(26 AS BIGINT) AS \"add\", CAST(10 AS BIGINT) AS remove, CAST(1 AS BIGINT) AS metaData, CAST(1 AS BIGINT) AS protocol, CAST(1 AS BIGINT) AS txn, CAST(7 AS BIGINT) AS commitInfo"),
    "i25_schema_json": (i25, "SELECT 'n_nationkey' AS name, 'int' AS type"),
    "k8_read_input_of_a_version": (k8, f"SELECT 'f ' || n_nationkey || '.parquet' AS path, {_N} + 1 AS rows FROM nation WHERE n_nationkey % 3 <> 0"),
    "m4_metadata_figures": (m4, "SELECT * FROM (VALUES ('last-column-id', '2', '2', 'AGREES'), ('last-sequence-number', '2', '2', 'AGREES')) t(figure, recorded, counted, verdict)"),
    "m5_schema_figures": (m5, "SELECT CAST(0 AS BIGINT) AS id, CAST(1 AS BIGINT) AS recorded, CAST(1 AS BIGINT) AS counted, TRUE AS agrees"),
    "n3_log_inventory": (n2, f"SELECT 'f ' || n_nationkey || '.parquet' AS path, 10 + {_N} AS size, 'parquet' AS format FROM nation WHERE n_nationkey % 3 <> 0"),
}
