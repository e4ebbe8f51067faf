"""Queries of per-format reports, statistics documents, stats modes and row-set algebra."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from siltstone.functions import codecs
from siltstone.operators import checks, graph, history, pruning, replay
from siltstone.operators.predicates import parse
from siltstone.plans import tables
from siltstone.plans.facade import open_table
from siltstone.plans.fixtures import frame, sql
from siltstone.plans.scans import REACH_SQL, d1
from siltstone.sources import files, paimon

get = frame


def a17(spark, d):
    """A partition struct rendered k=v/..., with its counts."""
    own = get(spark, d, "small_files").groupBy(F.struct(F.col("part").alias("p"), (F.col("part") % 3).alias("q")).alias("partition")).agg(F.count(F.lit(1)).alias("files"))
    cells = F.array(*[F.concat_ws("=", F.lit(k), F.col(f"partition.{k}").cast("string")) for k in ("p", "q")])
    return own.select(F.array_join(cells, "/").alias("partition"), "files")


def a42(spark, d):
    root = tables.scratch(spark)
    files.put(spark, f"{root}/statistics/s-1", json.dumps({"snapshotId": 3, "mergedRecordCount": 20, "colStats": {"k": {"distinctCount": 20, "nullCount": 0}, "v": {"distinctCount": 7, "nullCount": 2}}}).encode())
    doc = spark.read.option("multiLine", True).schema("snapshotId long, mergedRecordCount long, colStats map<string,struct<distinctCount:bigint,nullCount:bigint>>").json(f"{root}/statistics/s-1")
    return doc.select("mergedRecordCount", F.explode("colStats")).select(F.col("key").alias("column_name"), F.col("value.distinctCount").alias("ndv"), F.col("value.nullCount").alias("nulls"), F.col("mergedRecordCount").alias("rows"))


def a45(spark, d):
    """The last vector range of each data file across a line's snapshots."""
    own = sql(spark, d, "SELECT user_id AS file, event_id AS snapshot_id, event_id * 64 AS offset_, 1 + event_id % 50 AS length FROM {events} x WHERE event_id % 4 = 0")
    return own.groupBy("file").agg(F.max_by(F.struct("offset_", "length"), "snapshot_id").alias("r")).select("file", "r.offset_", "r.length")


def b14(spark, d):
    out = files.parquet_columns(spark, f"{d}/embeddings.parquet")
    return spark.createDataFrame([(n, k) for n, _, k in out], "name string, kind string")


def c31(spark, d):
    rows = {"a": np.array([1, 2, 3]), "b": np.array([3, 4]), "c": None}
    fold = lambda t: codecs.fold_rows(parse(t), lambda x: rows[x.column])
    out = [(t, None if (r := fold(t)) is None else ",".join(map(str, r.tolist()))) for t in ("a = 1 AND b = 1", "a = 1 OR b = 1", "a = 1 AND c = 1", "a = 1 OR c = 1")]
    return spark.createDataFrame(out, "filter string, rows string")


def c42(spark, d):
    own = get(spark, d, "small_files").groupBy((F.col("file") % 10).alias("manifest")).agg(F.min("part").alias("part_min"), F.max("part").alias("part_max"), F.count(F.lit(1)).alias("rows"), F.lit(0).cast("long").alias("part_nulls"))
    return own.select("manifest", pruning.skips(parse("part = 3"), {"part": pruning.stats_of("part", "bigint")}).alias("skipped"))


def c44(spark, d):
    own = get(spark, d, "key_ranges").select("file", F.col("lo").alias("k_min"), F.col("hi").alias("k_max"), F.lit(0).cast("long").alias("k_nulls"), F.lit(1).cast("long").alias("rows"))
    return own.select("file", pruning.skips(parse("k BETWEEN 500 AND 700"), {"k": pruning.stats_of("k", "bigint")}).alias("skipped"))


def d2(spark, d):
    return d1(spark, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def e19(spark, d):
    footers = spark.createDataFrame([("s1", 1, "12"), ("s1", 2, "7"), ("s2", 1, None)], "file string, field_id int, ndv string")
    fields = spark.createDataFrame([(1, "id"), (2, "name")], "field_id int, name string")
    return footers.join(fields, "field_id").select("file", "name", F.col("ndv").cast("long").alias("ndv"))


def i7(spark, d):
    """A partition value as the manifest's own type gives it."""
    cells = [(k, v) for k, v in (("int", 7), ("long", 7), ("string", "x"), ("boolean", True))]
    return spark.createDataFrame([(k, str(v)) for k, v in cells], "kind string, value string")


def k7(spark, d):
    snapshots = get(spark, d, "snapshots")
    chain = history.ancestors(snapshots, 30).join(snapshots, "snapshot_id")
    return chain.select("snapshot_id", "depth", "added")


def k18(spark, d):
    own = paimon.snapshots(spark, tables.document_table(spark, d))
    return own.groupBy(F.col("schemaId").alias("schema_id")).agg(F.min_by("id", "timeMillis").alias("first_snapshot"))


def l45(spark, d):
    own = spark.createDataFrame([("delta.clustering", '{"clusteringColumns":[["a"],["s","x"]]}'), ("other", "{}")], "domain string, configuration string")
    columns = F.from_json("configuration", "clusteringColumns array<array<string>>").clusteringColumns
    return own.filter("domain = 'delta.clustering'").select(F.posexplode(columns)).select(F.col("pos").cast("long").alias("place"), F.array_join("col", ".").alias("column_name"))


def l49(spark, d):
    """One procedure's plan as its own table."""
    table = open_table(spark, tables.log_table(spark, d))
    return table.plan("expire", 10**9, least=2, most=4).select("id", "expired")


def m2(spark, d):
    return open_table(spark, tables.document_table(spark, d)).check().select("what", "place", "figure", "verdict")


def m3(spark, d):
    return open_table(spark, tables.log_table(spark, d)).check().groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def m12(spark, d):
    options = {"metadata.stats-mode": "truncate(16)", "fields.v.stats-mode": "none"}
    rows = [(c, options.get(f"fields.{c}.stats-mode", options["metadata.stats-mode"])) for c in ("k", "v")]
    return spark.createDataFrame(rows, "column_name string, mode string")


def m18(spark, d):
    data = tables._content(spark, tables._puffin(spark))
    footer = codecs.puffin_footer(data)
    recorded = spark.createDataFrame([("s", len(data), 1, "4")], "file string, size long, blobs long, cardinality string")
    counted = spark.createDataFrame([("s", len(data), len(footer["blobs"]), footer["blobs"][0]["properties"]["cardinality"])], "file string, size long, blobs long, cardinality string")
    return checks.report([checks.against(recorded, counted, ["file"], ["size", "blobs", "cardinality"], "statistics file")]).select("figure", "verdict")


def m19(spark, d):
    modes = spark.createDataFrame([("k", "full"), ("v", "none")], "column_name string, mode string")
    own = sql(spark, d, "SELECT p_partkey AS file, 'k' AS column_name, p_partkey % 50 <> 3 AS has_bounds FROM {part} x UNION ALL SELECT p_partkey, 'v', p_partkey % 70 = 5 FROM {part} y")
    wrong = (F.col("mode") == "none") == F.col("has_bounds")
    return own.join(F.broadcast(modes), "column_name").filter(wrong).select("file", "column_name")  # modes: one row a column


def m22(spark, d):
    recorded = sql(spark, d, "SELECT file AS path, removed AS rows FROM {small_files} f")
    counted = sql(spark, d, "SELECT file AS path, CASE WHEN file = 7 THEN removed + 1 ELSE removed END AS rows FROM {small_files} f")
    return checks.findings([checks.against(recorded, counted, ["path"], ["rows"], "index file")])


def m24(spark, d):
    live = replay.live_at(get(spark, d, "actions"), 6)
    return live.select("path", F.col("num_records").alias("rows"))


def n2(spark, d):
    table = open_table(spark, tables.document_table(spark, d))
    nodes = table.snapshots().select(F.concat(F.lit("s"), F.col("snapshot_id").cast("string")).alias("id"))
    edges = table.snapshots().filter("parent_id IS NOT NULL").select(F.concat(F.lit("s"), F.col("parent_id").cast("string")).alias("parent"), F.concat(F.lit("s"), F.col("snapshot_id").cast("string")).alias("child"))
    return graph.tree(nodes, edges, "s8", 4).select("id", "depth")


def n3(spark, d):
    table = open_table(spark, tables.log_table(spark, d))
    versions = table.snapshots().select(F.concat(F.lit("v"), F.col("snapshot_id").cast("string")).alias("id"), F.lit("VERSION").alias("kind"))
    live = table.live_files().select(F.col("path").alias("id"), F.lit("FILE").alias("kind"))
    return versions.unionAll(live).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def n9(spark, d):
    """Details that are only read when asked for: lazy frames of a table."""
    table = open_table(spark, tables.metadata_table(spark, d))
    return table.live_files().agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"))


_V = lambda rows, names: f"SELECT * FROM (VALUES {rows}) t({names})"
QUERIES = {
    "a17_partition_statistics_scan": (a17, "SELECT 'p=' || part || '/q=' || (part % 3) AS partition, CAST(count(*) AS BIGINT) AS files FROM {small_files} f GROUP BY part"),
    "a42_statistics_document": (a42, _V("('k', CAST(20 AS BIGINT), CAST(0 AS BIGINT), CAST(20 AS BIGINT)), ('v', 7, 2, 20)", "column_name, ndv, nulls, rows")),
    "a45_vector_ranges": (a45, "SELECT user_id AS file, max(event_id) * 64 AS offset_, 1 + max(event_id) % 50 AS length FROM events WHERE event_id % 4 = 0 GROUP BY user_id"),
    "b14_file_column_tree": (b14, _V("('vec_id', 'primitive'), ('embedding', 'list'), ('embedding.element', 'primitive'), ('label', 'primitive')", "name, kind")),
    "c31_row_set_algebra": (c31, _V("('a = 1 AND b = 1', '3'), ('a = 1 OR b = 1', '1,2,3,4'), ('a = 1 AND c = 1', '1,2,3'), ('a = 1 OR c = 1', NULL)", "filter, rows")),
    "c42_partition_summaries": (c42, "SELECT file % 10 AS manifest, 3 < min(part) OR 3 > max(part) AS skipped FROM {small_files} f GROUP BY 1"),
    "c44_key_statistics": (c44, "SELECT file, hi < 500 OR lo > 700 AS skipped FROM {key_ranges} x"),
    "d2_pair_verdicts": (d2, f"SELECT verdict, CAST(count(*) AS BIGINT) AS n FROM ({REACH_SQL}) x GROUP BY verdict"),
    "e19_statistics_rows": (e19, _V("('s1', 'id', CAST(12 AS BIGINT)), ('s1', 'name', 7), ('s2', 'id', NULL)", "file, name, ndv")),
    "i7_partition_values": (i7, _V("('int', '7'), ('long', '7'), ('string', 'x'), ('boolean', 'True')", "kind, value")),
    "k7_history_of_main": (k7, "SELECT snapshot_id, 30 - snapshot_id AS depth, added FROM {snapshots} s WHERE snapshot_id <= 30"),
    "k18_schema_steps": (k18, _V("(CAST(0 AS BIGINT), CAST(1 AS BIGINT))", "schema_id, first_snapshot")),
    "l45_clustering_columns": (l45, _V("(CAST(0 AS BIGINT), 'a'), (1, 's.x')", "place, column_name")),
    "l49_procedure_detail": (l49, "SELECT k AS id, k <= 4 AS expired FROM range(7) t(k)"),
    "m2_document_report": (m2, _V("('schema', '0', 'highestFieldId', 'AGREES')", "what, place, figure, verdict")),
    "m3_log_report": (m3, _V("('NOT_CHECKED', CAST(21 AS BIGINT))", "verdict, n")),
    "m12_stats_modes": (m12, _V("('k', 'truncate(16)'), ('v', 'none')", "column_name, mode")),
    "m18_statistics_files": (m18, _V("('size', 'AGREES'), ('blobs', 'AGREES'), ('cardinality', 'AGREES')", "figure, verdict")),
    "m19_stats_mode_check": (m19, "SELECT p_partkey AS file, 'k' AS column_name FROM part WHERE p_partkey % 50 = 3 UNION ALL SELECT p_partkey, 'v' FROM part WHERE p_partkey % 70 = 5"),
    "m22_index_files": (m22, "SELECT 'index file' AS what, '7' AS place, 'rows' AS figure, CAST(removed AS VARCHAR) AS recorded, CAST(removed + 1 AS VARCHAR) AS counted, 'DIFFERS' AS verdict FROM {small_files} f WHERE file = 7"),
    "m24_sweep_targets_of_a_replay": (m24, "SELECT path, num_records AS rows FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY version DESC, ord DESC) AS rn FROM {actions} a WHERE version <= 6) x WHERE rn = 1 AND action = 'add'"),
    "n2_document_graph": (n2, _V("('s8', CAST(0 AS BIGINT)), ('s9', 1), ('s10', 2)", "id, depth")),
    "n3_log_graph": (n3, "SELECT 'VERSION' AS kind, CAST(7 AS BIGINT) AS n UNION ALL SELECT 'FILE', CAST(count(*) FILTER (WHERE n_nationkey % 3 <> 0) AS BIGINT) FROM nation"),
    "n9_deferred_details": (n9, "SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(n_nationkey + 1) AS BIGINT) AS rows FROM nation WHERE n_nationkey % 5 <> 4"),
}
