"""Queries of merged tables, logs, histories and ledgers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.operators import history, merge, pruning, replay
from siltstone.operators.predicates import parse
from siltstone.plans.fixtures import frame, sql

DEDUP = merge.merge_rule({})
FIRST = merge.merge_rule({"merge-engine": "first-row"})
PARTIAL = merge.merge_rule({"merge-engine": "partial-update", "partial-update.remove-record-on-delete": "true"})
get = frame


def records(spark, d):
    return get(spark, d, "lsm_records")


def state(spark, d, removing=(1, 3)):
    return merge.latest_per_key(records(spark, d), ["k"], removing)


def e12(spark, d):
    return state(spark, d)


def counted(rule):
    def run(spark, d):
        own = merge.latest_per_key(records(spark, d), ["k", "bucket"], rule.removing or (9,))
        return merge.merged_count(own, rule, ["bucket"])

    return run


def e14(spark, d):
    return counted(DEDUP)(spark, d).agg(F.sum("keys").alias("keys"), F.sum("live").alias("live"))


def e15(spark, d):
    rules = [({}, "deduplicate"), ({"merge-engine": "first-row"}, "first-row"), ({"merge-engine": "partial-update"}, "partial-update"), ({"merge-engine": "aggregation"}, "aggregation"), ({"ignore-delete": "true"}, "ignore-delete")]
    rows = [(name, r.keep, len(r.removing), len(r.rejects), r.skips_level_0) for o, name in rules for r in [merge.merge_rule(o)]]
    return spark.createDataFrame(rows, "engine string, keep string, removing int, rejects int, skips_level_0 boolean")


def e26(spark, d):
    return merge.aggregated(records(spark, d), ["k"], {"a": "sum", "b": "last_non_null_value", "ga": "max"})


def partial(spark, d):
    return merge.partially_updated(records(spark, d), ["k"], ["a", "b"])


def e27(spark, d):
    return merge.sequence_groups(records(spark, d), ["k"], {"ga": ["a"], "gb": ["b"]})


def e27_fold(spark, d):
    return merge.removed_fold(records(spark, d), ["k"], "a", "ga")


def w1(spark, d):
    own = records(spark, d).withColumn("last_removal", F.max(F.when(F.col("kind").isin(1, 3), F.col("s"))).over(Window.partitionBy("k")))
    return own.select("k", "s", "last_removal")


def k4(rule):
    def run(spark, d):
        own = merge.row_fates(records(spark, d), state(spark, d, rule.removing or (9,)), ["k"], rule)
        return own.groupBy("k", "fate").agg(F.count(F.lit(1)).alias("n"))

    return run


def read_back(spark, d):
    return merge.deduplicated(records(spark, d), ["k"], ["a", "b"])


def first_back(spark, d):
    return merge.first_rows(records(spark, d), ["k"], ["a", "b"])


def c25(spark, d):
    files = sql(spark, d, "SELECT file, bucket, level, lo AS k_min, hi AS k_max, CAST(0 AS BIGINT) AS k_nulls, lo % 100 AS v_min, lo % 100 + 10 AS v_max, CAST(0 AS BIGINT) AS v_nulls, CAST(10 AS BIGINT) AS rows FROM {key_ranges} x")
    stats = {"k": pruning.stats_of("k", "bigint"), "v": pruning.stats_of("v", "bigint")}
    return pruning.by_bucket(files, parse("k >= 1000 AND k < 3000 AND v > 200"), stats, ["k"], ["bucket"], skip_level_0=True).select("file", "fate")


def c28(spark, d):
    keys = sql(spark, d, "SELECT l_partkey * 7 AS key FROM {lineitem} x").distinct()
    return merge.key_range_files(get(spark, d, "key_ranges"), keys)


def d12(spark, d):
    """The tuples come from the whole table, so how many there are is left to the planner."""
    own = records(spark, d)
    keys = own.filter("k % 7 = 0").select("k", (F.col("k") % 3).alias("level")).distinct()
    return own.join(keys, ["k", "level"], "left_semi").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def d11(spark, d):
    """Files of a split stitched on the row number; each column from its freshest holder."""
    rows = get(spark, d, "data_rows")
    f0, f1 = rows.select("file_id", "pos", F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")), rows.select("file_id", "pos", (F.col("l_suppkey") * 2).alias("b"))
    return f0.select("file_id", "pos", "a").join(f1, ["file_id", "pos"]).select("file_id", "pos", "a", "b")


def d20(spark, d):
    return merge.sections(get(spark, d, "key_ranges"), ["bucket"]).groupBy("bucket", F.col("section").cast("long").alias("section")).agg(F.count(F.lit(1)).alias("files"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def l23(spark, d):
    return merge.lsm_shape(get(spark, d, "key_ranges"), ["bucket"])


def j5(spark, d):
    own = records(spark, d)
    return own.groupBy(merge.kind_name(F.col("kind")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(merge.retracts(F.col("kind"))).alias("retractions"))


# ---- logs


def actions(spark, d):
    return get(spark, d, "actions")


def w3(spark, d):
    return replay.live_at(actions(spark, d), 6).select("path", "version", "ord", "size")


def w4(spark, d):
    return replay.contributions(replay.trace(actions(spark, d))).select("version", "delta", "replaced", "absent", "live")


def w5(spark, d):
    return replay.trace(actions(spark, d)).groupBy("path", "effect").agg(F.count(F.lit(1)).alias("n"))


def w6(spark, d):
    checkpoint = replay.live_at(actions(spark, d), 4).drop("version", "ord")
    return replay.from_checkpoint(checkpoint, actions(spark, d), 4, 8).select("path", "size")


def w6_gap(spark, d):
    own = actions(spark, d).filter("version NOT IN (3, 5)")
    return replay.missing_versions(own, 0, 7)


def w14(spark, d):
    return replay.live_at(actions(spark, d)).select("path", "size")


def e28(spark, d):
    return replay.state_sums(replay.live_at(actions(spark, d), 7))


def e32(spark, d):
    return replay.live_at(actions(spark, d), 5).select("path", F.col("num_records").alias("rows"), F.col("size").alias("bytes"))


def k17(spark, d):
    return replay.live_by_version(actions(spark, d)).groupBy("at_version").agg(F.count(F.lit(1)).alias("files"), F.min("since").alias("oldest"))


def k11(spark, d):
    return history.file_history(replay.live_by_version(actions(spark, d)))


def d14(spark, d):
    a, b = replay.live_at(actions(spark, d), 3), replay.live_at(actions(spark, d), 8)
    return replay.diff(a, b, "path", "size")


def u3(spark, d):
    a, b = replay.live_at(actions(spark, d), 3), replay.live_at(actions(spark, d), 8)
    return replay.difference(a, b, ["path", "size"])


def j1(spark, d):
    return replay.change_feed(actions(spark, d), 2, 4).groupBy("version", "change_type").agg(F.count(F.lit(1)).alias("n"), F.sum("num_records").alias("rows"))


def j2(spark, d):
    return replay.change_feed(actions(spark, d), 0, 9).filter("path = 7").select("version", "path", "change_type", F.col("kind").cast("long").alias("kind"), "num_records")


def j4(spark, d):
    own = records(spark, d).select((F.col("s") % 20).alias("version"), merge.kind_name(F.col("kind")).alias("kind"), "k", "a")
    return own.filter("k IN (7, 12) AND version < 10")


COMMITS = "SELECT CAST(event_id AS BIGINT) AS version, CAST(event_id * 1000 - (event_id % 7) * 900 - (CASE WHEN event_id % 10 = 0 THEN 4000 ELSE 0 END) AS BIGINT) AS at_ms, (event_id * 37) % 5000 AS base_row_id, 1 + event_id % 90 AS num_records FROM {events} x"


def w9(spark, d):
    return replay.monotone_times(sql(spark, d, COMMITS)).select("version", "adjusted")


def m16(spark, d):
    return replay.not_rising(sql(spark, d, COMMITS)).select("version", "at_ms", "before")


def m17(spark, d):
    return replay.high_water(sql(spark, d, COMMITS)).select("version", "high_water")


# ---- ledgers and snapshots

ENTRIES = "SELECT p_partkey % 10 AS manifest, p_partkey AS ord, p_partkey % 700 AS file, CAST(CASE WHEN p_partkey % 9 = 0 THEN 2 ELSE p_partkey % 2 END AS BIGINT) AS status, CAST(p_size AS BIGINT) AS rows FROM {part} x"


def e1(spark, d):
    return history.ledger(sql(spark, d, ENTRIES)).select("ord", "contribution")


def e2(spark, d):
    return history.ledger_total(history.ledger(sql(spark, d, ENTRIES)))


def e4(spark, d):
    return history.ledger_total(history.ledger(sql(spark, d, ENTRIES)), ["manifest"])


def e5(spark, d):
    own = sql(spark, d, ENTRIES)
    current = history.ledger_total(history.ledger(own, live_only=True)).withColumn("scope", F.lit("current"))
    return current.unionAll(history.ledger_total(history.ledger(own)).withColumn("scope", F.lit("history")))


def e6(spark, d):
    return sql(spark, d, ENTRIES).filter("status <> 2").groupBy("file").agg(F.min("ord").alias("ord"))


def e8(spark, d):
    files = sql(spark, d, "SELECT part, rows, size AS bytes FROM {small_files} x")
    return history.partition_breakdown(files).select("part", "files", "rows", "bytes", F.round("share", 9).alias("share"))


def e9(spark, d):
    own = sql(spark, d, ENTRIES)
    return own.groupBy("manifest").agg(F.count_if(F.col("status") == 1).alias("added"), F.count_if(F.col("status") == 2).alias("deleted"), F.sum(F.when(F.col("status") == 1, F.col("rows")).otherwise(0)).alias("added_rows"))


def e7(spark, d):
    own = history.ledger_total(history.ledger(sql(spark, d, ENTRIES), live_only=True)).select("files", "rows")
    recorded = spark.createDataFrame([("total-data-files", 1), ("total-records", 2)], "figure string, k int")
    pairs = own.crossJoin(F.broadcast(recorded))  # one row by two
    counted = F.when(F.col("k") == 1, F.col("files")).otherwise(F.col("rows"))
    return pairs.select("figure", counted.alias("counted"), (counted + F.col("k") - 1).alias("recorded"), (F.col("k") == 1).alias("agrees"))


def d21(spark, d):
    times = sql(spark, d, "SELECT DISTINCT o_orderdate AS t FROM {orders} x")
    return history.as_of(get(spark, d, "snapshots"), times)


def d23(spark, d):
    return history.ancestors(get(spark, d, "snapshots"), 70)


def d23_recursive(spark, d):
    return history.chain(get(spark, d, "snapshots"), 60)


LOG = "SELECT CAST(n AS BIGINT) AS ord, CAST(CASE WHEN n % 12 = 11 THEN n - 6 ELSE n END AS BIGINT) AS snapshot_id FROM (SELECT p_partkey AS n FROM {part}) y"


def k13(spark, d):
    return history.log_events(sql(spark, d, LOG)).select("ord", "snapshot_id", "event")


def k14(spark, d):
    return history.left_behind(sql(spark, d, LOG))


STEPS = "SELECT event_id % 10 AS step, user_id AS k, max(CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id % 5 END) AS digest FROM {events} x GROUP BY 1, 2"


def w2(spark, d):
    return history.row_changes(sql(spark, d, STEPS), "k").select("step", "k", "change")


def w7(spark, d):
    own = sql(spark, d, "SELECT p_partkey AS file, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 7 END AS entry_seq, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 11 END AS manifest_seq FROM {part} x")
    return history.effective_sequence(own).select("file", F.col("sequence").cast("long").alias("sequence"))


def b10(spark, d):
    own = sql(spark, d, "SELECT p_partkey % 20 AS manifest_id, p_partkey AS ord, CAST(p_size AS BIGINT) AS rows, CASE WHEN p_partkey % 50 = 0 THEN p_partkey * 1000 ELSE NULL END AS own_first_row_id, (p_partkey % 20) * 1000000 AS manifest_first_row_id FROM {part} x")
    return history.row_ids(own).select("ord", "first_row_id")


def w15(spark, d):
    w = Window.orderBy("at_time")
    return get(spark, d, "snapshots").select("snapshot_id", F.lag("snapshot_id").over(w).alias("previous"), F.lead("snapshot_id").over(w).alias("next"))


def d15(spark, d):
    return history.missing_files(get(spark, d, "referenced"), get(spark, d, "listing"))


def d16(spark, d):
    return history.unreferenced_files(get(spark, d, "listing"), get(spark, d, "referenced")).select("path", "size")


def d17(spark, d):
    return get(spark, d, "referenced").select("path").unionAll(actions(spark, d).select("path")).distinct()


FIELDS_A = "SELECT CAST(n AS BIGINT) AS id, concat('c', CAST(n AS VARCHAR(9))) AS name, 'int' AS type FROM (SELECT p_partkey AS n FROM {part}) y WHERE n % 6 <> 5"
FIELDS_B = "SELECT CAST(n AS BIGINT) AS id, concat(CASE WHEN n % 4 = 1 THEN 'd' ELSE 'c' END, CAST(n AS VARCHAR(9))) AS name, CASE WHEN n % 5 = 2 THEN 'long' ELSE 'int' END AS type FROM (SELECT p_partkey AS n FROM {part}) y WHERE n % 7 <> 3"


def u4(spark, d):
    return history.schema_changes(sql(spark, d, FIELDS_A), sql(spark, d, FIELDS_B))


def w8(spark, d):
    rows = [(x,) for x in history.moved([1, 2, 3, 4, 5, 6], [1, 4, 2, 3, 6, 5])]
    return spark.createDataFrame(rows, "field long")


def g1(spark, d):
    return get(spark, d, "snapshots").orderBy(F.col("parent_id").asc_nulls_first(), "snapshot_id").select("snapshot_id", "parent_id")


def g7(spark, d):
    return get(spark, d, "snapshots").orderBy(F.desc("snapshot_id")).limit(20).select("snapshot_id")


def u1(spark, d):
    rows = [records(spark, d).filter(F.col("bucket") == b).select("k", "s") for b in range(4)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def j6(spark, d):
    consumers = sql(spark, d, "SELECT user_id % 6 AS consumer, max(event_id) % 80 AS next_snapshot FROM {events} x GROUP BY 1")
    return consumers.agg(F.min("next_snapshot").alias("floor"))


_LIVE = lambda v: f"SELECT path, version, ord, num_records, size FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY version DESC, ord DESC) AS rn FROM {{actions}} a WHERE version <= {v}) x WHERE rn = 1 AND action = 'add'"
_TRACE = "SELECT *, CASE WHEN action = 'add' AND before = 'add' THEN 'REPLACED' WHEN action = 'add' THEN 'ADDED' WHEN before = 'add' THEN 'REMOVED' ELSE 'REMOVED_ABSENT' END AS effect FROM (SELECT *, lag(action) OVER (PARTITION BY path ORDER BY version, ord) AS before FROM {actions} a) t"
_BYVERSION = "SELECT g.v AS at_version, x.path, x.version AS since FROM (SELECT DISTINCT version AS v FROM {actions} a) g JOIN (SELECT *, coalesce(lead(version) OVER (PARTITION BY path ORDER BY version, ord), 999999) AS until FROM {actions} a) x ON x.action = 'add' AND g.v >= x.version AND g.v < x.until"
_STATE = lambda removing: f"SELECT k, max(s) AS last, arg_max(kind, s) AS last_kind, min(s) FILTER (WHERE kind = 0) AS first_insert, CAST(count(*) AS BIGINT) AS records, bool_or(kind IN (1, 3)) AS retracted, max(r) AS last_removal, CAST(count(*) FILTER (WHERE r IS NULL OR s > r) AS BIGINT) AS after_removal FROM (SELECT *, max(s) FILTER (WHERE kind IN ({removing})) OVER (PARTITION BY k) AS r FROM {{lsm_records}} x) y GROUP BY k"
_LEDGER = "SELECT *, CASE WHEN status = 2 THEN 'REMOVAL' WHEN row_number() OVER (PARTITION BY file, status = 2 ORDER BY ord) > 1 THEN 'DUPLICATE' ELSE 'COUNTED' END AS contribution FROM ({0}) e".format(ENTRIES)
_TOTAL = "CAST(count(*) AS BIGINT) AS entries, CAST(count(*) FILTER (WHERE contribution = 'COUNTED') AS BIGINT) AS files, CAST(coalesce(sum(rows) FILTER (WHERE contribution = 'COUNTED'), 0) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE contribution = 'REMOVAL') AS BIGINT) AS removed"
_AFTER = "SELECT * FROM (SELECT *, max(s) FILTER (WHERE kind = 3) OVER (PARTITION BY k) AS r FROM {lsm_records} x WHERE kind <> 1) y WHERE r IS NULL OR s > r"
_BUCKETS = lambda live, rejected, removing: f"SELECT bucket, CAST(count(*) AS BIGINT) AS keys, CAST(count(*) FILTER (WHERE {live}) AS BIGINT) AS live, CAST(count(*) FILTER (WHERE {rejected}) AS BIGINT) AS rejected FROM ({_STATE(removing)}) s JOIN (SELECT DISTINCT k AS k2, bucket FROM {{lsm_records}} x) b ON s.k = b.k2 GROUP BY bucket"
_FATES = lambda ladder, removing: f"SELECT k, fate, CAST(count(*) AS BIGINT) AS n FROM (SELECT r.k, CASE {ladder} ELSE 'SUPERSEDED' END AS fate FROM {{lsm_records}} r JOIN ({_STATE(removing)}) st ON r.k = st.k) z GROUP BY k, fate"

#: The fold, a record of each key after the other.
_FOLD = """WITH RECURSIVE o AS (SELECT k, kind, ga AS g, a AS v, row_number() OVER (PARTITION BY k ORDER BY s) AS rn FROM {lsm_records} x),
    w AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS g, CAST(NULL AS BIGINT) AS v, FALSE AS alive FROM o
    UNION ALL SELECT k, rn, CASE WHEN takes AND kind <> 1 THEN new_g ELSE g END, CASE WHEN takes AND kind = 3 THEN NULL WHEN takes AND kind <> 1 THEN new_v ELSE v END, CASE WHEN takes AND kind = 3 THEN FALSE ELSE alive OR kind IN (0, 2) END
        FROM (SELECT w.k, o.rn, w.g, w.v, w.alive, o.kind, o.g AS new_g, o.v AS new_v, o.g IS NOT NULL AND (w.g IS NULL OR o.g >= w.g) AS takes FROM w JOIN o ON o.k = w.k AND o.rn = w.rn + 1) x)
    SELECT k, g AS ga, v AS a FROM w WHERE alive AND rn = (SELECT max(rn) FROM o WHERE o.k = w.k)"""

QUERIES = {
    "b10_row_lineage": (b10, "SELECT ord, CAST(coalesce(own, m + coalesce(before, 0)) AS BIGINT) AS first_row_id FROM (SELECT p_partkey AS ord, CASE WHEN p_partkey % 50 = 0 THEN p_partkey * 1000 END AS own, (p_partkey % 20) * 1000000 AS m, sum(p_size) OVER (PARTITION BY p_partkey % 20 ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM part) x"),
    "c25_key_files_of_a_bucket": (c25, "SELECT file, CASE WHEN hi < 1000 OR lo >= 3000 THEN 'SKIPPED_BY_KEY' WHEN level = 0 THEN 'LEVEL_0' ELSE 'BUCKET_SKIPPED' END AS fate FROM {key_ranges} x"),
    "c28_key_range_files": (c28, "SELECT DISTINCT file, key FROM {key_ranges} f JOIN (SELECT DISTINCT l_partkey * 7 AS key FROM lineitem) k ON key BETWEEN lo AND hi"),
    "d11_row_number_stitch": (d11, "SELECT file_id, pos, l_orderkey AS a, l_suppkey * 2 AS b FROM {data_rows} x"),
    "d12_key_tuples": (d12, "SELECT k, CAST(count(*) AS BIGINT) AS n FROM {lsm_records} x WHERE k % 7 = 0 AND level = k % 3 GROUP BY k"),
    "d14_file_set_diff": (d14, f"SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'ONLY_IN_FROM' WHEN a.path IS NULL THEN 'ONLY_IN_TO' WHEN a.size <> b.size THEN 'CHANGED' ELSE 'IN_BOTH' END AS side FROM ({_LIVE(3)}) a FULL JOIN ({_LIVE(8)}) b ON a.path = b.path"),
    "d15_missing_files": (d15, "SELECT path, string_agg(CAST(snapshot_id AS VARCHAR), ',' ORDER BY snapshot_id) AS snapshots FROM (SELECT DISTINCT path, snapshot_id FROM {referenced} r WHERE NOT EXISTS (SELECT 1 FROM {listing} l WHERE l.path = r.path)) x GROUP BY path"),
    "d16_unreferenced_files": (d16, "SELECT path, size FROM {listing} l WHERE NOT EXISTS (SELECT 1 FROM {referenced} r WHERE l.path = r.path)"),
    "d17_referenced_set": (d17, "SELECT path FROM {referenced} r UNION SELECT path FROM {actions} a"),
    "d20_interval_sections": (d20, "SELECT bucket, section, CAST(count(*) AS BIGINT) AS files, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, CAST(sum(fresh) OVER (PARTITION BY bucket ORDER BY lo, hi, file) AS BIGINT) AS section FROM (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY bucket ORDER BY lo, hi, file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS FALSE THEN 0 ELSE 1 END AS fresh FROM {key_ranges} k) x) y GROUP BY bucket, section"),
    "d21_as_of_snapshot": (d21, "SELECT t, (SELECT max(snapshot_id) FROM {snapshots} s WHERE s.at_time <= t) AS snapshot_id FROM (SELECT DISTINCT o_orderdate AS t FROM orders) x"),
    "d23_ancestor_chain": (d23, "SELECT snapshot_id, 70 - snapshot_id AS depth FROM {snapshots} s WHERE snapshot_id <= 70"),
    "d23_ancestor_chain_recursive": (d23_recursive, "SELECT snapshot_id, 60 - snapshot_id AS depth FROM {snapshots} s WHERE snapshot_id <= 60"),
    "e1_manifest_ledger": (e1, f"SELECT ord, contribution FROM ({_LEDGER}) l"),
    "e2_ledger_total": (e2, f"SELECT {_TOTAL} FROM ({_LEDGER}) l"),
    "e4_stats_derivation": (e4, f"SELECT manifest, {_TOTAL} FROM ({_LEDGER}) l GROUP BY manifest"),
    "e5_current_and_history": (e5, f"SELECT 'history' AS scope, {_TOTAL} FROM ({_LEDGER}) l UNION ALL SELECT 'current' AS scope, {_TOTAL} FROM ({_LEDGER}) l WHERE status <> 2"),
    "e6_live_files": (e6, f"SELECT file, min(ord) AS ord FROM ({ENTRIES}) e WHERE status <> 2 GROUP BY file"),
    "e7_snapshot_totals": (e7, f"SELECT 'total-data-files' AS figure, files AS counted, files AS recorded, TRUE AS agrees FROM (SELECT {_TOTAL} FROM ({_LEDGER}) l WHERE status <> 2) x UNION ALL SELECT 'total-records', rows, rows + 1, FALSE FROM (SELECT {_TOTAL} FROM ({_LEDGER}) l WHERE status <> 2) y"),
    "e8_partition_breakdown": (e8, "SELECT part, CAST(count(*) AS BIGINT) AS files, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(size) AS BIGINT) AS bytes, round(CAST(sum(rows) AS DOUBLE) / (SELECT sum(rows) FROM {small_files} z), 9) AS share FROM {small_files} x GROUP BY part"),
    "e9_commit_change": (e9, f"SELECT manifest, CAST(count(*) FILTER (WHERE status = 1) AS BIGINT) AS added, CAST(count(*) FILTER (WHERE status = 2) AS BIGINT) AS deleted, CAST(sum(CASE WHEN status = 1 THEN rows ELSE 0 END) AS BIGINT) AS added_rows FROM ({ENTRIES}) e GROUP BY manifest"),
    "e12_latest_per_key": (e12, _STATE("1, 3")),
    "e13_merged_count_of_buckets": (counted(DEDUP), _BUCKETS("last_kind NOT IN (1, 3)", "FALSE", "1, 3")),
    "e13_first_row_count": (counted(FIRST), _BUCKETS("first_insert IS NOT NULL", "retracted", "9")),
    "e13_partial_update_count": (counted(PARTIAL), _BUCKETS("after_removal > 0", "FALSE", "3")),
    "e14_merged_count_of_table": (e14, f"SELECT CAST(count(*) AS BIGINT) AS keys, CAST(count(*) FILTER (WHERE last_kind NOT IN (1, 3)) AS BIGINT) AS live FROM ({_STATE('1, 3')}) s"),
    "e15_merge_rules": (e15, "SELECT engine, keep, CAST(removing AS INTEGER) AS removing, CAST(rejects AS INTEGER) AS rejects, skips_level_0 FROM (VALUES ('deduplicate', 'LATEST', 2, 0, FALSE), ('first-row', 'FIRST', 0, 2, TRUE), ('partial-update', 'COMBINED', 0, 2, FALSE), ('aggregation', 'COMBINED', 0, 0, FALSE), ('ignore-delete', 'LATEST', 0, 0, FALSE)) t(engine, keep, removing, rejects, skips_level_0)"),
    "e26_aggregate_merge": (e26, f"SELECT k, CAST(sum(a) AS BIGINT) AS a, arg_max(b, s) FILTER (WHERE b IS NOT NULL) AS b, max(ga) AS ga FROM ({_AFTER}) z GROUP BY k"),
    "e26_partial_update": (partial, f"SELECT k, arg_max(a, s) FILTER (WHERE a IS NOT NULL) AS a, arg_max(b, s) FILTER (WHERE b IS NOT NULL) AS b FROM ({_AFTER}) z GROUP BY k"),
    "e27_sequence_groups": (e27, "SELECT g.k, g.ga, g.a, h.gb, h.b FROM (SELECT k, ga, a FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ga DESC, s DESC) AS rn FROM {lsm_records} x WHERE kind IN (0, 2)) y WHERE rn = 1) g JOIN (SELECT k, gb, b FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gb DESC, s DESC) AS rn FROM {lsm_records} x WHERE kind IN (0, 2)) y WHERE rn = 1) h ON g.k = h.k"),
    "e27_sequence_group_fold": (e27_fold, _FOLD),
    "e28_state_sums": (e28, f"SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(num_records) AS BIGINT) AS rows FROM ({_LIVE(7)}) l"),
    "e32_live_files_of_a_log": (e32, f"SELECT path, num_records AS rows, size AS bytes FROM ({_LIVE(5)}) l"),
    "g1_metadata_order": (g1, "SELECT snapshot_id, parent_id FROM {snapshots} s ORDER BY parent_id NULLS FIRST"),
    "g7_newest_snapshots": (g7, "SELECT snapshot_id FROM {snapshots} s ORDER BY snapshot_id DESC LIMIT 20"),
    "j1_change_feed_inputs": (j1, "SELECT version, CASE WHEN action = 'add' THEN 'insert' ELSE 'delete' END AS change_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(num_records) AS BIGINT) AS rows FROM {actions} a WHERE version BETWEEN 2 AND 4 GROUP BY 1, 2"),
    "j2_change_feed_trace": (j2, "SELECT version, path, CASE WHEN action = 'add' THEN 'insert' ELSE 'delete' END AS change_type, CAST(CASE WHEN action = 'add' THEN 0 ELSE 3 END AS BIGINT) AS kind, num_records FROM {actions} a WHERE path = 7 AND version <= 9"),
    "j4_changelog_trace": (j4, "SELECT s % 20 AS version, CASE kind WHEN 0 THEN '+I' WHEN 1 THEN '-U' WHEN 2 THEN '+U' ELSE '-D' END AS kind, k, a FROM {lsm_records} x WHERE k IN (7, 12) AND s % 20 < 10"),
    "j5_row_kind_codec": (j5, "SELECT CASE kind WHEN 0 THEN '+I' WHEN 1 THEN '-U' WHEN 2 THEN '+U' ELSE '-D' END AS kind, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE kind IN (1, 3)) AS BIGINT) AS retractions FROM {lsm_records} x GROUP BY 1"),
    "j6_consumer_floor": (j6, "SELECT min(n) AS floor FROM (SELECT max(event_id) % 80 AS n FROM events GROUP BY user_id % 6) x"),
    "k4_merged_row_fates": (k4(DEDUP), _FATES("WHEN kind IN (1, 3) THEN 'RETRACTION' WHEN s = last THEN 'LIVE'", "1, 3")),
    "k4_first_row_fates": (k4(FIRST), _FATES("WHEN level = 0 THEN 'SKIPPED' WHEN s = first_insert THEN 'LIVE'", "9")),
    "k4_combined_row_fates": (k4(PARTIAL), _FATES("WHEN kind = 3 THEN 'RETRACTION' WHEN last_removal IS NOT NULL AND s <= last_removal THEN 'SUPERSEDED' WHEN after_removal > 1 THEN 'MERGED' WHEN TRUE THEN 'LIVE'", "3")),
    "k9_deduplicated_read": (read_back, "SELECT k, a, b FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC) AS rn FROM {lsm_records} x) y WHERE rn = 1 AND kind NOT IN (1, 3)"),
    "k9_first_row_read": (first_back, "SELECT k, a, b FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s) AS rn FROM {lsm_records} x WHERE kind = 0) y WHERE rn = 1"),
    "k11_file_history": (k11, f"SELECT path, since, max(at_version) AS last_version FROM ({_BYVERSION}) v GROUP BY path, since"),
    "k13_snapshot_log": (k13, f"SELECT ord, snapshot_id, CASE WHEN row_number() OVER (PARTITION BY snapshot_id ORDER BY ord) > 1 THEN 'RESET' ELSE 'COMMIT' END AS event FROM ({LOG}) l"),
    "k14_left_behind": (k14, "SELECT f.snapshot_id, min(r.ord) AS reset_ord FROM (SELECT snapshot_id, min(ord) AS ord FROM ({0}) a GROUP BY snapshot_id) f JOIN ({0}) r ON r.ord > r.snapshot_id JOIN (SELECT snapshot_id, min(ord) AS ord FROM ({0}) b GROUP BY snapshot_id) t ON t.snapshot_id = r.snapshot_id WHERE f.ord > t.ord AND f.ord < r.ord GROUP BY f.snapshot_id".format(LOG)),
    "k17_live_files_by_version": (k17, f"SELECT at_version, CAST(count(*) AS BIGINT) AS files, min(since) AS oldest FROM ({_BYVERSION}) v GROUP BY at_version"),
    "l23_lsm_shape": (l23, "SELECT bucket, CAST(count(*) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(count(*) FILTER (WHERE level = 0) + count(DISTINCT CASE WHEN level > 0 THEN level END) AS BIGINT) AS runs FROM {key_ranges} x GROUP BY bucket"),
    "m16_commit_times_rise": (m16, f"SELECT version, at_ms, before FROM (SELECT *, lag(at_ms) OVER (ORDER BY version) AS before FROM ({COMMITS}) c) x WHERE at_ms <= before"),
    "m17_row_id_high_water": (m17, f"SELECT version, max(top) OVER (ORDER BY version) AS high_water FROM (SELECT version, max(base_row_id + num_records - 1) AS top FROM ({COMMITS}) c GROUP BY version) x"),
    "u1_union_of_bucket_files": (u1, "SELECT k, CAST(count(*) AS BIGINT) AS n FROM {lsm_records} x GROUP BY k"),
    "u3_checkpoint_difference": (u3, f"SELECT path, size, 'ONLY_IN_FROM' AS side FROM (SELECT path, size FROM ({_LIVE(3)}) a EXCEPT SELECT path, size FROM ({_LIVE(8)}) b) x UNION ALL SELECT path, size, 'ONLY_IN_TO' FROM (SELECT path, size FROM ({_LIVE(8)}) b EXCEPT SELECT path, size FROM ({_LIVE(3)}) a) y"),
    "u4_schema_difference": (u4, f"SELECT * FROM (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'ADDED' WHEN b.id IS NULL THEN 'DROPPED' WHEN a.name <> b.name THEN 'RENAMED' WHEN a.type <> b.type THEN 'RETYPED' END AS change FROM ({FIELDS_A}) a FULL JOIN ({FIELDS_B}) b ON a.id = b.id) x WHERE change IS NOT NULL"),
    "w1_last_removal_window": (w1, "SELECT k, s, max(s) FILTER (WHERE kind IN (1, 3)) OVER (PARTITION BY k) AS last_removal FROM {lsm_records} x"),
    "w2_row_changes": (w2, f"SELECT step, k, CASE WHEN before IS NULL AND digest IS NOT NULL THEN 'APPEARED' WHEN before IS NOT NULL AND digest IS NULL THEN 'GONE' WHEN before IS NOT DISTINCT FROM digest THEN 'UNCHANGED' ELSE 'CHANGED' END AS change FROM (SELECT *, lag(digest) OVER (PARTITION BY k ORDER BY step) AS before FROM ({STEPS}) s) x"),
    "w3_log_replay": (w3, f"SELECT path, version, ord, size FROM ({_LIVE(6)}) l"),
    "w4_manifest_replay": (w4, f"SELECT version, delta, replaced, absent, CAST(sum(delta) OVER (ORDER BY version) AS BIGINT) AS live FROM (SELECT version, CAST(sum(CASE effect WHEN 'ADDED' THEN 1 WHEN 'REMOVED' THEN -1 ELSE 0 END) AS BIGINT) AS delta, CAST(count(*) FILTER (WHERE effect = 'REPLACED') AS BIGINT) AS replaced, CAST(count(*) FILTER (WHERE effect = 'REMOVED_ABSENT') AS BIGINT) AS absent FROM ({_TRACE}) t GROUP BY version) x"),
    "w5_replay_trace": (w5, f"SELECT path, effect, CAST(count(*) AS BIGINT) AS n FROM ({_TRACE}) t GROUP BY path, effect"),
    "w6_rebuild_from_checkpoint": (w6, f"SELECT path, size FROM ({_LIVE(8)}) l"),
    "w6_missing_commits": (w6_gap, "SELECT * FROM (VALUES (CAST(3 AS BIGINT)), (CAST(5 AS BIGINT))) t(version)"),
    "w7_effective_sequence": (w7, "SELECT p_partkey AS file, CAST(coalesce(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 7 END, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 11 END, 0) AS BIGINT) AS sequence FROM part"),
    "w8_moved_fields": (w8, "SELECT * FROM (VALUES (CAST(4 AS BIGINT)), (CAST(6 AS BIGINT))) t(field)"),
    "w9_monotone_times": (w9, f"SELECT version, max(at_ms - n) OVER (ORDER BY version) + n AS adjusted FROM (SELECT *, row_number() OVER (ORDER BY version) AS n FROM ({COMMITS}) c) x"),
    "w14_state_from_commits": (w14, f"SELECT path, size FROM ({_LIVE(999999)}) l"),
    "w15_snapshot_steps": (w15, "SELECT snapshot_id, lag(snapshot_id) OVER (ORDER BY at_time) AS previous, lead(snapshot_id) OVER (ORDER BY at_time) AS next FROM {snapshots} s"),
}
