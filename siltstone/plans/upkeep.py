"""Queries of maintenance plans and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import codecs, parsing, transforms
from siltstone.operators import history, merge, planners
from siltstone.plans.fixtures import frame, sql

get = frame
MB = 1 << 20


def files(spark, d):
    return get(spark, d, "small_files")


def bins(pack):
    def run(spark, d):
        out = planners.packed(files(spark, d), ["part"], ["file"], "size", pack)
        return out.groupBy("part", "bin").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))

    return run


def w11_items(spark, d):
    return planners.packed(files(spark, d), ["part"], ["file"], "size", lambda s: planners.one_open_bin(s, 128 * MB)).select("file", "bin")


def l1(spark, d):
    snapshots = get(spark, d, "snapshots")
    chain = history.ancestors(snapshots, 79).join(snapshots, "snapshot_id")
    named = spark.createDataFrame([(10,), (33,)], "snapshot_id long")
    return planners.expire_snapshots(chain, F.expr("TIMESTAMP_NTZ '2000-06-15 00:00:00'"), 5, named)


def l1_out(spark, d):
    return l1(spark, d).select("snapshot_id", "retained")


def l2(spark, d):
    referenced = sql(spark, d, "SELECT p_partkey % 500 AS path, p_partkey % 80 AS snapshot_id FROM {part} x")
    return planners.expired_files(referenced, l1(spark, d))


def l5(spark, d):
    return planners.rewrite_data_files(files(spark, d), 32 * MB).select("part", "files", "bytes")


def l6(spark, d):
    own = sql(spark, d, "SELECT p_partkey AS n, p_partkey * 7340033 AS total FROM {part} x")
    return own.select("n", planners.output_files(F.col("total"), 128 * MB, 96 * MB, 230 * MB).alias("files"))


def l7(spark, d):
    deletes = sql(spark, d, "SELECT p_partkey AS delete_id, CASE WHEN p_partkey % 3 = 0 THEN 'equality' ELSE 'positional' END AS kind, p_partkey % 50 AS part, p_partkey % 8 AS delete_seq FROM {part} x")
    data = sql(spark, d, "SELECT p_partkey % 40 AS part, 1 + (p_partkey % 40) % 7 AS seq FROM {part} x")
    return planners.dangling_deletes(deletes, data)


MANIFESTS = "SELECT p_partkey % 2 AS content, p_partkey AS ord, CAST(p_size AS BIGINT) * 100000 AS size FROM {part} x"


def l8(spark, d):
    return planners.merge_manifests(sql(spark, d, MANIFESTS), 8 * MB)


def l9(spark, d):
    return planners.rewrite_manifests(sql(spark, d, MANIFESTS), 8 * MB)


def l11(spark, d):
    paths = sql(spark, d, "SELECT concat(CASE WHEN p_partkey % 10 = 0 THEN '/other/' ELSE '/warehouse/t/' END, CAST(p_partkey AS VARCHAR(9)), '.parquet') AS path FROM {part} x")
    return planners.rewritten_paths(paths, "/warehouse/t", "/copy/t")


def l12(spark, d):
    return planners.orphans(get(spark, d, "listing"), get(spark, d, "referenced"), 20000).select("path", "size")


def l16(spark, d):
    snapshots = get(spark, d, "snapshots")
    return planners.fast_forward(history.ancestors(snapshots, 40), history.ancestors(snapshots, 60), 40).select("snapshot_id")


def l19(spark, d):
    return planners.splits(files(spark, d), 16 * MB)


def l18(spark, d):
    own = files(spark, d)
    return planners.scan_tasks(planners.splits(own, 16 * MB), own, 64 * MB)


def l20(spark, d):
    rows = [(t, p, planners.split_size(t * MB, p, 128 * MB)) for t in (10, 500, 5000) for p in (1, 8, 200)]
    return spark.createDataFrame(rows, "total_mb long, parallelism long, split_size long")


def l24(spark, d):
    return planners.compactions(get(spark, d, "key_ranges"), ["bucket"])


def l25(spark, d):
    return planners.append_compaction(files(spark, d), 64 * MB)


def l26(spark, d):
    return planners.full_compaction(merge.sections(get(spark, d, "key_ranges"), ["bucket"]).withColumn("section", F.col("section").cast("long")), 5)


EXPIRY = "SELECT p_partkey AS id, p_partkey * 1000 AS at_ms FROM {part} x WHERE p_partkey BETWEEN 100 AND 300"


def l27(spark, d):
    return planners.expire_by_count(sql(spark, d, EXPIRY), 300_000, 60_000, 10, 150, consumer=280).select("id", "expired")


def l28(spark, d):
    return planners.expire_by_count(sql(spark, d, EXPIRY), 300_000, 60_000, 10, 150, limit=20).select("id", "expired")


def l30(spark, d):
    parts = sql(spark, d, "SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS part FROM {orders} x")
    return planners.expire_partitions(parts, parsing.partition_time(F.col("part")), F.expr("TIMESTAMP '2000-01-01 00:00:00'"), "1000 DAYS").select("part")


def l31(spark, d):
    tags = sql(spark, d, "SELECT p_partkey AS tag, p_partkey * 100 AS created_ms, (p_partkey % 7) * 5000 AS retained_ms FROM {part} x")
    return planners.expire_tags(tags, 60_000).select("tag")


def l35(spark, d):
    return planners.rollback(get(spark, d, "snapshots"), 50).select("snapshot_id")


def l37(spark, d):
    missing = history.missing_files(get(spark, d, "referenced"), get(spark, d, "listing"))
    live = sql(spark, d, "SELECT path FROM {referenced} x WHERE snapshot_id = 8")
    return missing.join(live, "path", "left_semi").select("path")


VACUUM = "SELECT concat(CASE p_partkey % 5 WHEN 0 THEN '_delta_log/' WHEN 1 THEN '.tmp/' WHEN 2 THEN '_change_data/' WHEN 3 THEN '_p=1/' ELSE '' END, CAST(p_partkey AS VARCHAR(9))) AS path, p_partkey * 10 AS modified FROM {part} x"


def l38(spark, d):
    kept = sql(spark, d, "SELECT concat('_change_data/', CAST(p_partkey AS VARCHAR(9))) AS path FROM {part} x WHERE p_partkey % 3 = 0")
    return planners.vacuum(sql(spark, d, VACUUM), kept, 15000, ["_p"]).select("path")


def l40(spark, d):
    return planners.optimize(files(spark, d), 64 * MB)


def l41(spark, d):
    return planners.zorder(files(spark, d))


def l42(spark, d):
    own = sql(spark, d, "SELECT file, size, CASE WHEN file % 3 = 0 THEN NULL ELSE file % 50 END AS cube FROM {small_files} x")
    return planners.cluster(own, 900 * MB, 256 * MB)


def l46(spark, d):
    commits = sql(spark, d, "SELECT event_id AS version, event_id * 3600000 - (event_id % 5) * 4000000 AS at_ms FROM {events} x")
    return planners.log_cleanup(commits, 200 * 3600000, 150).select("version")


def l47(spark, d):
    return spark.createDataFrame([(v, planners.next_checkpoint(v)) for v in (0, 9, 10, 25)], "version long, next long")


def l13(spark, d):
    rows = [(1, 5, 5, False, False), (2, 4, 5, False, False), (3, 4, 5, False, True), (4, 5, 5, True, False)]
    return spark.createDataFrame([(n, planners.cherry_pick(p, t, a, b)) for n, p, t, a, b in rows], "n long, verdict string")


# ---- scalars


def i1(spark, d):
    return get(spark, d, "part").select("p_partkey", transforms.bucket(F.col("p_partkey"), 16).cast("long").alias("bucket"))


def i2(spark, d):
    own = sql(spark, d, "SELECT p_partkey - 50 AS n, p_name FROM {part} x")
    return own.select("n", transforms.truncate_number(F.col("n"), 10).cast("long").alias("number"), transforms.truncate_text(F.col("p_name"), 3).alias("text"))


def i3(spark, d):
    t = F.col("o_orderdate")
    return get(spark, d, "orders").select("o_orderkey", *[f(t).cast("long").alias(n) for n, f in (("y", transforms.year), ("m", transforms.month), ("d", transforms.day), ("h", transforms.hour))])


def i5(spark, d):
    own = sql(spark, d, "SELECT p_partkey AS n FROM {part} x").withColumn("n", F.col("n") - 100)
    return own.select("n", *[transforms.human(t, F.col("n")).alias(t) for t in ("year", "month", "day", "hour")])


def i4(spark, d):
    return spark.createDataFrame([(t, transforms.result_type(t, "string")) for t in ("identity", "bucket[8]", "truncate[3]", "year", "month", "day", "hour")], "transform string, type string")


def i13(spark, d):
    return get(spark, d, "part").select("p_partkey", codecs.wang(F.col("p_partkey")).alias("h"))


def i12(spark, d):
    return get(spark, d, "part").select("p_partkey", codecs.xxhash64_column(F.col("p_name")).alias("h"))


def i16(spark, d):
    own = sql(spark, d, "SELECT p_partkey AS n, concat(CASE p_partkey % 3 WHEN 0 THEN 'file:/' WHEN 1 THEN 'file:///' ELSE '/' END, 'w//t/', CAST(p_partkey AS VARCHAR(9))) AS p FROM {part} x")
    return own.select("n", parsing.normal_path(F.col("p")).alias("path"))


def i17(spark, d):
    own = sql(spark, d, "SELECT p_partkey AS n, CASE p_partkey % 3 WHEN 0 THEN concat('v', CAST(p_partkey AS VARCHAR(9)), '.metadata.json') WHEN 1 THEN concat('000', CAST(p_partkey AS VARCHAR(9)), '-ab-cd.gz.metadata.json') ELSE 'other.json' END AS f FROM {part} x")
    return own.select("n", parsing.metadata_version(F.col("f")).cast("long").alias("version"))


def i18(spark, d):
    texts = ["interval 1 week", "interval 2 days 3 hours", "30 minutes", "interval 1 moon"]
    return spark.createDataFrame([(t, parsing.interval_ms(t)) for t in texts], "t string, ms long")


def i19(spark, d):
    own = sql(spark, d, "SELECT p_partkey AS n, concat(CAST(p_partkey AS VARCHAR(9)), CASE p_partkey % 4 WHEN 0 THEN 'kb' WHEN 1 THEN ' mb' WHEN 2 THEN 'G' ELSE '' END) AS t FROM {part} x")
    return own.select("n", parsing.memory_bytes_column(F.col("t")).alias("bytes"))


def i20(spark, d):
    return spark.createDataFrame([(t, parsing.duration_ms(t)) for t in ("1 d", "30 min", "500ms", "7", "2 hours", "x")], "t string, ms long")


def i21(spark, d):
    own = sql(spark, d, "SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS p FROM {orders} x")
    compact = F.replace(F.col("p"), F.lit("-"), F.lit(""))
    return own.select("p", (F.unix_date(parsing.partition_time(compact).cast("date"))).cast("long").alias("day"))


def i22(spark, d):
    return get(spark, d, "orders").select("o_orderkey", F.unix_date(parsing.utc_day(F.col("o_orderdate")).cast("date")).cast("long").alias("day"))


def i28(spark, d):
    own = sql(spark, d, "SELECT p_partkey AS n, p_partkey * p_partkey * p_partkey AS b FROM {part} x")
    return own.filter("b < 1024").select("n", parsing.bytes_text(F.col("b")).alias("text"))


_ONE = "SELECT part, file, CAST(row_number() OVER (PARTITION BY part ORDER BY file) AS BIGINT) AS i, size FROM {small_files} x"

# ---- SQL of sequential packing (a recursion over a group's items) and of the integer hashes


def ordered_sql(source: str, by: str, order: str, size: str, target: int) -> str:
    """(by, rn, size, bin) of items packed in order."""
    return f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn FROM ({source}) s),
        w AS (SELECT o.*, CAST(0 AS BIGINT) AS bin, CAST({size} AS BIGINT) AS held FROM o WHERE rn = 1
        UNION ALL SELECT o.*, CASE WHEN w.held + o.{size} > {target} THEN w.bin + 1 ELSE w.bin END, CASE WHEN w.held + o.{size} > {target} THEN o.{size} ELSE w.held + o.{size} END FROM w JOIN o ON o.{by} = w.{by} AND o.rn = w.rn + 1)"""


def first_fit_sql(source: str, by: str, order: str, size: str, target: int, lookback: int, largest: bool = False) -> str:
    """The same by first fit over a list of open bins."""
    shut = "list_filter({0}, lambda x, i: i <> list_position(open, list_max(open)))" if largest else "{0}[2:]"
    keep = lambda c: f"CASE WHEN len(open) >= {lookback} THEN {shut.format(c)} ELSE {c} END"
    return f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn FROM ({source}) s),
        w AS (SELECT o.*, CAST(0 AS BIGINT) AS bin, [CAST({size} AS BIGINT)] AS open, [CAST(0 AS BIGINT)] AS numbers, CAST(1 AS BIGINT) AS made FROM o WHERE rn = 1
        UNION ALL SELECT * EXCLUDE (spot, open, numbers, made), CASE WHEN spot > 0 THEN numbers[spot] ELSE made END,
            CASE WHEN spot > 0 THEN list_transform(open, lambda x, i: CASE WHEN i = spot THEN x + {size} ELSE x END) ELSE list_append({keep("open")}, {size}) END,
            CASE WHEN spot > 0 THEN numbers ELSE list_append({keep("numbers")}, made) END, CASE WHEN spot > 0 THEN made ELSE made + 1 END
        FROM (SELECT o.*, w.open, w.numbers, w.made, coalesce(list_position(list_transform(w.open, lambda x: x + o.{size} <= {target}), true), 0) AS spot FROM w JOIN o ON o.{by} = w.{by} AND o.rn = w.rn + 1) x)"""


def steps_sql(source: str, *steps: str) -> str:
    """h after one expression over h after the other, in 128-bit integers."""
    for step in steps:
        source = f"SELECT * EXCLUDE (h), CAST({step} AS HUGEINT) AS h FROM ({source}) s"
    return source


#: 2^64 and 2^32.
_W64, _W32 = 1 << 64, 1 << 32
WANG = [
    f"({_W64 - 1}::HUGEINT - h + h * {1 << 21}) % {_W64}::HUGEINT", f"xor(h, h // {1 << 24})", f"(h + h * {1 << 3} + h * {1 << 8}) % {_W64}::HUGEINT", f"xor(h, h // {1 << 14})",
    f"(h + h * {1 << 2} + h * {1 << 4}) % {_W64}::HUGEINT", f"xor(h, h // {1 << 28})", f"(h + h * {1 << 31}) % {_W64}::HUGEINT", f"CASE WHEN h >= {1 << 63}::HUGEINT THEN h - {_W64}::HUGEINT ELSE h END",
]
_TURN = [f"(h * {1 << 13}) % {_W32} + h // {1 << 19}", f"(h * 5 + {0xE6546B64}) % {_W32}"]
#: murmur3 of an integer from 0 to 2^32 - 1 as eight bytes: the high word is zero.
MURMUR = [
    f"(h * {0xCC9E2D51}) % {_W32}", f"(h * {1 << 15}) % {_W32} + h // {1 << 17}", f"(h * {0x1B873593}) % {_W32}", *_TURN, *_TURN, "xor(h, 8::HUGEINT)", f"(xor(h, h // {1 << 16}) * {0x85EBCA6B}) % {_W32}",
    f"(xor(h, h // {1 << 13}) * {0xC2B2AE35}) % {_W32}", f"xor(h, h // {1 << 16}) % {1 << 31}",
]
_KEYS = "SELECT p_partkey, CAST(p_partkey AS HUGEINT) AS h FROM part"
_BINS = "SELECT part, bin, CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM w GROUP BY part, bin"
_SMALL = "SELECT * FROM {small_files} x"
_SPLITS = f"SELECT x.part, x.file, o.k, greatest(least({16 * MB}, x.size - o.k * {16 * MB}), (1 + x.n_deletes) * {4 * MB}) AS weight FROM {{small_files}} x CROSS JOIN range(20) o(k) WHERE o.k * {16 * MB} < x.size"
_CUBES = f"SELECT * FROM (SELECT *, sum(size) OVER (PARTITION BY cube) AS t, 0 AS every FROM (SELECT file, size, CASE WHEN file % 3 = 0 THEN NULL ELSE file % 50 END AS cube FROM {{small_files}} x) y) z WHERE cube IS NULL OR t < {900 * MB}"

QUERIES = {
    "w10_first_fit_lookback": (bins(lambda s: planners.first_fit(s, 128 * MB, 3)), first_fit_sql(_SMALL, "part", "file", "size", 128 * MB, 3) + _BINS),
    "w11_one_open_bin": (w11_items, f"WITH RECURSIVE items AS ({_ONE}), walk(part, i, file, bin, total) AS (SELECT part, i, file, CAST(0 AS BIGINT), size FROM items WHERE i = 1 UNION ALL SELECT n.part, n.i, n.file, CASE WHEN w.total + n.size <= {128 * MB} THEN w.bin ELSE w.bin + 1 END, CASE WHEN w.total + n.size <= {128 * MB} THEN w.total + n.size ELSE n.size END FROM walk w JOIN items n ON n.part = w.part AND n.i = w.i + 1) SELECT file, bin FROM walk"),
    "w12_ordered_packing": (bins(lambda s: planners.ordered(s, 128 * MB)), ordered_sql(_SMALL, "part", "file", "size", 128 * MB) + _BINS),
    "l1_expire_snapshots": (l1_out, "SELECT snapshot_id, (CASE WHEN 79 - snapshot_id < 5 THEN TRUE ELSE at_time >= TIMESTAMP '2000-06-15' END) OR snapshot_id IN (10, 33) AS retained FROM {snapshots} s"),
    "l2_expired_files": (l2, "SELECT DISTINCT path FROM (SELECT p_partkey % 500 AS path, p_partkey % 80 AS snapshot_id FROM part) r WHERE path NOT IN (SELECT p_partkey % 500 FROM part p JOIN {snapshots} s ON s.snapshot_id = p.p_partkey % 80 WHERE 79 - s.snapshot_id < 5 OR s.at_time >= TIMESTAMP '2000-06-15' OR s.snapshot_id IN (10, 33))"),
    "l5_rewrite_data_files": (
        l5,
        f"SELECT part, files, bytes FROM (SELECT part, CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes, bool_or(CAST(removed AS DOUBLE) / rows >= 0.3) AS heavy FROM {{small_files}} f WHERE size < 0.75 * {32 * MB} OR size > 1.8 * {32 * MB} OR CAST(removed AS DOUBLE) / rows >= 0.3 GROUP BY part) g WHERE files >= 5 OR (files > 1 AND bytes > {32 * MB}) OR bytes > 1.8 * {32 * MB} OR heavy",
    ),
    "l6_output_file_count": (l6, f"SELECT n, CAST(CASE WHEN total < {128 * MB} THEN 1 WHEN total % {128 * MB} > {96 * MB} THEN total // {128 * MB} + 1 WHEN CAST(total AS DOUBLE) / greatest(total // {128 * MB}, 1) < least(1.1 * {128 * MB}, {230 * MB}) THEN total // {128 * MB} ELSE total // {128 * MB} + 1 END AS BIGINT) AS files FROM (SELECT p_partkey AS n, p_partkey * 7340033 AS total FROM part) x"),
    "l7_dangling_deletes": (l7, "SELECT delete_id FROM (SELECT p_partkey AS delete_id, p_partkey % 3 = 0 AS eq, p_partkey % 50 AS part, p_partkey % 8 AS s FROM part) d WHERE part >= 40 OR NOT (CASE WHEN eq THEN s > 1 + part % 7 ELSE s >= 1 + part % 7 END)"),
    "l8_manifest_merge": (l8, ordered_sql(MANIFESTS, "content", "ord", "size", 8 * MB) + " SELECT content, bin, CAST(count(*) AS BIGINT) AS manifests, CAST(sum(size) AS BIGINT) AS bytes, count(*) > 1 AND (max(ord) <> max(max(ord)) OVER (PARTITION BY content) OR count(*) >= 100) AS merged FROM w GROUP BY content, bin"),
    "l9_rewrite_manifests": (l9, f"SELECT content, CAST(count(*) AS BIGINT) AS manifests, CAST(ceil(CAST(sum(size) AS DOUBLE) / {8 * MB}) AS BIGINT) AS outputs FROM ({MANIFESTS}) m GROUP BY content"),
    "l11_rewrite_table_path": (l11, "SELECT path, CASE WHEN path LIKE '/warehouse/t/%' THEN '/copy/t/' || substr(path, 14) END AS copy_to, NOT path LIKE '/warehouse/t/%' AS refused FROM (SELECT concat(CASE WHEN p_partkey % 10 = 0 THEN '/other/' ELSE '/warehouse/t/' END, CAST(p_partkey AS VARCHAR), '.parquet') AS path FROM part) x"),
    "l12_orphan_files": (l12, "SELECT path, size FROM {listing} l WHERE modified < 20000 AND path NOT IN (SELECT path FROM {referenced} r)"),
    "l13_cherry_pick": (l13, "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'FAST_FORWARD'), (2, 'PUBLISH'), (3, 'REFUSED'), (4, 'REFUSED')) t(n, verdict)"),
    "l16_fast_forward": (l16, "SELECT snapshot_id FROM {snapshots} s WHERE snapshot_id BETWEEN 41 AND 60"),
    "l18_scan_tasks": (l18, first_fit_sql(_SPLITS, "part", "file, k", "weight", 64 * MB, 10, True) + "SELECT part, bin, CAST(count(*) AS BIGINT) AS splits, CAST(sum(weight) AS BIGINT) AS weight FROM w GROUP BY part, bin"),
    "l19_file_splits": (l19, f"SELECT file, CAST(o * {16 * MB} AS BIGINT) AS \"offset\", CAST(least({16 * MB}, size - o * {16 * MB}) AS BIGINT) AS length FROM {{small_files}} f, range(0, 10) r(o) WHERE o * {16 * MB} < size"),
    "l20_adaptive_split_size": (l20, f"SELECT t AS total_mb, p AS parallelism, CAST(greatest({16 * MB}, least({128 * MB}, ceil(t * {MB} / CAST(p AS DOUBLE)))) AS BIGINT) AS split_size FROM (VALUES (CAST(10 AS BIGINT)), (500), (5000)) a(t), (VALUES (CAST(1 AS BIGINT)), (8), (200)) b(p)"),
    "l24_universal_compaction": (l24, None),
    "l25_append_compaction": (l25, ordered_sql(_SMALL + f" WHERE size < {64 * MB} * 0.7", "part", "file", "size", 128 * MB) + f"SELECT * FROM ({_BINS}) b WHERE files >= 5 OR bytes >= {128 * MB}"),
    "l26_full_compaction": (l26, "SELECT bucket, section, CAST(count(*) AS BIGINT) AS files, CASE WHEN count(*) > 1 THEN 'REWRITE' WHEN max(level) < 5 THEN 'UPGRADE' ELSE 'LEAVE' END AS verdict FROM (SELECT *, CAST(sum(fresh) OVER (PARTITION BY bucket ORDER BY lo, hi, file) AS BIGINT) AS section FROM (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY bucket ORDER BY lo, hi, file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS FALSE THEN 0 ELSE 1 END AS fresh FROM {key_ranges} k) x) y GROUP BY bucket, section"),
    "l27_expire_by_count": (l27, "SELECT p_partkey AS id, p_partkey < 280 AND (p_partkey < 151 OR p_partkey * 1000 <= 240000) AS expired FROM part WHERE p_partkey BETWEEN 100 AND 300"),
    "l28_expire_changelogs": (l28, "SELECT p_partkey AS id, p_partkey < 291 AND p_partkey < 120 AS expired FROM part WHERE p_partkey BETWEEN 100 AND 300"),
    "l30_expire_partitions": (l30, "SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS part FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1997-04-06'"),
    "l31_expire_tags": (l31, "SELECT p_partkey AS tag FROM part WHERE p_partkey * 100 + (p_partkey % 7) * 5000 < 60000"),
    "l35_rollback": (l35, "SELECT snapshot_id FROM {snapshots} s WHERE snapshot_id > 50"),
    "l37_unexisting_files": (l37, "SELECT DISTINCT path FROM {referenced} r WHERE snapshot_id = 8 AND path NOT IN (SELECT path FROM {listing} l)"),
    "l38_vacuum": (l38, f"SELECT path FROM ({VACUUM}) v WHERE modified < 15000 AND NOT path LIKE '\\_delta\\_log/%' ESCAPE '\\' AND NOT path LIKE '.tmp/%' AND path NOT IN (SELECT concat('_change_data/', CAST(p_partkey AS VARCHAR)) FROM part WHERE p_partkey % 3 = 0)"),
    "l40_optimize_compaction": (l40, ordered_sql(_SMALL + f" WHERE size < {64 * MB} OR removed * 20 > rows", "part", "size, file", "size", 64 * MB) + "SELECT part, bin, CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM w GROUP BY part, bin HAVING count(*) > 1 OR bool_or(removed * 20 > rows)"),
    "l41_optimize_zorder": (l41, "SELECT part, CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM {small_files} f GROUP BY part"),
    "l42_optimize_clustering": (l42, ordered_sql(_CUBES, "every", "file", "size", 256 * MB) + "SELECT bin, CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM w GROUP BY bin"),
    "l46_log_cleanup": (l46, "SELECT version FROM (SELECT version, max(at_ms - n) OVER (ORDER BY version) + n AS adjusted FROM (SELECT event_id AS version, event_id * 3600000 - (event_id % 5) * 4000000 AS at_ms, row_number() OVER (ORDER BY event_id) AS n FROM events) x) y WHERE version < 150 AND adjusted <= 691200000"),
    "l47_next_checkpoint": (l47, "SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(10 AS BIGINT)), (9, 10), (10, 20), (25, 30)) t(version, next)"),
    "i1_bucket": (i1, f"SELECT p_partkey, CAST(h % 16 AS BIGINT) AS bucket FROM ({steps_sql(_KEYS, *MURMUR)}) s"),
    "i2_truncate": (i2, "SELECT n, CAST(n - ((n % 10) + 10) % 10 AS BIGINT) AS number, substr(p_name, 1, 3) AS text FROM (SELECT p_partkey - 50 AS n, p_name FROM part) x"),
    "i3_date_transforms": (i3, "SELECT o_orderkey, CAST(year(o_orderdate) - 1970 AS BIGINT) AS y, CAST((year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1 AS BIGINT) AS m, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS d, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 24 + hour(o_orderdate) AS BIGINT) AS h FROM orders"),
    "i4_transform_result_type": (i4, "SELECT * FROM (VALUES ('identity', 'string'), ('bucket[8]', 'int'), ('truncate[3]', 'string'), ('year', 'int'), ('month', 'int'), ('day', 'date'), ('hour', 'int')) t(transform, type)"),
    "i5_partition_text": (i5, "SELECT n, CAST(n + 1970 AS VARCHAR) AS year, strftime(DATE '1970-01-01' + to_months(CAST(n AS INTEGER)), '%Y-%m') AS month, strftime(DATE '1970-01-01' + to_days(CAST(n AS INTEGER)), '%Y-%m-%d') AS day, strftime(TIMESTAMP '1970-01-01' + to_hours(n), '%Y-%m-%d-%H') AS hour FROM (SELECT p_partkey - 100 AS n FROM part) x"),
    "i12_xxhash64": (i12, None),
    "i13_wang_hash": (i13, f"SELECT p_partkey, CAST(h AS BIGINT) AS h FROM ({steps_sql(_KEYS, *WANG)}) s"),
    "i16_normal_path": (i16, "SELECT p_partkey AS n, '/w/t/' || CAST(p_partkey AS VARCHAR) AS path FROM part"),
    "i17_metadata_version": (i17, "SELECT p_partkey AS n, CASE WHEN p_partkey % 3 < 2 THEN p_partkey END AS version FROM part"),
    "i18_interval": (i18, "SELECT * FROM (VALUES ('interval 1 week', CAST(604800000 AS BIGINT)), ('interval 2 days 3 hours', 183600000), ('30 minutes', 1800000), ('interval 1 moon', NULL)) t(t, ms)"),
    "i19_memory_size": (i19, "SELECT p_partkey AS n, CAST(p_partkey * CASE p_partkey % 4 WHEN 0 THEN 1024 WHEN 1 THEN 1048576 WHEN 2 THEN 1073741824 ELSE 1 END AS BIGINT) AS bytes FROM part"),
    "i20_duration": (i20, "SELECT * FROM (VALUES ('1 d', CAST(86400000 AS BIGINT)), ('30 min', 1800000), ('500ms', 500), ('7', 7), ('2 hours', 7200000), ('x', NULL)) t(t, ms)"),
    "i21_partition_time": (i21, "SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS p, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day FROM orders"),
    "i22_utc_day": (i22, "SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day FROM orders"),
    "i28_byte_text": (i28, "SELECT p_partkey AS n, format('{:,} B', p_partkey * p_partkey * p_partkey) AS text FROM part WHERE p_partkey * p_partkey * p_partkey < 1024"),
}
