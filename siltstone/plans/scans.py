"""Queries of scans, filters, pruning, deletes and row fates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import deletes, predicates, pruning
from siltstone.plans.fixtures import frame, text
from siltstone.plans.upkeep import MURMUR, steps_sql

FILTER = "l_shipdate >= DATE '2000-01-01' AND l_quantity < 10"
KINDS = {"l_shipdate": "timestamp_ntz", "l_quantity": "double", "l_partkey": "bigint", "l_orderkey": "bigint"}
STATS = {c: pruning.stats_of(c, k) for c, k in KINDS.items()}
MANIFEST = {"l_shipdate": pruning.stats_of("l_shipdate", "timestamp_ntz")}


def fated(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    get = lambda n: frame(spark, sf_dir, n)
    return deletes.with_fate(get("data_rows") if rows is None else rows, get("vectors"), get("pos_deletes"), get("eq_deletes"), ["l_orderkey"])


FATE = """CASE WHEN EXISTS (SELECT 1 FROM {vectors} v WHERE v.file_id = r.file_id AND v.pos = r.pos) THEN 'VECTOR_DELETED'
  WHEN EXISTS (SELECT 1 FROM {pos_deletes} p WHERE p.file_id = r.file_id AND p.pos = r.pos AND p.delete_seq >= r.seq) THEN 'POSITION_DELETED'
  WHEN EXISTS (SELECT 1 FROM {eq_deletes} e WHERE e.l_orderkey IS NOT DISTINCT FROM r.l_orderkey AND e.delete_seq > r.seq) THEN 'EQUALITY_DELETED' ELSE 'LIVE' END"""
PLAN = """SELECT f.file_id, CASE WHEN NOT m.l_shipdate_max >= TIMESTAMP '2000-01-01' THEN 'NOT_REACHED'
  WHEN NOT (f.l_shipdate_max >= TIMESTAMP '2000-01-01' AND f.l_quantity_min < 10) THEN 'SKIPPED' ELSE 'WOULD_BE_READ' END AS fate
  FROM {file_stats} f JOIN {manifest_stats} m ON f.manifest_id = m.manifest_id"""


def scan_plan(spark: SparkSession, sf_dir: str, where: str = FILTER) -> DataFrame:
    return pruning.scan_plan(frame(spark, sf_dir, "file_stats"), frame(spark, sf_dir, "manifest_stats"), predicates.parse(where), MANIFEST, STATS)


def lookup(spark: SparkSession, sf_dir: str, where: str = FILTER) -> DataFrame:
    """Filter, files left after pruning, matching rows, and each row's fate."""
    kept = scan_plan(spark, sf_dir, where).filter("fate = 'WOULD_BE_READ'").select("file_id")
    rows = frame(spark, sf_dir, "data_rows").filter(predicates.to_column(predicates.parse(where), KINDS)).join(kept, "file_id", "left_semi")
    return fated(spark, sf_dir, rows)


def k1(spark, d):
    return lookup(spark, d).select("file_id", "pos", "l_orderkey", "l_partkey", "fate")


def k2(spark, d):
    return fated(spark, d).groupBy("fate").agg(F.count(F.lit(1)).alias("n"))


def k3(spark, d):
    return fated(spark, d).filter("file_id = 7 AND pos IN (0, 1, 2, 5, 8)").select("pos", "fate")


def k10(spark, d):
    rows = deletes.with_fate(frame(spark, d, "data_rows"), None, None, frame(spark, d, "eq_deletes"), ["l_orderkey"])
    return rows.filter("fate = 'EQUALITY_DELETED'").groupBy("file_id").agg(F.count(F.lit(1)).alias("removed"))


def d6(spark, d):
    rows = frame(spark, d, "data_rows").alias("r")
    own = deletes.position_claims(frame(spark, d, "pos_deletes"))
    return rows.join(own.alias("p"), F.expr("r.file_id = p.file_id AND r.pos = p.pos AND p.delete_seq >= r.seq"), "left_semi").select("file_id", "pos", "l_orderkey")


def d6_live(spark, d):
    rows = frame(spark, d, "data_rows").alias("r")
    return rows.join(deletes.position_claims(frame(spark, d, "pos_deletes")).alias("p"), F.expr("r.file_id = p.file_id AND r.pos = p.pos AND p.delete_seq >= r.seq"), "left_anti").groupBy("file_id").agg(F.count(F.lit(1)).alias("live"))


def d7(spark, d):
    rows, e = frame(spark, d, "data_rows").alias("r"), frame(spark, d, "eq_deletes").alias("e")
    on = F.col("r.l_orderkey").eqNullSafe(F.col("e.l_orderkey")) & (F.col("e.delete_seq") > F.col("r.seq"))
    return rows.join(e, on, "left_semi").select("file_id", "pos", "l_orderkey")


def d8(spark, d):
    return frame(spark, d, "pos_deletes").filter("file_id = 3 AND pos < 40").groupBy("file_id").agg(F.count(F.lit(1)).alias("marked"))


def d9(spark, d):
    probe = spark.createDataFrame([(13,), (14,), (None,)], "l_orderkey long")
    e = frame(spark, d, "eq_deletes").select(F.col("l_orderkey").alias("e_key")).distinct()
    return probe.join(e, probe.l_orderkey.eqNullSafe(e.e_key), "left_semi").select(F.coalesce("l_orderkey", F.lit(-1)).alias("l_orderkey"))


def d10(spark, d):
    return frame(spark, d, "data_rows").join(frame(spark, d, "vectors"), ["file_id", "pos"], "left_anti").groupBy("file_id").agg(F.count(F.lit(1)).alias("live"))


REACH_DATA = "SELECT file_id, seq, file_id % 3 AS part, l_orderkey_min AS k_min, l_orderkey_max AS k_max, CAST(0 AS BIGINT) AS k_nulls FROM {file_stats} x"
REACH_DELETES = """SELECT n AS delete_id, CASE WHEN n % 3 = 0 THEN 'equality' ELSE 'positional' END AS kind, n % 6 AS delete_seq, CASE WHEN n % 10 = 0 THEN NULL ELSE n % 3 END AS part,
  CASE WHEN n % 3 = 1 THEN n % 40 ELSE NULL END AS target, n * 40 AS k_min, n * 40 + 30 AS k_max, CAST(0 AS BIGINT) AS k_nulls FROM (SELECT p_partkey AS n FROM {part}) y"""


def d1(spark, d):
    from siltstone.plans.fixtures import sql

    pairs = deletes.reach(sql(spark, d, REACH_DATA), sql(spark, d, REACH_DELETES))
    return pairs.select("file_id", "delete_id", "verdict")


def d4(spark, d):
    return d1(spark, d).filter("file_id = 12").select("delete_id", "verdict")


REACH_SQL = f"""SELECT a.file_id, d.delete_id, CASE
  WHEN NOT (CASE WHEN kind = 'equality' THEN d.delete_seq > a.seq ELSE d.delete_seq >= a.seq END) THEN 'RULED_OUT_BY_SEQUENCE'
  WHEN d.target IS NOT NULL AND d.target <> a.file_id THEN 'RULED_OUT_BY_TARGET'
  WHEN kind = 'equality' AND NOT (a.k_max >= d.k_min AND a.k_min <= d.k_max) THEN 'RULED_OUT_BY_BOUNDS'
  WHEN d.target IS NOT NULL THEN 'REACHES' ELSE 'MAY_REACH' END AS verdict
  FROM ({REACH_DATA}) a JOIN ({REACH_DELETES}) d ON d.part IS NULL OR d.part = a.part"""


def a16(spark, d):
    return deletes.targets(frame(spark, d, "pos_deletes"))


def e10(spark, d):
    return deletes.live_counts(frame(spark, d, "file_stats"), frame(spark, d, "vectors"), frame(spark, d, "pos_deletes"))


def e11(spark, d):
    both = frame(spark, d, "pos_deletes").select("file_id", "pos").unionAll(frame(spark, d, "vectors").select("file_id", "pos"))
    return both.groupBy("file_id").agg(F.count_distinct("pos").alias("positions"))


def filtered(where: str):
    def run(spark, d):
        rows = frame(spark, d, "data_rows").filter(predicates.to_column(predicates.parse(where), KINDS))
        return rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))

    return run


def pruned_equals_unpruned(where: str):
    """Files that hold a match but would be skipped: a sound plan has none."""

    def run(spark, d):
        f = predicates.parse(where)
        plan = frame(spark, d, "file_stats").select("file_id", pruning.skips(f, STATS).alias("skipped"))
        hits = frame(spark, d, "data_rows").filter(predicates.to_column(f, KINDS)).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
        joined = plan.join(hits, "file_id", "left")
        return joined.agg(F.count_if(F.col("skipped")).alias("skipped"), F.count_if(F.col("skipped") & F.col("n").isNotNull()).alias("wrongly"))

    return run


def c15(spark, d):
    return frame(spark, d, "manifest_stats").select("manifest_id", pruning.skips(predicates.parse(FILTER), MANIFEST).alias("skipped"), pruning.outcomes(predicates.parse(FILTER), MANIFEST)[1].effect.alias("second"))


def c16(spark, d):
    """A literal crosses the month transform to the partition's ordinal; monotone, not injective: >= keeps the literal's month."""
    from siltstone.functions import transforms

    ordinal = transforms.month(F.lit("2000-01-17").cast("date"))
    files = frame(spark, d, "file_stats").withColumn("month", transforms.month(F.col("l_shipdate_min")))
    return files.select("file_id", F.col("month").cast("long").alias("month"), (F.col("month") < ordinal).alias("skipped"))


def c19(spark, d):
    return frame(spark, d, "file_stats").select("file_id", pruning.skips(predicates.parse(FILTER), STATS).alias("skipped"))


def c20(spark, d):
    f = predicates.parse("l_partkey IS NULL OR l_partkey = 100")
    return frame(spark, d, "file_stats").select("file_id", pruning.skips(f, STATS).alias("skipped"))


def c21(spark, d):
    return scan_plan(spark, d).select("file_id", "fate")


def c22(spark, d):
    return pruning.ruled_out(scan_plan(spark, d)).select("file_id")


def c23(spark, d):
    return pruning.prunable_columns({"manifest": frame(spark, d, "manifest_stats"), "file": frame(spark, d, "file_stats")})


def c18(spark, d):
    names = frame(spark, d, "part").select((F.col("p_partkey") % 50).alias("file_id"), "p_name")
    stats = pruning.column_statistics(names, ["file_id"], ["p_name"])
    f = predicates.parse("p_name LIKE 'part 1%'")
    out = stats.select("file_id", pruning.skips(f, {"p_name": pruning.stats_of("p_name", "string")}).alias("skipped"), "p_name_min", "p_name_max")
    return out.select("file_id", "skipped")


def c17(spark, d):
    from siltstone.functions import transforms

    want = transforms.bucket_of(1234, 16)
    files = frame(spark, d, "part").withColumn("b", transforms.bucket(F.col("p_partkey"), 16)).groupBy((F.col("p_partkey") % 97).alias("file_id")).agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    return files.select("file_id", ((F.lit(want) < F.col("lo")) | (F.lit(want) > F.col("hi"))).alias("skipped"))


def c27(spark, d):
    null = frame(spark, d, "file_stats").select("file_id", "rows", F.lit(None).cast("string").alias("x_min"), F.lit(None).cast("string").alias("x_max"), F.when(F.col("file_id") % 2 == 0, F.col("rows")).otherwise(0).alias("x_nulls"))
    f, stats = predicates.parse("x <> 'a'"), {"x": pruning.stats_of("x", "string")}
    return null.select("file_id", pruning.skips(f, stats).alias("one_format"), pruning.skips(f, stats, all_null_negation=True).alias("other_format"))


def e16(spark, d):
    return pruning.column_statistics(frame(spark, d, "data_rows"), ["file_id"], ["l_quantity", "l_partkey"])


def e17(spark, d):
    wide = frame(spark, d, "file_stats")
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}_min").cast("double").alias("least"), F.col(f"{c}_max").cast("double").alias("greatest"), F.col(f"{c}_nulls").alias("nulls")) for c in ("l_quantity", "l_partkey", "l_orderkey")])
    return wide.select("file_id", F.explode(cells).alias("cell")).select("file_id", "cell.*")


def u2(spark, d):
    old = frame(spark, d, "vectors").select("file_id", "pos")
    new = frame(spark, d, "pos_deletes").select("file_id", "pos").distinct()
    return new.exceptAll(old).withColumn("change", F.lit("deleted")).unionAll(old.exceptAll(new).withColumn("change", F.lit("restored"))).groupBy("file_id", "change").agg(F.count(F.lit(1)).alias("n"))


def a11(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "_metadata.row_index", "_metadata.file_name")
    return rows.filter("row_index < 1000").select("o_orderkey", "row_index")


def a12(spark, d):
    """The first rows of a data file with their positions; the limit is the feature."""
    rows = spark.read.parquet(f"{d}/nation.parquet").select("*", "_metadata.row_index")
    return rows.orderBy("row_index").limit(20)


def g3(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("file_id").orderBy("pos")
    hits = frame(spark, d, "data_rows").filter(predicates.to_column(predicates.parse(FILTER), KINDS)).withColumn("k", F.row_number().over(w))
    return hits.filter("k <= 20").select("file_id", "pos")


def g6(spark, d):
    return a16(spark, d).orderBy(F.desc("n"), "file_id").limit(10)


def g8(spark, d):
    return frame(spark, d, "data_rows").filter("file_id = 5").orderBy("pos").limit(100).select("pos", "l_orderkey")


WHERE = {
    "c2_in": "l_partkey IN (1, 5, 9, 200, 17)",
    "c3_between": "l_quantity BETWEEN 5 AND 7.5",
    "c4_like": "l_returnflag LIKE 'N%' AND NOT l_linestatus LIKE 'F%'",
    "c5_operators": "l_quantity <> 3 AND l_partkey >= 50 AND l_orderkey IS NOT NULL",
    "c7_negation": "NOT (l_quantity < 10 OR NOT l_partkey > 100)",
    "c9_exact_rows": "(l_quantity < 4 OR l_quantity > 47) AND l_returnflag = 'R'",
    "c11_typed_literals": "l_shipdate < TIMESTAMP '1996-05-05 00:00:00' AND l_partkey = '77'",
}
_count = lambda where: f"SELECT file_id, CAST(count(*) AS BIGINT) AS n FROM {{data_rows}} r WHERE {where} GROUP BY file_id"
_wrong = lambda where, skip: f"SELECT CAST(count(*) FILTER (WHERE {skip}) AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS wrongly FROM {{file_stats}} f"

#: The keys, and the value that is looked for under key -1.
_BUCKETED = "SELECT p_partkey, CAST(p_partkey AS HUGEINT) AS h FROM part UNION ALL SELECT -1, 1234"

QUERIES = {
    "a11_data_file_scan": (a11, "SELECT o_orderkey, file_row_number AS row_index FROM (SELECT o_orderkey, row_number() OVER () - 1 AS file_row_number FROM orders) WHERE file_row_number < 1000"),
    "a12_sample_rows": (a12, "SELECT *, row_number() OVER () - 1 AS row_index FROM nation LIMIT 20"),
    "a16_position_delete_targets": (a16, "SELECT file_id, CAST(count(*) AS BIGINT) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM {pos_deletes} x GROUP BY file_id"),
    "c15_manifest_pruning": (c15, "SELECT manifest_id, l_shipdate_max < TIMESTAMP '2000-01-01' AS skipped, 'NOT_EVALUATED' AS second FROM {manifest_stats} x"),
    "c16_transform_term": (c16, "SELECT file_id, CAST((year(l_shipdate_min) - 1970) * 12 + month(l_shipdate_min) - 1 AS BIGINT) AS month, (year(l_shipdate_min) - 1970) * 12 + month(l_shipdate_min) - 1 < 360 AS skipped FROM {file_stats} x"),
    "c17_bucket_term": (c17, f"WITH b AS (SELECT p_partkey, CAST(h % 16 AS BIGINT) AS b FROM ({steps_sql(_BUCKETED, *MURMUR)}) s) SELECT p_partkey % 97 AS file_id, min(b) > any_value(want) OR max(b) < any_value(want) AS skipped FROM b CROSS JOIN (SELECT b AS want FROM b WHERE p_partkey = -1) t WHERE p_partkey > 0 GROUP BY 1"),
    "c18_like_prefix_term": (c18, "SELECT p_partkey % 50 AS file_id, NOT (left(max(p_name), 6) >= 'part 1' AND left(min(p_name), 6) <= 'part 1') AS skipped FROM part GROUP BY 1"),
    "c19_file_pruning": (c19, "SELECT file_id, NOT (l_shipdate_max >= TIMESTAMP '2000-01-01' AND l_quantity_min < 10) AS skipped FROM {file_stats} x"),
    "c20_column_term": (c20, "SELECT file_id, l_partkey_nulls = 0 AND (l_partkey_min > 100 OR l_partkey_max < 100) AS skipped FROM {file_stats} x"),
    "c21_two_stage_scan_plan": (c21, PLAN),
    "c22_ruled_out_files": (c22, f"SELECT file_id FROM ({PLAN}) p WHERE fate <> 'WOULD_BE_READ'"),
    "c23_prunable_columns": (c23, "SELECT * FROM (VALUES ('l_shipdate', 'file,manifest'), ('l_quantity', 'file'), ('l_partkey', 'file'), ('l_orderkey', 'file')) t(column_name, stages)"),
    "c27_all_null_negation": (c27, "SELECT file_id, FALSE AS one_format, file_id % 2 = 0 AS other_format FROM {file_stats} x"),
    **{name: (filtered(where), _count(where if name != "c11_typed_literals" else "l_shipdate < TIMESTAMP '1996-05-05' AND l_partkey = 77")) for name, where in WHERE.items()},
    "c8_sound_verdict": (pruned_equals_unpruned(FILTER), _wrong(FILTER, "NOT (l_shipdate_max >= TIMESTAMP '2000-01-01' AND l_quantity_min < 10)")),
    "c8_sound_verdict_or": (pruned_equals_unpruned("l_partkey < 2 OR l_shipdate < DATE '1995-06-01'"), _wrong("", "l_partkey_min >= 2 AND l_shipdate_min >= TIMESTAMP '1995-06-01'")),
    "d1_delete_reach": (d1, REACH_SQL),
    "d4_deletes_of_a_file": (d4, f"SELECT delete_id, verdict FROM ({REACH_SQL}) x WHERE file_id = 12"),
    "d6_position_delete_semi_join": (d6, "SELECT file_id, pos, l_orderkey FROM {data_rows} r WHERE EXISTS (SELECT 1 FROM {pos_deletes} p WHERE p.file_id = r.file_id AND p.pos = r.pos AND p.delete_seq >= r.seq)"),
    "d6_live_rows": (d6_live, "SELECT file_id, CAST(count(*) AS BIGINT) AS live FROM {data_rows} r WHERE NOT EXISTS (SELECT 1 FROM {pos_deletes} p WHERE p.file_id = r.file_id AND p.pos = r.pos AND p.delete_seq >= r.seq) GROUP BY file_id"),
    "d7_equality_delete_semi_join": (d7, "SELECT file_id, pos, l_orderkey FROM {data_rows} r WHERE EXISTS (SELECT 1 FROM {eq_deletes} e WHERE e.l_orderkey IS NOT DISTINCT FROM r.l_orderkey AND e.delete_seq > r.seq)"),
    "d8_position_probe": (d8, "SELECT file_id, CAST(count(*) AS BIGINT) AS marked FROM {pos_deletes} x WHERE file_id = 3 AND pos < 40 GROUP BY file_id"),
    "d9_equality_probe": (d9, "SELECT CAST(coalesce(k, -1) AS BIGINT) AS l_orderkey FROM (VALUES (13), (14), (NULL)) t(k) WHERE EXISTS (SELECT 1 FROM {eq_deletes} e WHERE e.l_orderkey IS NOT DISTINCT FROM t.k)"),
    "d10_deletion_vector_anti_join": (d10, "SELECT file_id, CAST(count(*) AS BIGINT) AS live FROM {data_rows} r WHERE NOT EXISTS (SELECT 1 FROM {vectors} v WHERE v.file_id = r.file_id AND v.pos = r.pos) GROUP BY file_id"),
    "e10_live_row_count": (
        e10,
        "SELECT f.file_id, f.rows, CAST(coalesce(n, 0) AS BIGINT) AS removed, CAST(f.rows - coalesce(n, 0) AS BIGINT) AS live FROM {file_stats} f LEFT JOIN (SELECT file_id, count(DISTINCT pos) AS n FROM (SELECT p.file_id, p.pos FROM {pos_deletes} p JOIN {file_stats} g ON p.file_id = g.file_id WHERE p.delete_seq >= g.seq UNION ALL SELECT file_id, pos FROM {vectors} v) u GROUP BY file_id) c ON f.file_id = c.file_id",
    ),
    "e11_distinct_positions": (e11, "SELECT file_id, CAST(count(DISTINCT pos) AS BIGINT) AS positions FROM (SELECT file_id, pos FROM {pos_deletes} p UNION ALL SELECT file_id, pos FROM {vectors} v) u GROUP BY file_id"),
    "e16_column_statistics": (
        e16,
        "SELECT file_id, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE isnan(l_quantity)) AS BIGINT) AS l_quantity_nans, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max, CAST(count(*) FILTER (WHERE l_quantity IS NULL) AS BIGINT) AS l_quantity_nulls, min(l_partkey) AS l_partkey_min, max(l_partkey) AS l_partkey_max, CAST(count(*) FILTER (WHERE l_partkey IS NULL) AS BIGINT) AS l_partkey_nulls FROM {data_rows} x GROUP BY file_id",
    ),
    "e17_column_stats_pivot": (e17, " UNION ALL ".join(f"SELECT file_id, '{c}' AS column_name, CAST({c}_min AS DOUBLE) AS least, CAST({c}_max AS DOUBLE) AS greatest, {c}_nulls AS nulls FROM {{file_stats}} x" for c in ("l_quantity", "l_partkey", "l_orderkey"))),
    "g3_hit_cap_per_file": (g3, f"SELECT file_id, pos FROM (SELECT file_id, pos, row_number() OVER (PARTITION BY file_id ORDER BY pos) AS k FROM {{data_rows}} r WHERE {FILTER}) x WHERE k <= 20"),
    "g6_top_targets": (g6, "SELECT file_id, CAST(count(*) AS BIGINT) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM {pos_deletes} x GROUP BY file_id ORDER BY n DESC, file_id LIMIT 10"),
    "g8_ordered_record_read": (g8, "SELECT pos, l_orderkey FROM {data_rows} r WHERE file_id = 5 ORDER BY pos LIMIT 100"),
    "k1_row_lookup": (k1, f"SELECT file_id, pos, l_orderkey, l_partkey, {FATE} AS fate FROM {{data_rows}} r WHERE {FILTER}"),
    "k2_row_fate": (k2, f"SELECT fate, CAST(count(*) AS BIGINT) AS n FROM (SELECT {FATE} AS fate FROM {{data_rows}} r) x GROUP BY fate"),
    "k3_single_row_fate": (k3, f"SELECT pos, {FATE} AS fate FROM {{data_rows}} r WHERE file_id = 7 AND pos IN (0, 1, 2, 5, 8)"),
    "k10_equality_delete_effect": (k10, "SELECT file_id, CAST(count(*) AS BIGINT) AS removed FROM {data_rows} r WHERE EXISTS (SELECT 1 FROM {eq_deletes} e WHERE e.l_orderkey IS NOT DISTINCT FROM r.l_orderkey AND e.delete_seq > r.seq) GROUP BY file_id"),
    "u2_position_set_difference": (
        u2,
        "SELECT file_id, change, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'deleted' AS change, file_id, pos FROM (SELECT DISTINCT file_id, pos FROM {pos_deletes} p EXCEPT SELECT file_id, pos FROM {vectors} v) a UNION ALL SELECT 'restored', file_id, pos FROM (SELECT file_id, pos FROM {vectors} v EXCEPT SELECT file_id, pos FROM {pos_deletes} p) b) u GROUP BY file_id, change",
    ),
}
