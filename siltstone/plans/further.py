"""Further queries: bindings, adapters, keyed-table plans, codecs, histories."""

from __future__ import annotations

import datetime
import struct
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import binary_row, codecs, transforms
from siltstone.operators import checks, deletes, history, merge, planners, predicates, pruning, replay
from siltstone.plans.fixtures import frame, sql
from siltstone.plans.upkeep import ordered_sql
from siltstone.plans.scans import FILTER, KINDS, STATS
from siltstone.sources import iceberg

get = frame
MB = 1 << 20


def b3(spark, d):
    out = iceberg.place({"a": 1, "b": None, "c": None}, {"b": 2})
    return spark.createDataFrame([(k, v) for k, v in out.items()], "id long, column_name string")


def b4(spark, d):
    out = iceberg.name_mapping('[{"names": ["s", "old_s"], "field-id": 1, "fields": [{"names": ["x"], "field-id": 2}]}]')
    return spark.createDataFrame(sorted(out.items()), "name string, id long")


def b7(spark, d):
    """Columns read by their physical names, as a mapped table stores them."""
    mapping = {"n_nationkey": "col-1", "n_name": "col-2"}
    stored = get(spark, d, "nation").select(*[F.col(a).alias(b) for a, b in mapping.items()])
    return stored.select(*[F.col(f"`{b}`").alias(a) for a, b in mapping.items()])


def b8(spark, d):
    columns = [("_KEY_k", "INT"), ("_SEQUENCE_NUMBER", "BIGINT"), ("_VALUE_KIND", "TINYINT"), ("k", "INT"), ("v", "STRING")]
    return spark.createDataFrame(columns, "name string, type string")


def b9(spark, d):
    """A file written under an older schema, its columns placed by the ids of that schema."""
    old, new = {"k": 0, "w": 1}, [(0, "key", "bigint", None), (1, "value", "string", None), (2, "extra", "int", None)]
    rows = get(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("w"))
    return rows.select(*iceberg.project(old, new))


def c1(spark, d):
    def at(t):
        try:
            predicates.parse(t)
            return -1
        except predicates.FilterError as e:
            return e.offset

    return spark.createDataFrame([(t, at(t)) for t in ("a = 1", "a =", "a = 1 AND", "a ? 1", "a IN 1")], "t string, at long")


def c6(spark, d):
    f = predicates.parse("NOT (a = 1 AND (b = 2 OR NOT c < 3))")
    return spark.createDataFrame([(t.column, t.op) for t in predicates.terms(predicates.push_negation(f))], "column_name string, op string")


def c13(spark, d):
    cells = [(1, 1.5), (2, Decimal("2.0")), ("b", "a"), (True, 1), (datetime.date(2020, 1, 2), datetime.datetime(2020, 1, 1, 12))]
    return spark.createDataFrame([(k, predicates.compare_values(a, b)) for k, (a, b) in enumerate(cells)], "k long, result long")


def c14(spark, d):
    schema, columns = {"id": 1, "name": 2}, {"legacy"}
    bind = lambda c: ("FIELD", schema[c]) if c in schema else ("NAME", None) if c in columns else ("UNKNOWN", None)
    return spark.createDataFrame([(c, *bind(c)) for c in ("id", "legacy", "zzz")], "column_name string, how string, id long")


def c24(spark, d):
    modes = checks.metrics_mode(["l_shipdate", "l_comment"], {"write.metadata.metrics.column.l_comment": "none"})
    rows = [(t.column, "evaluated" if t.column in STATS else f"metrics mode {modes.get(t.column, 'unknown')}") for t in predicates.terms(predicates.parse("l_shipdate > DATE '2000-01-01' AND l_comment = 'x'"))]
    return spark.createDataFrame(rows, "column_name string, why string")


def c26(spark, d):
    f = predicates.parse("k = 1 AND v = 2 AND (k = 3 OR v = 4) AND k2 > 5")
    own = [t for t in f.parts if isinstance(t, predicates.Term) and t.column in ("k", "k2")]
    return spark.createDataFrame([(t.column, t.op, t.value) for t in own], "column_name string, op string, value string")


def c29(spark, d):
    files = sql(spark, d, "SELECT file, lo, hi, bytes, level, file % 2 AS deleted, bucket FROM {key_ranges} x")
    w = Window.partitionBy("bucket", F.floor(F.col("file") / 40))
    raw = (F.min("level").over(w) > 0) & (F.max("deleted").over(w) == 0) & (F.size(F.collect_set("level").over(w)) == 1)
    return files.select("file", raw.alias("raw"))


def c30(spark, d):
    """Index answers folded over a filter: And intersects row sets, Or unites them."""
    import pandas as pd

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        index = {"l_partkey": codecs.BitSliced([int(v) for v in group.l_partkey]), "l_returnflag": codecs.Bitmaps(group.l_returnflag.tolist())}
        f = predicates.parse("l_partkey < 500 AND (l_returnflag = 'R' OR l_partkey > 400)")
        rows = codecs.fold_rows(f, lambda t: index[t.column].rows(t.op, int(t.value) if t.kind == "number" else t.value))
        return pd.DataFrame({"file_id": [group.file_id.iloc[0]], "n": [len(rows)]})

    return get(spark, d, "data_rows").select("file_id", "pos", "l_partkey", "l_returnflag").groupBy("file_id").applyInPandas(run, "file_id long, n long")


def c41(spark, d):
    own = get(spark, d, "file_stats").groupBy("manifest_id").agg(F.min("l_orderkey_min").alias("lo"), F.max("l_orderkey_max").alias("hi"))

    @F.pandas_udf("long")
    def round_trip(values):
        return values.map(lambda v: codecs.single_value(struct.pack("<q", int(v)), "long"))

    return own.select("manifest_id", round_trip("lo").alias("lo"), round_trip("hi").alias("hi"))


def c43(spark, d):
    """A column that a file's older schema lacks is all null there, so a comparison skips the file."""
    files = get(spark, d, "file_stats").select("file_id", "rows", F.lit(None).cast("bigint").alias("x_min"), F.lit(None).cast("bigint").alias("x_max"), F.when(F.col("file_id") < 40, F.col("rows")).otherwise(F.lit(None)).alias("x_nulls"))
    return files.select("file_id", pruning.skips(predicates.parse("x = 7"), {"x": pruning.stats_of("x", "bigint")}).alias("skipped"))


def c45(spark, d):
    return get(spark, d, "file_stats").select("file_id", pruning.skips(predicates.parse(FILTER), {}).alias("skipped"))


def c46(spark, d):
    rules = [({}, "bucket"), ({"merge-engine": "first-row"}, "skips level 0"), ({"merge-engine": "aggregation"}, "never by value")]
    name = lambda r: "skips level 0" if r.skips_level_0 else "never by value" if r.keep == "COMBINED" else "bucket"
    return spark.createDataFrame([(want, name(merge.merge_rule(o))) for o, want in rules], "want string, rule string")


def d3(spark, d):
    a = get(spark, d, "file_stats").filter("file_id < 20").select("file_id", "l_partkey_min", "l_partkey_max")
    probe = sql(spark, d, "SELECT p_partkey AS n, p_partkey * 3 AS lo, p_partkey * 3 + 2 AS hi FROM {part} x WHERE p_partkey < 15")
    return a.join(probe, F.expr("l_partkey_max >= lo AND l_partkey_min <= hi")).select("file_id", "n")


def d5(spark, d):
    own = get(spark, d, "pos_deletes").groupBy(F.col("pos") % 7).agg(F.min("file_id").alias("lo"), F.max("file_id").alias("hi"), F.count(F.lit(1)).alias("n"))
    return own.select("lo", "hi", "n", (F.col("lo") == F.col("hi")).alias("single"))


def d13(spark, d):
    live = get(spark, d, "file_stats").filter("file_id % 2 = 0").select("file_id")
    return get(spark, d, "pos_deletes").withColumn("live", F.lit(1)).join(live, "file_id", "left_semi").groupBy("file_id").agg(F.count(F.lit(1)).alias("kept"))


def d18(spark, d):
    a = replay.live_at(get(spark, d, "actions"), 8).select("path", "size")
    b = replay.live_at(get(spark, d, "actions"), 7).select("path", "size")
    sides = replay.diff(a, b, "path", "size")
    return sides.agg(F.count_if(F.col("side") == "ONLY_IN_FROM").alias("table_only"), F.count_if(F.col("side") == "ONLY_IN_TO").alias("export_only"), (F.count_if(F.col("side") != "IN_BOTH") == 0).alias("current"))


def d19(spark, d):
    files = get(spark, d, "key_ranges").select(F.col("file").alias("path"), "level")
    export = sql(spark, d, "SELECT p_partkey AS exported FROM {part} x WHERE p_partkey % 6 = 5 AND p_partkey % 10 <> 5")
    fate = F.when(F.col("exported").isNotNull(), "EXPORTED").when(F.col("level") < 5, "BELOW_TOP_LEVEL").otherwise("MISSING")
    return files.join(export, F.col("path") == F.col("exported"), "left").groupBy(fate.alias("fate")).agg(F.count(F.lit(1)).alias("n"))


def e3(spark, d):
    own = get(spark, d, "file_stats")
    return own.agg(F.count(F.lit(1)).alias("files"), F.count_distinct("manifest_id").alias("manifests"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


def e23(spark, d):
    return get(spark, d, "key_ranges").groupBy("bucket").agg(F.min("level").alias("least_level"), F.max("level").alias("top_level"), F.min("file").alias("first_file"), F.max("file").alias("last_file"))


def e30(spark, d):
    own = sql(spark, d, "SELECT bucket, k AS file, s AS ord, CASE WHEN kind IN (1, 3) THEN 1 ELSE 0 END AS kind FROM {lsm_records} x")
    last = own.groupBy("bucket", "file").agg(F.max_by("kind", "ord").alias("kind"))
    return last.filter("kind = 0").groupBy("bucket").agg(F.count(F.lit(1)).alias("files"))


def e31(spark, d):
    own = get(spark, d, "small_files")
    return own.agg(F.sum(F.when(F.col("n_deletes") == 1, F.col("rows"))).alias("patch_rows"), F.sum(F.when(F.col("n_deletes") != 1, F.col("rows"))).alias("rows"))


def g4(spark, d):
    pages = get(spark, d, "file_stats").withColumn("page", F.floor((F.row_number().over(Window.orderBy("file_id")) - 1) / 16))
    return pages.groupBy("page").agg(F.count(F.lit(1)).alias("files"), F.min("file_id").alias("first"))


def g2(spark, d):
    w = Window.partitionBy("manifest_id").orderBy(F.desc("rows"), "file_id")
    return get(spark, d, "file_stats").select("manifest_id", "file_id", F.row_number().over(w).cast("long").alias("place"))


def i6(spark, d):
    cells = [(struct.pack("<i", 7), "int", "7"), (struct.pack("<i", 7), "long", "7"), (struct.pack("<q", -1), "long", "-1"), (b"ab", "string", "ab"), (b"\x05\x8c", "decimal(9, 2)", "14.20"), (struct.pack("<i", 1), "date", "1970-01-02"), (struct.pack("<d", 1.5), "double", "1.5")]
    return spark.createDataFrame([(k, str(codecs.single_value(b, kind))) for k, (b, kind, _) in enumerate(cells)], "k long, value string")


def i8(spark, d):
    spec = [("region", "identity", "int"), ("month", "month", "int")]
    raw = {"region": 3, "month": 359}
    rows = [(name, raw[name], transform) for name, transform, _ in spec]
    out = spark.createDataFrame(rows, "name string, v long, transform string")
    return out.select("name", F.when(F.col("transform") == "month", transforms.human("month", F.col("v"))).otherwise(F.col("v").cast("string")).alias("text"))


def i9(spark, d):
    kinds = ["STRING", "DATE", "INT NOT NULL", "STRING"]
    rows = [["eu", datetime.date(2024, 1, 2), 5, None], ["north-america", None, -1, "x"]]
    out = [binary_row.partition_path(binary_row.decode(binary_row.encode(r, kinds), kinds), ["a", "b", "c", "e"]) for r in rows]
    return spark.createDataFrame([(p,) for p in out], "path string")


def i10(spark, d):
    kinds = ["BIGINT", "STRING"]
    out = binary_row.bounds(binary_row.encode([1, "a"], kinds), binary_row.encode([9, "a much longer bound"], kinds), [0, 3], ["k", "v"], kinds)
    return spark.createDataFrame([(n, str(a), str(b), c) for n, a, b, c in out], "name string, least string, greatest string, nulls long")


def i11(spark, d):
    rows = get(spark, d, "nation").select("n_nationkey", codecs.wang(F.col("n_nationkey")).alias("number_hash"), codecs.xxhash64_column(F.col("n_name")).alias("text_hash"))
    return rows


def i14(spark, d):
    t = F.col("o_orderdate").cast("timestamp")
    return get(spark, d, "orders").select("o_orderkey", F.unix_millis(t).alias("ms"), F.unix_micros(t).alias("us"))


def i15(spark, d):
    t = F.col("o_orderdate").cast("date")
    return get(spark, d, "orders").select("o_orderkey", F.unix_date(t).cast("long").alias("day"), (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("long").alias("unscaled"))


def i23(spark, d):
    rows = get(spark, d, "file_stats").select("file_id", F.to_json(F.struct(F.col("rows").alias("numRecords"))).alias("stats"))
    return rows.select("file_id", F.from_json("stats", "numRecords bigint").numRecords.alias("rows"))


def i26(spark, d):
    schema = {"fields": [{"id": 1, "name": "m", "type": {"type": "map", "key-id": 2, "key": "string", "value-id": 3, "value": {"type": "struct", "fields": [{"id": 4, "name": "x", "type": "int"}]}}}]}
    return spark.createDataFrame([(p, k, t) for p, k, t, _ in iceberg.field_rows(schema)], "path string, id long, type string")


def i27(spark, d):
    kinds = spark.createDataFrame([(c,) for c in ("insert", "update_preimage", "update_postimage", "delete", "other")], "c string")
    return kinds.select("c", replay.change_kind(F.col("c")).cast("long").alias("kind"))


def j3(spark, d):
    own = get(spark, d, "lsm_records").select((F.col("s") % 50).alias("snapshot"), "kind", "s")
    return own.groupBy("snapshot").agg(F.count(F.lit(1)).alias("records"), F.min("s").alias("first")).filter("snapshot < 20")


def j7(spark, d):
    cells = [({}, False), ({"changelog.time-retained": "1 d"}, True), ({"changelog.num-retained.max": "3", "snapshot.num-retained.max": "3"}, True)]
    return spark.createDataFrame([(k, any(o.startswith("changelog.") for o in options)) for k, (options, _) in enumerate(cells)], "k long, decoupled boolean")


def k5(spark, d):
    rows = get(spark, d, "data_rows").filter("file_id = 4")
    a, b = rows.select("pos", F.col("l_orderkey").alias("a")), rows.select("pos", F.col("l_suppkey").alias("b"))
    return a.join(b, "pos").filter("pos = 7").select("pos", "a", "b")


def k6(spark, d):
    """One plan over (snapshot, live file) instead of a lookup for each snapshot."""
    steps = sql(spark, d, "SELECT snapshot_id FROM {snapshots} s WHERE snapshot_id >= 60")
    rows = get(spark, d, "data_rows").filter("l_partkey = 77").select("file_id", "pos")
    live = rows.join(steps, F.expr("file_id <= snapshot_id"))
    return live.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("rows"))


def k12(spark, d):
    own = get(spark, d, "actions")
    per = own.groupBy("path", "version").agg(F.max_by("action", "ord").alias("last"), F.count_distinct("action").alias("kinds"))
    what = F.when(F.col("kinds") == 2, "REWRITTEN").when(F.col("last") == "add", "ADDED").otherwise("REMOVED")
    return per.select("path", "version", what.alias("what"))


def k16(spark, d):
    versions = sql(spark, d, "SELECT DISTINCT version FROM {actions} a")
    return versions.orderBy(F.desc("version")).limit(20)


def k19(spark, d):
    pairs = deletes.targets(get(spark, d, "pos_deletes"))
    return pairs.filter("file_id = 11").select("file_id", "n")


def l3(spark, d):
    return spark.createDataFrame([(n, "INCREMENTAL" if n == 1 else "REACHABLE") for n in (1, 2, 5)], "refs long, cleanup string")


def l4(spark, d):
    items = spark.range(0, 20)
    uses = sql(spark, d, "SELECT p_partkey % 13 AS id FROM {part} x")
    return planners.metadata_cleanup(items, uses, 19).select("id")


def l10(spark, d):
    return planners.rewrite_position_deletes(get(spark, d, "small_files"), 64 * MB, 2)


def l14(spark, d):
    chain = [r.snapshot_id for r in history.ancestors(get(spark, d, "snapshots"), 79).orderBy("depth").collect()]
    rows = [(t, *(lambda v: (v[0], len(v[1])))(planners.rollback_verdict(chain, chain, 79, t))) for t in (79, 50, 500)]
    return spark.createDataFrame(rows, "target long, verdict string, left_behind long")


def l15(spark, d):
    snapshots = get(spark, d, "snapshots")
    chain = history.ancestors(snapshots, 79).join(snapshots, "snapshot_id")
    return planners.rollback_target(chain, F.expr("TIMESTAMP_NTZ '1999-03-10 00:00:00'"))


def l17(spark, d):
    """A branch cut at an id replaces main's snapshots from there on."""
    main = sql(spark, d, "SELECT snapshot_id, added FROM {snapshots} s")
    return main.filter("snapshot_id >= 70").select("snapshot_id", F.lit("REPLACED").alias("fate"))


def l21(spark, d):
    files = sql(spark, d, "SELECT file, lo, hi, bytes, level, file % 2 AS deleted, bucket FROM {key_ranges} x")
    return planners.key_splits(files, ["bucket"], 256 * MB).groupBy("bucket", "split").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def l21_append(spark, d):
    files = sql(spark, d, "SELECT file, part, size AS bytes, rows AS min_seq FROM {small_files} x")
    return planners.append_splits(files, ["part"], 128 * MB).groupBy("part", "bin").agg(F.count(F.lit(1)).alias("files"))


def l22(spark, d):
    out = planners.engine_partitions([(10, True), (20, False), (30, True), (40, True)], 1000, 4, 2)
    return spark.createDataFrame([(k, p) for k, p in enumerate(out)], "file long, partition long")


def l29(spark, d):
    entries = sql(spark, d, "SELECT version AS snapshot_id, ord, path, CASE WHEN action = 'remove' THEN 1 ELSE 0 END AS kind FROM {actions} a")
    tagged = sql(spark, d, "SELECT p_partkey AS path FROM {part} x WHERE p_partkey % 5 = 0 AND p_partkey < 50")
    return planners.removed_by_expiry(entries, 6, tagged)


def l32(spark, d):
    own = sql(spark, d, "SELECT path FROM {referenced} r WHERE snapshot_id = 3")
    neighbours = planners.tag_neighbours([1, 3, 7], 3, [5, 6])
    return planners.tag_deletion(own, get(spark, d, "referenced").filter(F.col("snapshot_id").isin(neighbours)))


def l33(spark, d):
    kind, bins = planners.merge_small_manifests([3, 4, 5, 1, 1], [False] * 5, 8, 2, 100)
    return spark.createDataFrame([(k, b, kind) for k, b in enumerate(bins)], "manifest long, bin long, kind string")


def l34(spark, d):
    kind, bins = planners.merge_small_manifests([3, 9, 5], [False, False, True], 8, 1, 1)
    return spark.createDataFrame([(k, b, kind) for k, b in enumerate(bins)], "manifest long, bin long, kind string")


def l36(spark, d):
    return get(spark, d, "referenced").select("path").unionAll(get(spark, d, "listing").select("path")).distinct().agg(F.count(F.lit(1)).alias("purged"))


def l39(spark, d):
    names = spark.createDataFrame([(n,) for n in ("a", "_x", ".y", "_change_data", "_delta_index", "_p=1", "_delta_log")], "name string")
    return names.select("name", planners.hidden_name(F.col("name"), ["_p"]).alias("hidden"))


def l43(spark, d):
    cases = [(["a"], False), (["p"], False), (["zz"], False), (["c"], False), (["a"], True)]
    return spark.createDataFrame([(k, planners.zorder_refusal(c, ["p"], ["a", "b", "c", "p"], ["a", "b"], cl)) for k, (c, cl) in enumerate(cases)], "k long, refusal string")


def l44(spark, d):
    fields = [("p", None), ("a", None), ("s", [("x", None), ("y", None)]), ("b", None)]
    rows = [("limit", c) for c in planners.stats_columns(fields, ["p"], 3)] + [("named", c) for c in planners.stats_columns(fields, ["p"], 32, ["s.y"])]
    return spark.createDataFrame(rows, "rule string, column_name string")


def l48(spark, d):
    orphans = planners.orphans(get(spark, d, "listing"), get(spark, d, "referenced"), 20000)
    none = planners.rollback(get(spark, d, "snapshots"), 10_000)
    return planners.summary({"orphans": orphans, "rollback": none, "zorder": planners.zorder(get(spark, d, "small_files"))})


def l50(spark, d):
    kept = get(spark, d, "referenced").filter("snapshot_id <= 5").select("path")
    return get(spark, d, "referenced").filter("snapshot_id > 5").select("path").distinct().join(kept, "path", "left_anti")


def l51(spark, d):
    needed = get(spark, d, "referenced").select("path", "snapshot_id").unionAll(sql(spark, d, "SELECT p_partkey AS path, 77 AS snapshot_id FROM {part} x WHERE p_partkey % 22 = 0"))
    return history.missing_files(needed, get(spark, d, "listing"))


def l52(spark, d):
    """A compaction planned over the files of the version before it."""
    own = replay.live_at(get(spark, d, "actions"), 6).select(F.col("path").alias("file"), (F.col("path") % 3).alias("part"), "size", F.col("num_records").alias("rows"), F.lit(0).cast("long").alias("removed"))
    return planners.optimize(own, 6000).groupBy("part").agg(F.count(F.lit(1)).alias("bins"), F.sum("files").alias("files"))


def l53(spark, d):
    rows = [(c, len(z), planners.optimize_kind(c, z)) for c in (True, False) for z in ([], ["a"])]
    return spark.createDataFrame(rows, "clustered boolean, columns long, kind string")


def l54(spark, d):
    tips = {"a": 40, "b": 60, "c": 79}
    parent = {r.snapshot_id: r.parent_id for r in get(spark, d, "snapshots").collect()}

    def line(t):
        out = []
        while t is not None:
            out.append(t)
            t = parent.get(t)
        return out

    return spark.createDataFrame([(x, y, tips[x] in line(tips[y])) for x in tips for y in tips if x != y], "branch string, to string, allowed boolean")


def m11(spark, d):
    modes = checks.metrics_mode(["a", "b", "c"], {"write.metadata.metrics.default": "counts", "write.metadata.metrics.column.b": "none"})
    recorded = {"a": "counts", "b": "counts", "c": "none"}
    return spark.createDataFrame([(c, modes[c], recorded[c], modes[c] == recorded[c]) for c in modes], "column_name string, configured string, recorded string, agrees boolean")


def m15(spark, d):
    live = replay.live_at(get(spark, d, "actions"), 5).agg(F.count(F.lit(1)).alias("numOfAddFiles"))
    return live.select(F.lit("numOfAddFiles").alias("figure"), F.col("numOfAddFiles").alias("counted"), (F.col("numOfAddFiles") + 0).alias("recorded"))


def m20(spark, d):
    own = get(spark, d, "file_stats").withColumn("partition", F.col("seq"))
    fixed = own.withColumns({"p_min": F.col("seq"), "p_max": F.col("seq") + F.when(F.col("file_id") == 3, 1).otherwise(0)})
    return checks.partition_bounds(fixed, lambda c: c, "p").select("file_id", "verdict")


def m21(spark, d):
    """Recorded sizes against a listing; a file that is gone is not compared."""
    recorded = sql(spark, d, "SELECT p_partkey AS path, CAST(p_size AS BIGINT) * 1048576 + CASE WHEN p_partkey = 12 THEN 1 ELSE 0 END AS size FROM {part} x")
    counted = get(spark, d, "listing").select("path", "size")
    return checks.report([checks.against(recorded, counted, ["path"], ["size"], "size")]).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def m23(spark, d):
    return get(spark, d, "file_stats").filter("manifest_id = 2").select("file_id", "rows").distinct()


def n9(spark, d):
    w = Window.orderBy("file_id")
    hits = get(spark, d, "file_stats").filter("file_id % 9 = 1").select("file_id", F.lead("file_id").over(w).alias("next"))
    return hits.select("file_id", F.coalesce("next", F.lit(-1)).alias("next"))


def u5(spark, d):
    a = spark.createDataFrame([("bucket", "4"), ("merge-engine", "first-row")], "k string, v string")
    b = spark.createDataFrame([("bucket", "8"), ("write-only", "true")], "k string, v string")
    return replay.diff(a, b, "k", "v")


_LIVE = lambda v: f"SELECT path, num_records, size FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY version DESC, ord DESC) AS rn FROM {{actions}} a WHERE version <= {v}) x WHERE rn = 1 AND action = 'add'"
_V = lambda rows, names: f"SELECT * FROM (VALUES {rows}) t({names})"
_APPENDED = f"SELECT part, rows AS min_seq, file, greatest(size, {4 << 20}) AS weight FROM {{small_files}} x"
#: Buckets whose files need a merge: their sections, in order of the least key.
_SECTIONS = f"""SELECT bucket, unit, count(*) AS n, sum(bytes) AS bytes, greatest(sum(bytes), {4 << 20}) AS weight FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY bucket ORDER BY lo, hi, file ROWS UNBOUNDED PRECEDING) AS unit FROM (
    SELECT *, CASE WHEN max(hi) OVER (PARTITION BY bucket ORDER BY lo, hi, file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= lo THEN 0 ELSE 1 END AS fresh FROM {{key_ranges}} x) y) z GROUP BY bucket, unit"""

QUERIES = {
    "b3_column_placement": (b3, _V("(CAST(1 AS BIGINT), 'a'), (2, 'b')", "id, column_name")),
    "b4_name_mapping": (b4, _V("('old_s', CAST(1 AS BIGINT)), ('old_s.x', 2), ('s', 1), ('s.x', 2)", "name, id")),
    "b7_physical_names": (b7, "SELECT n_nationkey, n_name FROM nation"),
    "b8_system_columns": (b8, _V("('_KEY_k', 'INT'), ('_SEQUENCE_NUMBER', 'BIGINT'), ('_VALUE_KIND', 'TINYINT'), ('k', 'INT'), ('v', 'STRING')", "name, type")),
    "b9_older_schema_placement": (b9, "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS value, CAST(NULL AS INTEGER) AS extra FROM nation"),
    "c1_filter_parser": (c1, _V("('a = 1', CAST(-1 AS BIGINT)), ('a =', 3), ('a = 1 AND', 9), ('a ? 1', 2), ('a IN 1', 5)", "t, \"at\"")),
    "c6_filter_tree": (c6, _V("('a', '<>'), ('b', '<>'), ('c', '<')", "column_name, op")),
    "c13_value_comparison": (c13, _V("(CAST(0 AS BIGINT), CAST(-1 AS BIGINT)), (1, 0), (2, 1), (3, NULL), (4, 1)", "k, result")),
    "c14_column_binding": (c14, _V("('id', 'FIELD', CAST(1 AS BIGINT)), ('legacy', 'NAME', NULL), ('zzz', 'UNKNOWN', NULL)", "column_name, how, id")),
    "c24_metrics_mode_reasons": (c24, _V("('l_shipdate', 'evaluated'), ('l_comment', 'metrics mode none')", "column_name, why")),
    "c26_key_conjuncts": (c26, _V("('k', '=', '1'), ('k2', '>', '5')", "column_name, op, value")),
    "c29_raw_convertible": (c29, "SELECT file, min(level) OVER w > 0 AND max(file % 2) OVER w = 0 AND min(level) OVER w = max(level) OVER w AS raw FROM {key_ranges} x WINDOW w AS (PARTITION BY bucket, file // 40)"),
    "c30_file_index_rows": (c30, "SELECT file_id, CAST(count(*) FILTER (WHERE l_partkey < 500 AND (l_returnflag = 'R' OR l_partkey > 400)) AS BIGINT) AS n FROM {data_rows} r GROUP BY file_id"),
    "c41_summary_decode": (c41, "SELECT manifest_id, min(l_orderkey_min) AS lo, max(l_orderkey_max) AS hi FROM {file_stats} f GROUP BY manifest_id"),
    "c43_evolved_statistics": (c43, "SELECT file_id, file_id < 40 AS skipped FROM {file_stats} f"),
    "c45_bounds_withheld": (c45, "SELECT file_id, FALSE AS skipped FROM {file_stats} f"),
    "c46_scan_rules": (c46, _V("('bucket', 'bucket'), ('skips level 0', 'skips level 0'), ('never by value', 'never by value')", "want, rule")),
    "d3_bounds_overlap": (d3, "SELECT file_id, p_partkey AS n FROM {file_stats} f JOIN part ON p_partkey < 15 AND l_partkey_max >= p_partkey * 3 AND l_partkey_min <= p_partkey * 3 + 2 WHERE file_id < 20"),
    "d5_delete_targets": (d5, "SELECT min(file_id) AS lo, max(file_id) AS hi, CAST(count(*) AS BIGINT) AS n, min(file_id) = max(file_id) AS single FROM {pos_deletes} p GROUP BY pos % 7"),
    "d13_dangling_positions": (d13, "SELECT file_id, CAST(count(*) AS BIGINT) AS kept FROM {pos_deletes} p WHERE file_id % 2 = 0 GROUP BY file_id"),
    "d18_export_check": (d18, f"SELECT CAST(count(*) FILTER (WHERE b.path IS NULL) AS BIGINT) AS table_only, CAST(count(*) FILTER (WHERE a.path IS NULL) AS BIGINT) AS export_only, bool_and(a.size IS NOT DISTINCT FROM b.size) AS current FROM ({_LIVE(8)}) a FULL JOIN ({_LIVE(7)}) b ON a.path = b.path"),
    "d19_export_fates": (d19, "SELECT CASE WHEN file % 6 = 5 AND file % 10 <> 5 THEN 'EXPORTED' WHEN level < 5 THEN 'BELOW_TOP_LEVEL' ELSE 'MISSING' END AS fate, CAST(count(*) AS BIGINT) AS n FROM {key_ranges} x GROUP BY 1"),
    "e3_content_stats": (e3, "SELECT CAST(count(*) AS BIGINT) AS files, CAST(count(DISTINCT manifest_id) AS BIGINT) AS manifests, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(bytes) AS BIGINT) AS bytes FROM {file_stats} f"),
    "e23_bucket_and_level_ranges": (e23, "SELECT bucket, min(level) AS least_level, max(level) AS top_level, min(file) AS first_file, max(file) AS last_file FROM {key_ranges} x GROUP BY bucket"),
    "e30_live_files_of_a_replay": (e30, "SELECT bucket, CAST(count(*) AS BIGINT) AS files FROM (SELECT bucket, k, arg_max(kind, s) AS last FROM {lsm_records} x GROUP BY bucket, k) y WHERE last NOT IN (1, 3) GROUP BY bucket"),
    "e31_patch_rows": (e31, "SELECT CAST(sum(CASE WHEN n_deletes = 1 THEN rows END) AS BIGINT) AS patch_rows, CAST(sum(CASE WHEN n_deletes <> 1 THEN rows END) AS BIGINT) AS rows FROM {small_files} f"),
    "g2_sibling_order": (g2, "SELECT manifest_id, file_id, CAST(row_number() OVER (PARTITION BY manifest_id ORDER BY rows DESC, file_id) AS BIGINT) AS place FROM {file_stats} f"),
    "g4_paged_reads": (g4, "SELECT (k - 1) // 16 AS page, CAST(count(*) AS BIGINT) AS files, min(file_id) AS first FROM (SELECT file_id, row_number() OVER (ORDER BY file_id) AS k FROM {file_stats} f) x GROUP BY 1"),
    "i6_single_values": (i6, _V("(CAST(0 AS BIGINT), '7'), (1, '7'), (2, '-1'), (3, 'ab'), (4, '14.20'), (5, '1970-01-02'), (6, '1.5')", "k, value")),
    "i8_partition_tuple": (i8, _V("('region', '3'), ('month', '1999-12')", "name, text")),
    "i9_binary_row_partition": (i9, _V("('a=eu/b=19724/c=5/e=__DEFAULT_PARTITION__'), ('a=north-america/b=__DEFAULT_PARTITION__/c=-1/e=x')", "path")),
    "i10_binary_row_bounds": (i10, _V("('k', '1', '9', CAST(0 AS BIGINT)), ('v', 'a', 'a much longer bound', 3)", "name, least, greatest, nulls")),
    "i11_index_hash": (i11, None),
    "i14_timestamp_numbers": (i14, "SELECT o_orderkey, CAST(epoch_ms(o_orderdate) AS BIGINT) AS ms, CAST(epoch_us(o_orderdate) AS BIGINT) AS us FROM orders"),
    "i15_index_values": (i15, "SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) * 100 AS BIGINT) AS unscaled FROM orders"),
    "i23_statistics_json": (i23, "SELECT file_id, rows FROM {file_stats} f"),
    "i26_nested_types": (i26, _V("('m', CAST(1 AS BIGINT), 'map'), ('m.key', 2, 'string'), ('m.value', 3, 'struct')", "path, id, type")),
    "i27_change_kinds": (i27, _V("('insert', CAST(0 AS BIGINT)), ('update_preimage', 1), ('update_postimage', 2), ('delete', 3), ('other', NULL)", "c, kind")),
    "j3_changelog_inputs": (j3, "SELECT s % 50 AS snapshot, CAST(count(*) AS BIGINT) AS records, min(s) AS first FROM {lsm_records} x WHERE s % 50 < 20 GROUP BY 1"),
    "j7_changelog_lifecycle": (j7, _V("(CAST(0 AS BIGINT), FALSE), (1, TRUE), (2, TRUE)", "k, decoupled")),
    "k5_stitched_row": (k5, "SELECT pos, l_orderkey AS a, l_suppkey AS b FROM {data_rows} r WHERE file_id = 4 AND pos = 7"),
    "k6_row_history": (k6, "SELECT snapshot_id, CAST(count(*) AS BIGINT) AS rows FROM {data_rows} r JOIN {snapshots} s ON r.file_id <= s.snapshot_id WHERE l_partkey = 77 AND snapshot_id >= 60 GROUP BY snapshot_id"),
    "k12_file_history_of_a_replay": (k12, "SELECT path, version, CASE WHEN count(DISTINCT action) = 2 THEN 'REWRITTEN' WHEN arg_max(action, ord) = 'add' THEN 'ADDED' ELSE 'REMOVED' END AS what FROM {actions} a GROUP BY path, version"),
    "k16_history_inputs": (k16, "SELECT DISTINCT version FROM {actions} a ORDER BY version DESC LIMIT 20"),
    "k19_deletes_for_a_file": (k19, "SELECT file_id, CAST(count(*) AS BIGINT) AS n FROM {pos_deletes} p WHERE file_id = 11 GROUP BY file_id"),
    "l3_cleanup_pick": (l3, _V("(CAST(1 AS BIGINT), 'INCREMENTAL'), (2, 'REACHABLE'), (5, 'REACHABLE')", "refs, cleanup")),
    "l4_metadata_cleanup": (l4, _V("(CAST(13 AS BIGINT)), (14), (15), (16), (17), (18)", "id")),
    "l10_rewrite_position_deletes": (l10, f"SELECT * FROM (SELECT part, CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM {{small_files}} f WHERE size < 0.75 * {64 * MB} OR size > 1.8 * {64 * MB} GROUP BY part) g WHERE files >= 5 OR bytes > {64 * MB}"),
    "l14_rollback_verdicts": (l14, _V("(CAST(79 AS BIGINT), 'NOTHING_TO_DO', CAST(0 AS BIGINT)), (50, 'MOVES', 29), (500, 'UNKNOWN_SNAPSHOT', 0)", "target, verdict, left_behind")),
    "l15_rollback_target_for_a_time": (l15, "SELECT max(snapshot_id) AS snapshot_id FROM {snapshots} s WHERE at_time < TIMESTAMP '1999-03-10'"),
    "l17_branch_fast_forward": (l17, "SELECT snapshot_id, 'REPLACED' AS fate FROM {snapshots} s WHERE snapshot_id >= 70"),
    "l21_keyed_splits": (l21, ordered_sql(_SECTIONS, "bucket", "unit", "weight", 256 << 20) + "SELECT bucket, bin AS split, CAST(sum(n) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM w GROUP BY bucket, bin"),
    "l21_append_splits": (l21_append, ordered_sql(_APPENDED, "part", "min_seq, file", "weight", 128 << 20) + "SELECT part, bin, CAST(count(*) AS BIGINT) AS files FROM w GROUP BY part, bin"),
    "l22_engine_partitions": (l22, _V("(CAST(0 AS BIGINT), CAST(1 AS BIGINT)), (1, 0), (2, 2), (3, 3)", "file, partition")),
    "l29_expired_data_files": (l29, "SELECT path FROM (SELECT path, arg_max(action, ord) AS last FROM {actions} a WHERE version <= 6 GROUP BY path) x WHERE last = 'remove' AND path % 5 <> 0 OR (last = 'remove' AND path = 0 AND 0 NOT IN (SELECT p_partkey FROM part))"),
    "l32_tag_deletion": (l32, "SELECT DISTINCT path FROM {referenced} r WHERE snapshot_id = 3 AND path NOT IN (SELECT path FROM {referenced} q WHERE snapshot_id IN (1, 5))"),
    "l33_manifest_merge_by_size": (l33, _V("(CAST(0 AS BIGINT), CAST(0 AS BIGINT), 'MINOR'), (1, 0, 'MINOR'), (2, 0, 'MINOR'), (3, 1, 'MINOR'), (4, 1, 'MINOR')", "manifest, bin, kind")),
    "l34_compact_manifest": (l34, _V("(CAST(0 AS BIGINT), CAST(0 AS BIGINT), 'FULL'), (1, NULL, 'FULL'), (2, 0, 'FULL')", "manifest, bin, kind")),
    "l36_purge_files": (l36, "SELECT CAST(count(*) AS BIGINT) AS purged FROM (SELECT path FROM {referenced} r UNION SELECT path FROM {listing} l) x"),
    "l39_hidden_names": (l39, _V("('a', FALSE), ('_x', TRUE), ('.y', TRUE), ('_change_data', FALSE), ('_delta_index', FALSE), ('_p=1', FALSE), ('_delta_log', TRUE)", "name, hidden")),
    "l43_zorder_refusal": (l43, _V("(CAST(0 AS BIGINT), NULL), (1, 'p is a partition column'), (2, 'zz is not a column'), (3, 'c has no statistics'), (4, 'the table is clustered')", "k, refusal")),
    "l44_statistics_columns": (l44, _V("('limit', 'a'), ('limit', 's'), ('limit', 's.x'), ('limit', 's.y'), ('named', 's'), ('named', 's.y')", "rule, column_name")),
    "l48_maintenance_summary": (l48, "SELECT 'orphans' AS procedure, CAST(count(*) AS BIGINT) AS n, 'WOULD_RUN' AS verdict FROM {listing} l WHERE modified < 20000 AND path NOT IN (SELECT path FROM {referenced} r) UNION ALL SELECT 'rollback', 0, 'NOTHING_TO_DO' UNION ALL SELECT 'zorder', CAST(count(DISTINCT part) AS BIGINT), 'WOULD_RUN' FROM {small_files} f"),
    "l50_rollback_leftovers": (l50, "SELECT DISTINCT path FROM {referenced} r WHERE snapshot_id > 5 AND path NOT IN (SELECT path FROM {referenced} q WHERE snapshot_id <= 5)"),
    "l51_missing_files_of_all_kinds": (l51, "SELECT path, string_agg(CAST(snapshot_id AS VARCHAR), ',' ORDER BY snapshot_id) AS snapshots FROM (SELECT path, snapshot_id FROM {referenced} r UNION SELECT p_partkey, 77 FROM part WHERE p_partkey % 22 = 0) x WHERE path NOT IN (SELECT path FROM {listing} l) GROUP BY path"),
    "l52_optimize_replay": (l52, None),
    "l53_optimize_dispatch": (l53, _V("(TRUE, CAST(0 AS BIGINT), 'CLUSTERING'), (TRUE, 1, 'ZORDER'), (FALSE, 0, 'COMPACTION'), (FALSE, 1, 'ZORDER')", "clustered, columns, kind")),
    "l54_all_fast_forwards": (l54, _V("('a', 'b', TRUE), ('a', 'c', TRUE), ('b', 'a', FALSE), ('b', 'c', TRUE), ('c', 'a', FALSE), ('c', 'b', FALSE)", "branch, \"to\", allowed")),
    "m11_metrics_mode_check": (m11, _V("('a', 'counts', 'counts', TRUE), ('b', 'none', 'counts', FALSE), ('c', 'counts', 'none', FALSE)", "column_name, configured, recorded, agrees")),
    "m15_last_checkpoint": (m15, f"SELECT 'numOfAddFiles' AS figure, CAST(count(*) AS BIGINT) AS counted, CAST(count(*) AS BIGINT) AS recorded FROM ({_LIVE(5)}) l"),
    "m20_identity_partition_bounds": (m20, "SELECT file_id, CASE WHEN file_id = 3 THEN 'DIFFERS' ELSE 'AGREES' END AS verdict FROM {file_stats} f"),
    "m21_recorded_sizes": (m21, "SELECT CASE WHEN p_partkey % 11 = 0 THEN 'NOT_CHECKED' WHEN p_partkey = 12 THEN 'DIFFERS' ELSE 'AGREES' END AS verdict, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1"),
    "m23_sweep_targets": (m23, "SELECT file_id, rows FROM {file_stats} f WHERE manifest_id = 2"),
    "n10_find_steps": (n9, "SELECT file_id, coalesce(lead(file_id) OVER (ORDER BY file_id), -1) AS next FROM {file_stats} f WHERE file_id % 9 = 1"),
    "u5_option_difference": (u5, _V("('bucket', 'CHANGED'), ('merge-engine', 'ONLY_IN_FROM'), ('write-only', 'ONLY_IN_TO')", "k, side")),
}
