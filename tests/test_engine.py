"""The table-analytics engine: parsers and codecs by hand-computed cases, operators on small tables, sources on files."""

import datetime
import json
import math
import struct
import urllib.parse
import uuid
import zlib
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import codecs, parsing, transforms
from siltstone.operators import deletes, history, merge, planners, pruning, replay
from siltstone.operators.predicates import CANNOT_MATCH, MIGHT_MATCH, And, FilterError, Not, Or, Term, compare_values, conjuncts, holds, like_matches, parse, parse_literal, push_negation, render, to_column, verdict
from siltstone.plans.facade import open_table
from siltstone.sources import avro, delta, files, iceberg, paimon

# ---- filters


def test_parse_shapes():
    assert parse("a = 1 AND b <> 'x''y'") == And((Term("a", "=", "1", "number"), Term("b", "<>", "x'y", "string")))
    assert parse("a IN (1, 2)") == Or((Term("a", "=", "1", "number"), Term("a", "=", "2", "number")))
    assert parse("a NOT BETWEEN 1 AND 2") == Not(And((Term("a", ">=", "1", "number"), Term("a", "<=", "2", "number"))))
    assert parse("a LIKE 'x'") == Term("a", "=", "x", "string") and parse("s.t IS NOT NULL") == Term("s.t", "is not null")
    assert parse("NOT (a = 1 OR b = 2) AND c = 3").parts[0] == Not(Or((Term("a", "=", "1", "number"), Term("b", "=", "2", "number"))))
    assert parse("d >= DATE '2020-01-01'") == Term("d", ">=", "2020-01-01", "date")


@pytest.mark.parametrize(("text", "at"), [("a =", 3), ("a = 1 AND", 9), ("a ? 1", 2), ("(a = 1", 6), ("a = 1 b", 6), ("", 0), ("a IN 1", 5)])
def test_parse_errors_have_offsets(text, at):
    with pytest.raises(FilterError) as e:
        parse(text)
    assert e.value.offset == at


_term = st.builds(Term, st.sampled_from("abc"), st.sampled_from(["=", "<>", "<", "<=", ">", ">="]), st.integers(0, 4).map(str), st.just("number"))
_filter = st.recursive(_term, lambda f: st.one_of(f.map(Not), st.lists(f, min_size=1, max_size=3).map(lambda p: And(tuple(p))), st.lists(f, min_size=1, max_size=3).map(lambda p: Or(tuple(p)))), max_leaves=8)
_OPS = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _direct(f, row):
    if isinstance(f, Term):
        return _OPS[f.op](row[f.column], int(f.value))
    if isinstance(f, Not):
        return not _direct(f.part, row)
    return (all if isinstance(f, And) else any)(_direct(p, row) for p in f.parts)


@settings(max_examples=200, deadline=None)
@given(_filter, st.fixed_dictionaries({c: st.integers(0, 4) for c in "abc"}))
def test_negation_and_rendering_keep_the_meaning(f, row):
    want = _direct(f, row)
    leaf = lambda t: _OPS[t.op](row[t.column], int(t.value))
    assert holds(f, leaf) == want == holds(push_negation(f), leaf) == holds(parse(render(f)), leaf)


@settings(max_examples=100, deadline=None)
@given(_filter, st.lists(st.fixed_dictionaries({c: st.integers(0, 4) for c in "abc"}), min_size=1, max_size=5))
def test_a_skip_is_never_wrong(f, rows):
    low, high = {c: min(r[c] for r in rows) for c in "abc"}, {c: max(r[c] for r in rows) for c in "abc"}

    def leaf(t):
        v, a, b = int(t.value), low[t.column], high[t.column]
        out = {"=": v < a or v > b, "<>": a == b == v, "<": a >= v, "<=": a > v, ">": b <= v, ">=": b < v}[t.op]
        return CANNOT_MATCH if out else MIGHT_MATCH

    if verdict(f, leaf) == CANNOT_MATCH:
        assert not any(_direct(f, r) for r in rows)


def test_spark_filter_and_skips(spark):
    rows = spark.createDataFrame([(k, f"n{k % 7}", None if k % 5 == 0 else float(k), k // 10) for k in range(100)], "a int, s string, x double, file int")
    stats = pruning.column_statistics(rows, ["file"], ["a", "s", "x"])
    own = {"a": pruning.stats_of("a", "int"), "s": pruning.stats_of("s", "string"), "x": pruning.stats_of("x", "double")}
    for text in ["a < 25", "a IN (3, 95)", "NOT a < 90", "s LIKE 'n1%' AND a > 40", "x IS NULL AND a < 15", "x IS NOT NULL OR a = 1", "a <> 3", "a = 7 AND s = 'n0'", "a = 'abc'", "s NOT LIKE 'n%'"]:
        f = parse(text)
        kept = {r.file for r in stats.filter(~pruning.skips(f, own)).collect()}
        hits = {r.file for r in rows.filter(to_column(f, {"a": "int", "x": "double"})).collect()}
        assert hits <= kept, text
    assert {r.file for r in stats.filter(~pruning.skips(parse("a < 25"), own)).collect()} == {0, 1, 2}


def test_literals_and_like():
    assert parse_literal("12", "int") == 12 and parse_literal("1x", "int") is None and parse_literal("2020-01-02", "date") == datetime.date(2020, 1, 2)
    assert compare_values(1, 1.5) == -1 and compare_values(Decimal("2"), 2) == 0 and compare_values("a", 1) is None and compare_values(True, 1) is None
    assert compare_values(datetime.date(2020, 1, 1), datetime.datetime(2020, 1, 1, 1)) == -1
    assert like_matches("a%c", r"a\%c") and not like_matches("abc", r"a\%c") and like_matches("a\nb", "a%b")
    assert conjuncts(parse("a = 1 AND b = 2")) and conjuncts(parse("a = 1 OR b = 2")) is None


# ---- codecs


def test_bucket_vectors():
    # the published vectors of the table specification
    assert transforms.murmur3(struct.pack("<q", 34)) == 2017239379
    assert transforms.murmur3("iceberg".encode()) == 1210000089
    assert transforms.murmur3(transforms.bucket_bytes(Decimal("14.20"))) == -500754589
    assert transforms.murmur3(transforms.bucket_bytes(datetime.date(2017, 11, 16))) == -653330422
    assert transforms.bucket_of(True, 4) is None and transforms.bucket_of(1.5, 4) is None
    values = np.array([34, -1, 0, 2**62, -(2**63)])
    assert [int(x) for x in transforms.murmur3_longs(values)] == [transforms.murmur3(struct.pack("<q", int(v))) & 0xFFFFFFFF for v in values]


def test_bucket_and_hash_columns(spark):
    rows = spark.createDataFrame([(34,), (None,), (-5,)], "v long")
    got = [r.b for r in rows.select(transforms.bucket(F.col("v"), 16).alias("b")).collect()]
    assert got == [transforms.bucket_of(34, 16), None, transforms.bucket_of(-5, 16)]
    assert [r.h for r in rows.select(codecs.wang(F.col("v")).alias("h")).collect()] == [codecs.wang_int(34), None, codecs.wang_int(-5)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=200), st.integers(0, 70_000))
def test_roaring_round_trip(values, run):
    values = [*values, *range(run)]
    assert codecs.roaring64(codecs.roaring64_encode(values)).tolist() == sorted(set(values))
    assert codecs.vector_blob(codecs.vector_blob_encode(values)).tolist() == sorted(set(values))


def test_roaring_runs():
    data = struct.pack("<I", 12347) + b"\x01" + struct.pack("<HH", 2, 6) + struct.pack("<H", 2) + struct.pack("<4H", 3, 2, 10, 3)
    assert codecs.roaring32(data)[0].tolist() == [(2 << 16) + x for x in (3, 4, 5, 10, 11, 12, 13)]


def test_broken_vectors_are_refused():
    blob = bytearray(codecs.vector_blob_encode([1, 2, 3]))
    blob[-1] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        codecs.vector_blob(bytes(blob))


def test_z85_and_puffin():
    assert codecs.z85_encode(bytes.fromhex("864fd26fb559f75b")) == "HelloWorld" and codecs.z85_decode("HelloWorld").hex() == "864fd26fb559f75b"
    data = codecs.puffin_encode([({"type": "x", "fields": [1]}, b"abc"), ({"type": "y"}, b"")])
    footer = codecs.puffin_footer(data)
    assert [b["type"] for b in footer["blobs"]] == ["x", "y"] and footer["blobs"][0]["length"] == 3
    with pytest.raises(ValueError):
        codecs.puffin_footer(b"nope" + data[4:])


def test_single_values():
    one = codecs.single_value
    assert one(b"\x01", "boolean") is True and one(struct.pack("<i", -5), "long") == -5 and one(struct.pack("<f", 1.5), "double") == 1.5
    assert one(struct.pack("<i", 1), "date") == datetime.date(1970, 1, 2) and one(b"\x05\x8c", "decimal(9, 2)") == Decimal("14.20")
    assert one("é".encode(), "string") == "é" and one(None, "int") is None and one(bytes(16), "uuid") == "00000000-0000-0000-0000-000000000000"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=1, max_size=60), st.integers(-60, 60), st.sampled_from(["=", "<>", "<", "<=", ">", ">="]))
def test_row_indexes_equal_a_scan(values, x, op):
    want = [k for k, v in enumerate(values) if v is not None and _OPS[op](v, x)]
    assert codecs.BitSliced(values).rows(op, x).tolist() == want == codecs.RangeBitmaps(values).rows(op, x).tolist()
    if op in ("=", "<>"):
        assert codecs.Bitmaps(values).rows(op, x).tolist() == want
    assert codecs.BitSliced(values).rows("is null").tolist() == [k for k, v in enumerate(values) if v is None]


def test_bloom_has_no_false_negatives():
    keys = [codecs.xxhash64(str(k).encode()) for k in range(300)]
    bloom = codecs.Bloom.of(keys, 4096, 4)
    assert all(map(bloom.might_contain, keys)) and codecs.xxhash64(b"") == -1205034819632174695


@pytest.mark.parametrize(("size", "probes"), [(64, 4), (4099, 7)])
def test_bloom_probes_many_hashes_as_one(size, probes):
    def places(h):
        signed = lambda x: (x & 0xFFFFFFFF) - (1 << 32) if x & 0x80000000 else x & 0xFFFFFFFF
        both = [signed(signed(h) + k * signed(h >> 32)) for k in range(1, probes + 1)]
        return {(~b if b < 0 else b) % size for b in both}

    keys = [codecs.wang_int(k) for k in range(-40, 40)] + [0, -1, 2**31 - 1, -(2**31), 2**63 - 1, -(2**63), 2**64 - 1]
    bloom = codecs.Bloom.of(keys, size, probes)
    assert set(np.flatnonzero(bloom.bits)) == set().union(*map(places, keys))
    others = np.arange(-3000, 3000) * 0x1234567890ABC
    found = [bool(bloom.bits[list(places(int(h)))].all()) for h in others]
    assert bloom.might_contain_each(others).tolist() == found == [bloom.might_contain(int(h)) for h in others] and not (all(found) and size > 64)
    assert bloom.might_contain_each([]).tolist() == [] and not codecs.Bloom.of([], size, probes).bits.any()


def test_parsing():
    assert parsing.duration_ms("30 min") == 1_800_000 and parsing.duration_ms("bad") is None and parsing.interval_ms("interval 1 week") == 604_800_000
    assert parsing.memory_bytes("64kb") == 65536 and parsing.memory_bytes("128 mb") == 128 << 20 and parsing.memory_bytes("x") is None


# ---- deletes, merges, logs


def test_merge_on_read_golden(spark):
    """Insert 1-4, insert 5-7, delete 2 by position, update 5, delete 7 by equality: 1, 3, 4, 5, 6 live."""
    rows = spark.createDataFrame([(0, k, 1, k + 1, "a") for k in range(4)] + [(1, k, 2, k + 5, "b") for k in range(3)] + [(2, 0, 3, 5, "updated")], "file_id long, pos long, seq long, id long, name string")
    positions = spark.createDataFrame([(0, 1, 3, "p1"), (1, 0, 3, "p2")], "file_id long, pos long, delete_seq long, delete_key string")
    equality = spark.createDataFrame([(7, 4, "e1"), (5, 3, "e2"), (None, 9, "e3")], "id long, delete_seq long, delete_key string")
    got = {(r.id, r.name): r.fate for r in deletes.with_fate(rows, None, positions, equality, ["id"]).collect()}
    assert {k[0] for k, v in got.items() if v == "LIVE"} == {1, 3, 4, 5, 6} and got[5, "updated"] == "LIVE"
    assert got[2, "a"] == "POSITION_DELETED" and got[7, "b"] == "EQUALITY_DELETED"
    assert got[5, "b"] == "EQUALITY_DELETED"  # both claim it; e2 comes before p2


def test_null_keys_and_strict_sequences(spark):
    rows = spark.createDataFrame([(0, 0, 2, None), (0, 1, 3, None), (0, 2, 2, 4)], "file_id long, pos long, seq long, id long")
    equality = spark.createDataFrame([(None, 3, "e"), (4, 2, "e")], "id long, delete_seq long, delete_key string")
    assert [r.fate for r in deletes.with_fate(rows, None, None, equality, ["id"]).orderBy("pos").collect()] == ["EQUALITY_DELETED", "LIVE", "LIVE"]


def test_merge_engines_golden(spark):
    schema = "k int, s long, kind int, a string, b string, n int"
    rows = spark.createDataFrame([(1, 1, 0, "a1", None, 10), (1, 2, 0, None, "b1", 5), (2, 3, 0, "a2", "b2", 1), (2, 4, 0, "A2", None, 2), (2, 5, 3, None, None, None), (2, 6, 0, "A2", None, 3), (3, 7, 0, "a3", None, 1), (3, 8, 3, None, None, None)], schema)
    assert {tuple(r) for r in merge.partially_updated(rows, ["k"], ["a", "b"]).collect()} == {(1, "a1", "b1"), (2, "A2", None)}
    assert {tuple(r) for r in merge.aggregated(rows, ["k"], {"n": "sum", "a": "last_non_null_value"}).collect()} == {(1, 15, "a1"), (2, 3, "A2")}
    assert {tuple(r) for r in merge.deduplicated(rows, ["k"], ["a"]).collect()} == {(1, None), (2, "A2")}
    assert {tuple(r) for r in merge.first_rows(rows, ["k"], ["a"]).collect()} == {(1, "a1"), (2, "a2"), (3, "a3")}


def test_sequence_groups(spark):
    rows = spark.createDataFrame([(1, 1, 0, 10, 5, 1), (1, 2, 0, 20, 4, 2), (1, 3, 0, 30, None, 3), (1, 4, 0, 40, 5, 0), (2, 5, 0, 7, 9, 1), (2, 6, 3, None, 9, None), (3, 7, 0, 1, 3, 1), (3, 8, 3, None, 2, None)], "k int, s long, kind int, a long, ga long, gb long")
    assert {tuple(r) for r in merge.sequence_groups(rows.filter("k = 1"), ["k"], {"ga": ["a"], "gb": []}).collect()} == {(1, 5, 40, 3)}
    assert {tuple(r) for r in merge.removed_fold(rows, ["k"], "a", "ga").collect()} == {(1, 5, 40), (3, 3, 1)}


def test_merge_rules():
    assert merge.merge_rule({"merge-engine": "first-row"}).skips_level_0 and merge.merge_rule({}, has_key=False).keep == "ALL"
    assert merge.merge_rule({"merge-engine": "partial-update", "fields.g.sequence-group": "a,b"}).sequence_groups == (("g", ("a", "b")),)


def test_sections(spark):
    rows = spark.createDataFrame([(1, 0, 10, 0), (2, 5, 20, 0), (3, 20, 21, 0), (4, 22, 30, 0), (5, 0, 1, 1)], "file long, lo long, hi long, b long")
    got = {r.file: r.section for r in merge.sections(rows, ["b"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 2, 5: 1}


def test_replay(spark):
    rows = [(0, 0, "a", "add", 1), (0, 1, "b", "add", 2), (1, 2, "a", "remove", 0), (2, 3, "a", "add", 3), (2, 4, "c", "remove", 0), (3, 5, "b", "add", 9)]
    actions = spark.createDataFrame(rows, "version long, ord long, path string, action string, size long")
    assert {(r.path, r["size"]) for r in replay.live_at(actions, 1).collect()} == {("b", 2)}
    assert {(r.path, r["size"]) for r in replay.live_at(actions).collect()} == {("a", 3), ("b", 9)}
    for v in range(4):
        one = {r.path for r in replay.live_at(actions, v).collect()}
        assert one == {r.path for r in replay.live_by_version(actions).filter(f"at_version = {v}").collect()}
    assert [r.effect for r in replay.trace(actions).orderBy("ord").collect()] == ["ADDED", "ADDED", "REMOVED", "ADDED", "REMOVED_ABSENT", "REPLACED"]
    base = replay.live_at(actions, 1).drop("version", "ord")
    assert {r.path for r in replay.from_checkpoint(base, actions, 1, 3).collect()} == {"a", "b"}
    assert [r.version for r in replay.missing_versions(actions.filter("version <> 1"), 0, 3).collect()] == [1]


def test_history(spark):
    snapshots = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 2), (5, 4)], "snapshot_id long, parent_id long")
    want = {(5, 0), (4, 1), (2, 2), (1, 3)}
    assert {tuple(r) for r in history.ancestors(snapshots, 5).collect()} == want == {tuple(r) for r in history.chain(snapshots, 5).collect()}
    log = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 1), (4, 4)], "ord long, snapshot_id long")
    assert {tuple(r) for r in history.left_behind(log).collect()} == {(2, 3), (3, 3)}
    assert history.moved([1, 2, 3], [3, 1, 2]) == [3] and history.moved([1, 2], [1, 2, 9]) == []


def _brute_left_behind(log):
    first, out = {}, {}
    for at, own in sorted(log):
        first.setdefault(own, at)
    for at, own in sorted(log):
        if own is not None and first[own] < at:
            for other, seen in first.items():
                if first[own] < seen < at:
                    out.setdefault(other, at)
    return out


@pytest.mark.parametrize(("step", "start"), [(1, 0), (1, -700), (977, -5000), (2**56, -(2**63))])
@pytest.mark.parametrize("back", [3, 40, 1000])
def test_left_behind_by_short_long_and_nested_resets(spark, step, start, back):
    import random

    draw, log = random.Random(back), []
    for k in range(250):
        own = draw.choice(log[-back:])[1] if log and draw.random() < 0.3 else None if k == 20 else k
        log.append((start + k * step, own))
    got = history.left_behind(spark.createDataFrame(log, "ord long, snapshot_id long"))
    assert {r.snapshot_id: r.reset_ord for r in got.collect()} == _brute_left_behind(log) and got.count() > 5


def test_left_behind_does_not_compare_every_snapshot_with_every_reset(spark):
    n = 200_000  # every other entry goes back to the first snapshot: 5e9 pairs of a snapshot and a later reset
    log = spark.range(n).selectExpr("id AS ord", "IF(id % 2 = 1, 0, id) AS snapshot_id")
    found = history.left_behind(log)
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if " Join " in f" {line}"]
    assert joins and not [line for line in joins if "<" in line or ">" in line]
    assert found.filter("reset_ord = snapshot_id + 1").count() == found.count() == n // 2 - 1


# ---- planners


def test_packing_rules():
    assert planners.first_fit([6, 5, 4, 3], 10, 1) == [0, 1, 1, 2] and planners.first_fit([6, 5, 4, 3], 10, 2) == [0, 1, 0, 1]
    assert planners.ordered([6, 5, 4, 3], 10) == [0, 1, 1, 2] and planners.ordered([1, 1, 1], 10, open_cost=5) == [0, 0, 1]
    assert planners.split_size(100 << 20, 8, 128 << 20) == 16 << 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40), st.integers(1, 5))
def test_bins_hold_their_target(sizes, lookback):
    for bins in (planners.first_fit(sizes, 12, lookback), planners.ordered(sizes, 12)):
        load = {}
        for b, s in zip(bins, sizes, strict=True):
            load[b] = load.get(b, 0) + s
        assert all(v <= 12 for v in load.values())


def test_universal_pick():
    assert planners.pick_runs([1, 1, 1, 1, 1], [0] * 5) == ("SIZE_AMPLIFICATION", 5, 5)
    assert planners.pick_runs([1, 1, 1, 1, 100], [0, 0, 0, 0, 5]) == ("SIZE_RATIO", 4, 4) and planners.pick_runs([1, 100], [0, 1]) == ("NONE", 0, None)
    # the forced runs, and on from there by size
    assert planners.pick_runs([1, 100, 1, 1, 1, 1000], [0, 0, 0, 0, 0, 5]) == ("RUN_COUNT", 5, 4)
    # level-0 runs left over join, up to the first run of a higher level
    assert planners.pick_runs([1, 1, 50, 60, 900, 9000], [0, 0, 0, 0, 3, 5]) == ("SIZE_RATIO", 5, 3)
    assert planners.pick_runs([1, 1, 50, 60, 900], [0, 0, 0, 0, 3]) == ("SIZE_RATIO", 5, 5)
    assert planners.pick_runs([10, 20, 40, 80, 900], [0, 0, 0, 0, 5]) == ("NONE", 0, None)
    assert planners.pick_runs([1, 1, 90, 900], [0, 1, 2, 5], trigger=4) == ("SIZE_RATIO", 2, 1)


def test_expiry(spark):
    chain = spark.createDataFrame([(5, 0, 50), (4, 1, 40), (3, 2, 10), (2, 3, 45)], "snapshot_id long, depth long, at_time long")
    named = spark.createDataFrame([(2,)], "snapshot_id long")
    got = {r.snapshot_id: r.retained for r in planners.expire_snapshots(chain, F.lit(20), 1, named).collect()}
    assert got == {5: True, 4: True, 3: False, 2: True}


def test_vacuum_names(spark):
    listing = spark.createDataFrame([("a.parquet", 1), ("_delta_log/0.json", 1), ("_p=1/b.parquet", 1), (".hid/c", 1), ("_change_data/d", 1), ("e.parquet", 99)], "path string, modified long")
    kept = spark.createDataFrame([("a.parquet",)], "path string")
    assert {r.path for r in planners.vacuum(listing, kept, 50, ["_p"]).collect()} == {"_p=1/b.parquet", "_change_data/d"}


# ---- sources


def test_avro_round_trip(spark, tmp_path):
    schema = {"type": "record", "name": "r", "fields": [{"name": "a", "type": "long", "field-id": 1}, {"name": "s", "type": ["null", "string"], "field-id": 2}, {"name": "m", "type": {"type": "map", "values": "double"}}, {"name": "l", "type": {"type": "array", "items": "int", "element-id": 9}}, {"name": "b", "type": "bytes"}]}
    rows = [{"a": k - 3, "s": None if k % 2 else f"é{k}", "m": {"x": k / 2}, "l": list(range(k)), "b": b"\x00\xff"} for k in range(7)]
    for codec in ("null", "deflate"):
        data = avro.write_records(schema, rows, codec)
        assert [r for r, e in avro.records(data) if e is None] == rows
        (tmp_path / f"{codec}.avro").write_bytes(data)
    (tmp_path / "bad.avro").write_bytes(b"Obj\x01broken")
    got = avro.read_avro(spark, [str(tmp_path / "*.avro")]).collect()
    assert sum(r.error is None for r in got) == 14 and any(r.error for r in got if r.path.endswith("bad.avro"))
    assert json.loads(next(r.record for r in got if r.error is None and r.row_index == 2))["l"] == [0, 1]
    tree = avro.column_tree(schema)
    assert [(c["name"], c["id"], c["kind"]) for c in tree["children"]][:2] == [("a", 1, "primitive"), ("s", 2, "primitive")] and tree["children"][3]["children"][0]["id"] == 9


@pytest.fixture
def log_table(spark, tmp_path):
    root = tmp_path / "t"
    (root / "_delta_log").mkdir(parents=True)
    schema = {"type": "struct", "fields": [{"name": "id", "type": "integer", "nullable": True, "metadata": {}}, {"name": "v", "type": "string", "nullable": True, "metadata": {}}, {"name": "p", "type": "string", "nullable": True, "metadata": {}}]}
    import pyarrow as pa
    import pyarrow.parquet as pq

    def data(name, ids):
        (root / name).parent.mkdir(exist_ok=True)
        pq.write_table(pa.table({"id": pa.array(ids, pa.int32()), "v": [f"v{i}" for i in ids]}), root / name)

    data("p=x/a b.parquet", [1, 2, 3])
    data("p=y/b.parquet", [4, 5])
    data("p=x/c.parquet", [6])
    vector = codecs.z85_encode((struct.pack("<I", 1681511377) + codecs.roaring64_encode([1])).ljust(40, b"\0"))
    add = lambda path, part, n, **more: {"add": {"path": path, "partitionValues": {"p": part}, "size": 100 * n, "modificationTime": 1, "dataChange": True, "stats": json.dumps({"numRecords": n}), **more}}
    commits = [
        [{"protocol": {"minReaderVersion": 3, "minWriterVersion": 7}}, {"metaData": {"id": "m", "schemaString": json.dumps(schema), "partitionColumns": ["p"], "configuration": {}}}, add("p=x/a%20b.parquet", "x", 3), add("p=y/b.parquet", "y", 2), {"commitInfo": {"timestamp": 1000, "operation": "WRITE", "operationMetrics": {"numFiles": "2", "numOutputRows": "6"}}}],
        [{"remove": {"path": "p=y/b.parquet", "deletionTimestamp": 5, "dataChange": True}}, add("p=x/c.parquet", "x", 1), {"commitInfo": {"timestamp": 2000, "operation": "WRITE"}}],
        [{"remove": {"path": "p=x/a%20b.parquet", "dataChange": True}}, add("p=x/a%20b.parquet", "x", 3, deletionVector={"storageType": "i", "pathOrInlineDv": vector, "sizeInBytes": 40, "cardinality": 1}), {"txn": {"appId": "app", "version": 7}}, {"commitInfo": {"timestamp": 3000, "operation": "DELETE"}}],
    ]
    for k, actions in enumerate(commits):
        (root / "_delta_log" / f"{k:020}.json").write_text("\n".join(json.dumps(a) for a in actions))
    return str(root)


def test_log_table(spark, log_table):
    table = open_table(spark, log_table)
    assert table.format == files.DELTA and files.tables(spark, log_table.rsplit("/", 1)[0]) == {log_table: files.DELTA}
    assert {r.path for r in table.live_files(0).collect()} == {"p=x/a b.parquet", "p=y/b.parquet"}
    assert {r.path for r in table.live_files().collect()} == {"p=x/a b.parquet", "p=x/c.parquet"}
    assert {tuple(r) for r in table.rows(0).collect()} == {(1, "v1", "x"), (2, "v2", "x"), (3, "v3", "x"), (4, "v4", "y"), (5, "v5", "y")}
    assert {tuple(r) for r in table.rows().collect()} == {(1, "v1", "x"), (3, "v3", "x"), (6, "v6", "x")}
    assert {r.id for r in table.lookup("id > 1 AND p = 'x'").collect()} == {3, 6}
    assert table.as_of(2500) == 1 and table.as_of(10) is None
    assert {r.figure: r.value for r in table.summary().collect()}["files"] == "2"
    found = table.check().filter("verdict = 'DIFFERS'").collect()
    assert [(r.place, r.figure, r.recorded, r.counted) for r in found] == [("0", "added_rows", "6", "5")]
    assert [(r.appId, r.version) for r in delta.transactions(delta.commits(spark, log_table)).collect()] == [("app", 7)]
    assert {(r.version, r.change_type) for r in table.changes(1, 1).collect()} == {(1, "insert"), (1, "delete")}
    assert "p=y/b.parquet" in {r.path for r in table.plan("vacuum", 10**15, retain_ms=0, partitions=["p"]).collect()}
    assert table.plan("expire", 10**9, least=1, most=2).filter("expired").count() >= 1


@pytest.mark.parametrize("word", ["TIMESTAMP", "timestamp_ntz", "Timestamp_LTZ"])
def test_timestamp_literals(word):
    assert parse(f"t >= {word} '2000-01-01 00:00:00'") == parse("t >= timestamp '2000-01-01 00:00:00'")


def test_lookup_with_fates(spark, log_table):
    table = open_table(spark, log_table)
    got = {(r.id, r._file, r._pos, r._fate) for r in table.fates("id >= 2 AND p = 'x'").collect()}
    assert got == {(2, "p=x/a b.parquet", 1, "DELETED_BY_VECTOR"), (3, "p=x/a b.parquet", 2, "LIVE"), (6, "p=x/c.parquet", 0, "LIVE")}
    assert {(r.path, r.skipped) for r in table.scan_plan("p = 'y'", 0).collect()} == {("p=x/a b.parquet", True), ("p=y/b.parquet", False)}
    assert table.fates("p = 'nowhere'").count() == 0


@pytest.fixture
def cleaned_table(spark, tmp_path):
    """Version 1 is a checkpoint, commits 0 and 1 are gone; files of one name in two folders, one told by its whole path,
    and two files whose vectors share a file."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    root = tmp_path / "cleaned t"
    (root / "_delta_log").mkdir(parents=True)
    (root / "sub").mkdir()
    for name, ids in (("x.parquet", [1, 2]), ("sub/x.parquet", [3, 4]), ("sub/[a]%20b.parquet", [5, 6, 7]), ("gone.parquet", [99])):
        pq.write_table(pa.table({"id": pa.array(ids, pa.int64()), "path": [str(i) for i in ids]}), root / name)
    schema = {"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("id", "long"), ("path", "string"))]}
    blobs, at = b"\x01", {}
    for name, dead in (("x", [0]), ("sub", [1])):
        body = struct.pack("<I", 1681511377) + codecs.roaring64_encode(dead)
        at[name] = (len(blobs), len(body))
        blobs += struct.pack(">I", len(body)) + body + struct.pack(">I", zlib.crc32(body))
    name = uuid.uuid4()
    (root / f"deletion_vector_{name}.bin").write_bytes(blobs)
    vector = lambda k: {"storageType": "u", "pathOrInlineDv": codecs.z85_encode(name.bytes), "offset": at[k][0], "sizeInBytes": at[k][1], "cardinality": 1}
    add = lambda path, least, most, **more: {"add": {"path": path, "partitionValues": {}, "size": 1, "dataChange": True, "stats": json.dumps({"numRecords": 2, "minValues": {"id": least}, "maxValues": {"id": most}, "nullCount": {"id": 0}}), **more}}
    base = [{"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}, {"metaData": {"id": "m", "schemaString": json.dumps(schema), "partitionColumns": [], "configuration": {}}}, add("x.parquet", 1, 2), add("gone.parquet", 99, 99)]
    rows = spark.createDataFrame([(json.dumps(a),) for a in base], "j string").select(F.from_json("j", delta.ACTIONS).alias("a")).select("a.*")
    rows.coalesce(1).write.parquet(str(tmp_path / "cp"))
    next((tmp_path / "cp").glob("part-*")).rename(root / "_delta_log" / f"{1:020}.checkpoint.parquet")
    (root / "_delta_log" / f"{2:020}.checkpoint.{1:010}.{2:010}.parquet").write_bytes(b"")  # a part is missing
    later = [
        [{"remove": {"path": "gone.parquet", "dataChange": True}}, add("sub/x.parquet", 3, 4, deletionVector=vector("sub")), {"commitInfo": {"timestamp": 1}}],
        [{"remove": {"path": "x.parquet", "dataChange": True}}, add("x.parquet", 1, 2, deletionVector=vector("x")), add("file://" + urllib.parse.quote(f"{root}/sub/[a]%20b.parquet"), 5, 7), {"commitInfo": {"timestamp": 2}}],
    ]
    for k, actions in enumerate(later, 2):
        (root / "_delta_log" / f"{k:020}.json").write_text("\n".join(json.dumps(a) for a in actions))
    return str(root)


def test_checkpoint_and_later_commits(spark, cleaned_table):
    table = open_table(spark, cleaned_table)
    assert sorted(tuple(r) for r in table.rows(1).collect()) == [(1, "1"), (2, "2"), (99, "99")]
    assert sorted(tuple(r) for r in table.rows(2).collect()) == [(1, "1"), (2, "2"), (3, "3")]
    assert sorted(tuple(r) for r in table.rows().collect()) == [(2, "2"), (3, "3"), (5, "5"), (6, "6"), (7, "7")]
    assert {(r.id, r._fate) for r in table.fates("id < 4").collect()} == {(1, "DELETED_BY_VECTOR"), (2, "LIVE"), (3, "LIVE")}
    assert {r.path.rsplit("/", 1)[-1] for r in table.scan_plan("id >= 5").filter("NOT skipped").collect()} == {"[a]%20b.parquet"}
    for version in (0, 7):
        with pytest.raises(ValueError, match="can't be read"):
            table.rows(version)


def test_metadata_tables(spark, tmp_path):
    root = tmp_path / "i"
    (root / "metadata").mkdir(parents=True)
    entry = {"type": "record", "name": "manifest_entry", "fields": [{"name": "status", "type": "int"}, {"name": "snapshot_id", "type": ["null", "long"]}, {"name": "sequence_number", "type": ["null", "long"]}, {"name": "data_file", "type": {"type": "record", "name": "f", "fields": [{"name": "content", "type": "int"}, {"name": "file_path", "type": "string"}, {"name": "file_format", "type": "string"}, {"name": "partition", "type": {"type": "record", "name": "p", "fields": []}}, {"name": "record_count", "type": "long"}, {"name": "file_size_in_bytes", "type": "long"}]}}]}
    row = lambda status, path: {"status": status, "snapshot_id": 1, "sequence_number": None, "data_file": {"content": 0, "file_path": path, "file_format": "PARQUET", "partition": {}, "record_count": 5, "file_size_in_bytes": 50}}
    (root / "metadata/m0.avro").write_bytes(avro.write_records(entry, [row(1, "a"), row(0, "b"), row(2, "c")]))
    listed = {"type": "record", "name": "manifest_file", "fields": [{"name": "manifest_path", "type": "string"}, {"name": "manifest_length", "type": "long"}, {"name": "content", "type": "int"}]}
    (root / "metadata/snap-1.avro").write_bytes(avro.write_records(listed, [{"manifest_path": f"{root}/metadata/m0.avro", "manifest_length": 10, "content": 0}]))
    meta = {"format-version": 2, "last-column-id": 3, "last-sequence-number": 1, "current-snapshot-id": 1, "snapshots": [{"snapshot-id": 1, "sequence-number": 1, "timestamp-ms": 9, "manifest-list": f"{root}/metadata/snap-1.avro", "summary": {"operation": "append"}}], "snapshot-log": [{"timestamp-ms": 9, "snapshot-id": 1}], "refs": {"main": {"snapshot-id": 1, "type": "branch"}}, "schemas": [{"schema-id": 0, "fields": [{"id": 1, "name": "a", "required": True, "type": "int"}, {"id": 2, "name": "b", "required": False, "type": "string"}]}]}
    (root / "metadata/v1.metadata.json").write_text(json.dumps(meta))
    table = open_table(spark, str(root))
    assert table.format == files.ICEBERG and {r.path for r in table.live_files().collect()} == {"a", "b"}
    assert [(r.figure, r.verdict) for r in table.check().orderBy("figure").collect()] == [("last-column-id", "DIFFERS"), ("last-sequence-number", "AGREES")]
    newest = iceberg.newest(spark, str(root))
    assert newest.first().version == 1 and iceberg.refs(newest).first().ref == "main" and iceberg.snapshot_log(newest).first().snapshot_id == 1
    assert iceberg.resolve("/gone/data/x.parquet", "/t", lambda p: False) == ("/t/data/x.parquet", "RELATIVE")
    assert iceberg.name_mapping('[{"names": ["s", "t"], "field-id": 1, "fields": [{"names": ["x"], "field-id": 2}]}]') == {"s": 1, "s.x": 2, "t": 1, "t.x": 2}


def test_snapshot_documents(spark, tmp_path):
    root = tmp_path / "p"
    for folder in ("snapshot", "schema", "consumer"):
        (root / folder).mkdir(parents=True)
    for k in (1, 2):
        (root / f"snapshot/snapshot-{k}").write_text(json.dumps({"id": k, "schemaId": 0, "timeMillis": k * 100, "commitKind": "APPEND", "totalRecordCount": k}))
    (root / "schema/schema-0").write_text(json.dumps({"id": 0, "fields": [{"id": 0, "name": "k", "type": "INT NOT NULL"}, {"id": 1, "name": "v", "type": "STRING"}], "highestFieldId": 5, "primaryKeys": ["k"], "options": {"merge-engine": "first-row"}}))
    (root / "consumer/consumer-c").write_text(json.dumps({"nextSnapshot": 2}))
    table = open_table(spark, str(root))
    assert table.format == files.PAIMON and merge.merge_rule(paimon.options(spark, str(root))).keep == "FIRST"
    assert paimon.as_of(paimon.snapshots(spark, str(root)), 150).first().id == 1 and paimon.consumers(spark, str(root)).first().nextSnapshot == 2
    assert [r.verdict for r in table.check().collect()] == ["DIFFERS"] and table.as_of(500) == 2
    assert files.detect(spark, str(tmp_path / "none")) == files.UNKNOWN
    with pytest.raises(ValueError):
        open_table(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        files.readable("x.csv")


def test_row_groups_and_listing(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"a": list(range(100))}), tmp_path / "a.parquet", row_group_size=30)
    got = files.row_groups(spark, [str(tmp_path / "a.parquet")]).orderBy("row_group").collect()
    assert [r.rows for r in got] == [30, 30, 30, 10] and got[0].start == 4
    assert files.listing(spark, str(tmp_path)).count() == 1
    assert [r.row_index for r in files.data_files(spark, [str(tmp_path / "a.parquet")]).orderBy("a").limit(3).collect()] == [0, 1, 2]


def test_change_stream(spark, tmp_path):
    from siltstone.streaming import changes

    schema = "k int, s long, kind int, v string"
    spark.createDataFrame([(1, 1, 0, "a"), (2, 2, 0, "b")], schema).write.parquet(str(tmp_path / "in/one"))
    spark.createDataFrame([(1, 3, 2, "c"), (2, 4, 3, "b")], schema).write.parquet(str(tmp_path / "in/two"))
    stream = changes.latest(changes.changes(spark, str(tmp_path / "in/*"), schema), "k", "s")
    query = stream.writeStream.format("memory").queryName("latest_changes").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r.k, r.kind, r.v) for r in spark.sql("SELECT * FROM latest_changes").collect()} == {(1, "+U", "c"), (2, "-D", "b")}


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    names, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 150
    assert math.isfinite(len(sql))


def test_imports_without_a_session():
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[0]) > 150


# ---- tables read end to end

TABLES = "/root/testdata/sf0.001"


def _oracle(name: str):
    import duckdb

    from siltstone.plans import registry

    con = duckdb.connect()
    for table in ("part", "nation", "events", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{TABLES}/{table}.parquet')")
    return sorted(con.execute(registry.oracle_sql()[name]).fetchall(), key=str)


@pytest.mark.parametrize("name", ["k2_fates_of_a_snapshot", "k1_lookup_in_a_snapshot", "k4_fates_of_a_keyed_table", "k9_lookup_in_a_keyed_table", "a20_keyed_manifests", "w13_history_tracks", "n7_layouts", "a32_partition_statistics_rows"])
def test_whole_tables_equal_sql(spark, name):
    from siltstone.plans import registry

    assert sorted((tuple(r) for r in registry.queries()[name](spark, TABLES).collect()), key=str) == _oracle(name)


def _events(spark, folder, users: int) -> str:
    """An events table of two rows a user and two without one."""
    own = spark.range(2 * users).select(F.col("id").alias("event_id"), (F.col("id") % users * 3 - 30).alias("user_id"), F.lit("view").alias("event_type"))
    own.union(spark.sql("SELECT -1L, CAST(NULL AS BIGINT), 'view' UNION ALL SELECT -2L, CAST(NULL AS BIGINT), 'view'")).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def _on_events(spark, folder: str, name: str) -> tuple[list, list]:
    import duckdb

    from siltstone.plans import registry

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    return sorted(map(tuple, registry.queries()[name](spark, folder).collect())), sorted(con.execute(registry.oracle_sql()[name]).fetchall())


def test_key_tuples_reach_every_key(spark, tmp_path):
    got, want = _on_events(spark, _events(spark, tmp_path, 500), "d12_key_tuples")
    assert got == want and max(k for k, _ in want) > 150 and min(k for k, _ in want) < 0


def _no_events(spark, folder) -> str:
    spark.createDataFrame([], "event_id long, user_id long, event_type string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("users", [0, 1, 20000])
def test_theta_sketches_count_exactly(spark, tmp_path, users):
    got, want = _on_events(spark, _events(spark, tmp_path, users) if users else _no_events(spark, tmp_path), "e18_theta_sketch")
    assert got == want == [(users, users)]


def test_a_container_of_many_keys_is_read_once(spark, tmp_path):
    import time

    n = 200_000  # keys of one file; its filter has 3.2 million bits
    spark.range(n).selectExpr("id * 16 - 1600 AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    from siltstone.plans import registry

    start = time.time()
    got = {tuple(r) for r in registry.queries()["a31_file_index_containers"](spark, str(tmp_path)).collect()}
    assert got == {(0, "p_partkey", "bloom-filter", False, n), (0, "p_partkey", "bitmap", True, 0), (0, "p_size", "bsi", False, 3)}
    assert time.time() - start < 60


def test_a_moved_table_is_read_where_it_is(spark, tmp_path):
    import shutil

    from siltstone.plans import snapshot_tables

    shutil.copytree(snapshot_tables.snapshot_table(spark, TABLES), tmp_path / "moved [x]")
    want = open_table(spark, snapshot_tables.snapshot_table(spark, TABLES)).fates("p_partkey > 0")
    got = open_table(spark, str(tmp_path / "moved [x]")).fates("p_partkey > 0")
    pick = lambda rows: sorted((r.p_partkey, r._fate) for r in rows.collect())
    assert pick(got) == pick(want) and len({f for _, f in pick(got)}) >= 3
    with pytest.raises(ValueError, match="no snapshot"):
        open_table(spark, str(tmp_path / "moved [x]")).rows(99)


def test_bucket_vectors_and_containers_are_checked():
    data, ranges = codecs.bucket_vectors_encode([([0, 5, 70000], False), ([1, 1 << 33], True), ([], False)])
    assert [codecs.bucket_vector(data, *r).tolist() for r in ranges] == [[0, 5, 70000], [1, 1 << 33], []]
    at, n = ranges[0]
    for bad in ((b"\x02" + data[1:], at, n), (data, 0, n), (data, at, n + 1), (data[: at + 5], at, n), (data[: at + 9] + b"\xff" + data[at + 10 :], at, n)):
        with pytest.raises(ValueError):
            codecs.bucket_vector(*bad)
    box = {"a": [("bloom-filter", b"12345"), ("bitmap", None)], "é": []}
    assert codecs.file_index(codecs.file_index_encode(box)) == box
    with pytest.raises(ValueError):
        codecs.file_index(b"\0" * 40)
    with pytest.raises(ValueError):
        codecs.file_index(codecs.file_index_encode(box)[:-2])


@pytest.mark.parametrize("codec", ["null", "deflate", "bzip2", "xz", "zstandard"])
def test_transcoding_keeps_records(codec):
    schema = {"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": ["null", "string"]}]}
    rows = [{"a": k, "b": None if k % 3 else "x" * k} for k in range(50)]
    packed = avro.transcode(avro.write_records(schema, rows, "deflate"), codec)
    assert [r for r, _ in avro.records(packed)] == rows == [r for r, _ in avro.records(avro.transcode(packed))]


def test_tracks_follow_the_older_line(spark):
    own = spark.createDataFrame([(1, None, 1, 1), (2, 1, 9, 5), (3, 1, 3, 3), (4, 3, 4, 4), (9, 77, 8, 8)], "snapshot_id long, parent_id long, at_ms long, sequence long")
    tips = spark.createDataFrame([("main", 2, None), ("dev", 4, 2)], "branch string, snapshot_id long, made long")
    assert {r.snapshot_id: r.track for r in history.tracks(own, tips).collect()} == {1: 0, 2: 0, 3: 1, 4: 1, 9: 2}


def test_partial_updates_are_read(spark, tmp_path):
    from siltstone.functions import binary_row
    from siltstone.plans import snapshot_tables as st_

    root = str(tmp_path / "t")
    rows = [(1, 0, 7, 10, None), (2, 0, 7, None, "b"), (3, 3, 8, None, None), (4, 0, 9, 1, "c")]
    spark.createDataFrame(rows, "_SEQUENCE_NUMBER long, _VALUE_KIND byte, k long, a long, b string").coalesce(1).write.parquet(f"{root}/bucket-0")
    name = next(n for n in files.names(spark, f"{root}/bucket-0") if n.endswith(".parquet"))
    row, none = binary_row.encode([], []), {"_MIN_VALUES": b"", "_MAX_VALUES": b"", "_NULL_COUNTS": []}
    file = {"_FILE_NAME": name, "_FILE_SIZE": 1, "_ROW_COUNT": 4, "_MIN_KEY": row, "_MAX_KEY": row, "_KEY_STATS": none, "_VALUE_STATS": none, "_MIN_SEQUENCE_NUMBER": 1, "_MAX_SEQUENCE_NUMBER": 4, "_SCHEMA_ID": 0, "_LEVEL": 0}
    files.put(spark, f"{root}/manifest/m", avro.write_records(st_._ACT, [{"_KIND": 0, "_PARTITION": row, "_BUCKET": 0, "_TOTAL_BUCKETS": 1, "_FILE": file}]))
    files.put(spark, f"{root}/manifest/base", avro.write_records(st_._MANIFEST, [{"_FILE_NAME": "m", "_FILE_SIZE": 1, "_NUM_ADDED_FILES": 1, "_NUM_DELETED_FILES": 0, "_SCHEMA_ID": 0}]))
    fields = [{"id": 0, "name": "k", "type": "BIGINT NOT NULL"}, {"id": 1, "name": "a", "type": "BIGINT"}, {"id": 2, "name": "b", "type": "STRING"}]
    files.put(spark, f"{root}/schema/schema-0", json.dumps({"id": 0, "fields": fields, "primaryKeys": ["k"], "options": {"merge-engine": "partial-update", "ignore-delete": "true"}}).encode())
    files.put(spark, f"{root}/snapshot/snapshot-1", json.dumps({"id": 1, "schemaId": 0, "baseManifestList": "base", "timeMillis": 1}).encode())
    table = open_table(spark, root)
    assert sorted(tuple(r) for r in table.rows().collect()) == [(7, 10, "b"), (9, 1, "c")]
    assert [tuple(r) for r in table.lookup("a = 10 AND b = 'b'").collect()] == [(7, 10, "b")]
    assert table.scan_plan("k > 100").first().skipped is False and table.summary().count() == 6


def test_remote_folder_over_http(spark):
    """The bundled WebHDFS client against a small server: listing, globbing and reading need nothing of this engine's own."""
    import http.server
    import threading

    body = b'{"id": 3, "timeMillis": 5}'

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            path, _, query = self.path.partition("?")
            op = dict(x.partition("=")[::2] for x in query.split("&"))["op"].upper()
            inner = path.removeprefix("/webhdfs/v1").rstrip("/")
            status = lambda name, kind: {"accessTime": 0, "blockSize": 1, "group": "g", "length": len(body) if kind == "FILE" else 0, "modificationTime": 0, "owner": "o", "pathSuffix": name, "permission": "644", "replication": 1, "type": kind, "fileId": 1, "childrenNum": 0}
            is_file = inner.endswith("snapshot-3")
            if op == "OPEN":
                reply = body
            elif op == "GETFILESTATUS":
                reply = json.dumps({"FileStatus": status("", "FILE" if is_file else "DIRECTORY")}).encode()
            else:
                reply = json.dumps({"FileStatuses": {"FileStatus": [status("snapshot-3", "FILE")] if inner.endswith("/snapshot") else []}}).encode()
            self.send_response(200)
            self.send_header("Content-Type", "application/octet-stream" if op == "OPEN" else "application/json")
            self.send_header("Content-Length", str(len(reply)))
            self.end_headers()
            self.wfile.write(reply)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        root = f"webhdfs://127.0.0.1:{server.server_port}/t"
        assert files.names(spark, f"{root}/snapshot") == ["snapshot-3"]
        assert [n for _, n in files.glob(spark, f"{root}/snapshot/snapshot-*")] == [len(body)]
        stream = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/snapshot/snapshot-3")
        found = stream.getFileSystem(spark._jsc.hadoopConfiguration()).open(stream)
        assert bytes(found.readNBytes(100)) == body
    finally:
        server.shutdown()
