"""SimHash near-dedup with a bit-sliced comparison.

Fingerprints: words are lower-cased (A-Z), four-word shingles with repeats are hashed by XXH64 with seed 42, and a bit is
set if more than half of the hashes have it. Equal fingerprints collapse to one class before anything is compared.

Links: two fingerprints within `radius` bits agree on all of at least one choice of blocks once the 64 bits are cut into
more blocks than the radius (pigeonhole), so each class goes to one bucket for each choice. The number of blocks follows
the number of classes, which only moves work between buckets and keys; every choice finds every link. A bucket above
`CHUNK` classes is cut into chunks and each pair of chunks is a task of its own, so no task grows with a hot bucket. In a
task the classes' bits are stored as vertical planes of 64 lanes; distances of 64 lanes to a query are counted at once by
carry-save adders over the planes, and a block of lanes is abandoned as soon as all its lanes exceed the radius. A task
emits a spanning forest of its links, never all pairs.

Components: alternating large-star and small-star rounds over the links, as joins and partial aggregates, each round
written to the shared folder.

Defined results: a null or empty text has fingerprint zero, linked like any other; repeated rows share a class; a null id
is never a component id unless the whole component has null ids; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import remove, store, text_hashes, text_or_empty

RADIUS, SHINGLE, CHUNK = 4, 4, 2048


# ---- fingerprints


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # bytes: A-Z and [\x20\x09-\x0D] only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    else:
        digest = xxhash.xxh64_intdigest
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        hashes = np.fromiter((digest(line[a:b], 42) for a, b in spans), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[part : part + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, hashed: bool = False) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. hashed: and the text's hashes, h1 and h2."""
    carried = ["h1", "h2"] if hashed else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], ["doc_id", "fp", *carried])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"), *(text_hashes() if hashed else []))
    return texts.mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", "fp", *carried]))


# ---- buckets


def blocks_for(n: int, radius: int) -> list[list[int]]:
    """The bit lists of the keys: choices of blocks - radius of the blocks, so that a bucket holds few random classes."""
    need = max(8.0, math.log2(max(n, 2)) - 6)
    for blocks in range(radius + 1, 17):
        width = 64 // blocks
        if width * (blocks - radius) >= need:
            break
    edges = [round(k * 64 / blocks) for k in range(blocks + 1)]
    return [[b for k in chosen for b in range(edges[k], edges[k + 1])] for chosen in combinations(range(blocks), blocks - radius)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


# ---- bit-sliced comparison


def near_lanes(fps: np.ndarray, owner: np.ndarray, word: np.ndarray, planes: np.ndarray, radius: int, order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For work items (query fps[owner[i]] against the 64 lanes of word[i]): the items that still have near lanes, and the
    lanes as bits. planes[b][w]: bit b of the 64 fingerprints of lane word w."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    live = np.arange(len(owner))
    count_bits = (radius + 1).bit_length()
    counters = [np.zeros(len(owner), np.uint64) for _ in range(count_bits)]  # carry-save: bit k of every lane's distance
    over = np.zeros(len(owner), np.uint64)  # lanes above the counters' range
    query, lanes = fps[owner], word
    for step, b in enumerate(order):
        bit = (query >> np.uint64(b)) & np.uint64(1)
        carry = planes[b][lanes] ^ (np.uint64(0) - bit)
        for k in range(count_bits):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if step % 8 == 7 or step == len(order) - 1:
            far = over | _exceeds(counters, radius, full)
            left = far != full
            if step == len(order) - 1 or left.mean() < 0.7:  # abandon blocks all of whose lanes exceed the radius
                live, query, lanes, over = live[left], query[left], lanes[left], over[left]
                counters = [c[left] for c in counters]
                far = far[left]
    return live, ~far


def _exceeds(counters: list[np.ndarray], radius: int, full: np.uint64) -> np.ndarray:
    """Lanes whose counted distance is above the radius: a bitwise comparison from the top bit down."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], full)
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above |= equal & counters[k]
            equal = equal & ~counters[k]
    return above


ITEMS = 1 << 17


def links_in(groups: list[np.ndarray], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning links (least member, other member) of each group of distinct uint64 fingerprints; groups are compared
    together to keep the vectors long."""
    sizes = np.array([len(g) for g in groups])
    words = (sizes + 63) // 64
    first_word = np.concatenate([[0], np.cumsum(words)])
    first_fp = np.concatenate([[0], np.cumsum(sizes)])
    fps = np.concatenate(groups)
    padded = np.zeros(int(first_word[-1]) * 64, np.uint64)
    used = np.zeros(len(padded), bool)
    for k, g in enumerate(groups):
        at = int(first_word[k]) * 64
        padded[at : at + len(g)] = g
        used[at : at + len(g)] = True
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.reshape(-1, 64, 64).transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]
    in_use = np.packbits(used.reshape(-1, 64), axis=1, bitorder="little").view("<u8")[:, 0]
    same = np.zeros(64)
    for b in range(64):
        same[b] = np.abs(2 * bits[used, b].mean() - 1) if len(fps) else 0
    order = np.argsort(same).tolist()  # planes that differ most come first, so that blocks are abandoned early
    owner = np.repeat(np.arange(len(fps)), np.repeat(words, sizes))
    start = np.repeat(np.repeat(first_word[:-1], sizes), np.repeat(words, sizes))
    within = np.arange(len(owner)) - np.repeat(np.cumsum(np.repeat(words, sizes)) - np.repeat(words, sizes), np.repeat(words, sizes))
    word = start + within
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    lane_fp = np.zeros(len(padded), np.int64)
    lane_fp[used] = np.arange(len(fps))
    for part in range(0, len(owner), ITEMS):
        own, wrd = owner[part : part + ITEMS], word[part : part + ITEMS]
        live, near = near_lanes(fps, own, wrd, planes, radius, order)
        near &= in_use[wrd[live]]
        for i in np.flatnonzero(near).tolist():
            a = int(own[live[i]])
            lanes = np.flatnonzero(np.unpackbits(near[i : i + 1].astype("<u8").view(np.uint8), bitorder="little"))
            root = find(a)
            for b in lane_fp[int(wrd[live[i]]) * 64 + lanes].tolist():
                if b > a and (other := find(b)) != root:
                    low, high = min(root, other), max(root, other)
                    parent[high] = root = low
    return [(int(fps[find(x)]), int(fps[x])) for x in list(parent) if find(x) != x]


def _pair_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (task, fp) sorted by task; compares each task's fingerprints."""
    pending: list[np.ndarray] = []
    rest_task, rest = None, np.array([], np.int64)

    def flush() -> Iterator[pa.RecordBatch]:
        found = np.array(links_in(pending, radius) if pending else [], np.uint64).reshape(-1, 2).astype(np.int64)
        pending.clear()
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    def close(values: np.ndarray) -> None:
        distinct = np.unique(values)
        if len(distinct) > 1:
            pending.append(distinct.astype(np.uint64))

    for batch in batches:
        if not batch.num_rows:
            continue
        tasks, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero(np.diff(tasks)) + 1
        for at, piece in zip([0, *cuts.tolist()], np.split(fps, cuts), strict=True):
            if rest_task == tasks[at]:
                rest = np.concatenate([rest, piece])
            else:
                close(rest)
                rest_task, rest = tasks[at], piece
            if sum(map(len, pending)) > 16 * CHUNK:
                yield from flush()
    close(rest)
    yield from flush()


def links(classes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """classes: stored distinct fp. (a, b): links that connect what is within the radius."""
    keys = blocks_for(classes.count(), radius)
    masks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(_mask(bits)).cast("long").alias("mask")) for k, bits in enumerate(keys)])
    rows = classes.select("fp", F.explode(masks).alias("m")).select("fp", F.xxhash64(F.col("m.k"), F.col("fp").bitwiseAND(F.col("m.mask"))).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = rows.join(sizes, "bucket").withColumn("chunks", F.ceil(F.col("n") / chunk))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    rows = rows.select("fp", "bucket", own.alias("own"), other.alias("other"))
    task = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select(task.alias("task"), "fp")
    dealt = rows.repartition(F.col("task")).sortWithinPartitions("task")
    return dealt.mapInArrow(lambda batches: _pair_links(batches, radius), "a long, b long")


# ---- connected components


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): alternating large-star and small-star."""
    spark = edges.sparkSession
    now = store(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        # large-star: every larger neighbour of a node is linked to the node's least neighbour
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: a node's smaller neighbours and itself are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        new = store(small, "links")
        same = now.count() == new.count() and now.exceptAll(new).isEmpty()
        remove(spark, now._stored_at)
        now = new
        if same:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def class_roots(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """classes (fp, ...) with the root of each one's component."""
    roots = components(links(classes.select("fp"), radius))
    return classes.join(roots, classes.fp == roots.node, "left").select(*classes.columns, F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs."""
    rows = store(fingerprints(docs, shingle), "fingerprints")
    classes = store(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    named = class_roots(classes, radius)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(ids, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, h1, h2), the id and text hashes of one row of each component: the smallest id, null last, then the hashes."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    rows = fingerprints(docs, shingle, hashed=True)
    classes = store(rows.groupBy("fp").agg(F.min(key).alias("least")), "fingerprint-classes")
    return class_roots(classes, radius).groupBy("root").agg(F.min("least").alias("least")).select("least.doc_id", "least.h1", "least.h2")
