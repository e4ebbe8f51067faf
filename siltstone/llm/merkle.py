"""Document fingerprints: a Merkle tree over paragraphs and sections.

A text's paragraphs are its lines. A paragraph's leaves are cut by content: behind every byte at which a hash of the last
`REACH` bytes is greater than at all places within `RADIUS` bytes (`FINE` bytes in a text's first `START`, so that short texts
have leaves to compare). So an insertion changes the leaves around it and no others. A section ends with an empty paragraph or
with one whose digest is divisible by eight, so that an edit moves no other section's borders. Each node's digest covers its
children's; the root also covers the length. Equal roots mean equal texts, and branches that differ locate the edits. The
serialized tree is

    root|section:paragraph=leaves,paragraph=leaves;section:...

with 32 hex digits for the root and 8 for every other node. Likeness is the share of common leaves (Dice, with repeats), found
by descending: equal roots settle all, equal sections and then equal paragraphs settle all their leaves, and only what is left
of both trees is compared leaf by leaf. Two unequal texts without any leaf have likeness 0.

Comparing every document with the next by id: one range partitioning by id carries the compressed texts; every partition
handles its own neighbours in one pass and hands out its first and last document, and those borders, two for each
partition, are joined afterwards. Rows that repeat an id are ordered by a hash of their text,
and a hot id, null included, is spread over partitions by it.

Defined results: a null text is empty; a null id comes first; a single document is its own next one; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import id_or_least, store, text_or_empty

SECTION_EVERY, REACH, FINE, RADIUS, START = 8, 6, 3, 16, 256
_BYTE = np.random.default_rng(11).integers(0, 1 << 32, 256, np.uint32)

#: A section's digest, its leaves' number and its paragraphs; a paragraph's digest and its leaves' digests.
Section = tuple[str, int, list[tuple[str, list[str]]]]


def leaf_ends(data: np.ndarray) -> np.ndarray:
    """Ends of the leaves of a text's bytes, those of the paragraphs aside."""
    n = len(data)
    at = np.arange(n, dtype=np.int32)
    breaks = data == 10
    starts = np.zeros(n, np.int32)
    starts[1:] = np.where(breaks[:-1], at[1:], 0)
    left = at - np.maximum.accumulate(starts)  # bytes before, in the line
    ends = np.where(breaks, at, n)
    right = np.minimum.accumulate(ends[::-1])[::-1] - at - 1  # bytes behind
    own = _BYTE[data]
    h, factor = own.copy(), 1
    for j in range(1, min(REACH, n)):
        factor = factor * 0x9E3779B1 & 0xFFFFFFFF
        h[j:] += own[:-j] * np.uint32(factor) * (left[j:] >= j)
    h[breaks] = 0

    def peaks(radius: int, stop: int) -> np.ndarray:
        """Whether a place's hash is greater than those of the radius before it and no less than those behind it."""
        h_, top = h[:stop], (left[:stop] >= radius) & (right[:stop] >= radius)
        before, behind, reach = h_.copy(), h_.copy(), 1  # the greatest of `reach` places that end or begin here
        while reach < radius:
            step = min(reach, radius - reach)
            before[step:] = np.maximum(before[step:], before[:-step].copy())
            behind[:-step] = np.maximum(behind[:-step], behind[step:].copy())
            reach += step
        top[1:] &= h_[1:] > before[:-1]
        top[:-1] &= h_[:-1] >= behind[1:]
        top[:1] = False
        top[-1:] = False
        return top

    out = peaks(RADIUS, n)
    out[:START] = peaks(FINE, min(n, START + FINE + 1))[:START]
    return np.flatnonzero(out) + 1


def tree(text: str) -> tuple[str, list[Section]]:
    """The serialized tree, and its sections."""
    hashed = xxhash.xxh3_128_digest
    data = text.encode()
    inner = leaf_ends(np.frombuffer(data, np.uint8)).tolist() if data else []
    sections, out, top, digests, paragraphs, count = [], [], [], [], [], 0
    at, k = 0, 0
    lines = data.split(b"\n")
    for number, line in enumerate(lines):
        end = at + len(line)
        leaves = []
        while k < len(inner) and inner[k] < end:
            leaves.append(hashed(data[at : inner[k]]))
            at = inner[k]
            k += 1
        if at < end:
            leaves.append(hashed(data[at:end]))
        at = end + 1
        labels = [d[:4].hex() for d in leaves]
        own = hashed(b"".join(leaves))
        digests.append(own)
        paragraphs.append((own[:4].hex(), labels))
        count += len(labels)
        if not line or own[-1] % SECTION_EVERY == 0 or number == len(lines) - 1:
            own = hashed(b"".join(digests))
            top.append(own)
            sections.append((own[:4].hex(), count, paragraphs))
            out.append(own[:4].hex() + ":" + ",".join(p + "=" + "".join(labels) for p, labels in paragraphs))
            digests, paragraphs, count = [], [], 0
    root = hashed(b"".join(top) + len(text).to_bytes(8, "little"))
    return f"{root.hex()}|{';'.join(out)}", sections


def _left_over(a: list, b: list) -> tuple[int, list, list]:
    """Leaves under the nodes (digest, number of leaves, children) that a and b have in common, and the other nodes of each."""
    spare = Counter(x[0] for x in b)
    common, rest = 0, []
    taken: Counter = Counter()
    for node in a:
        if spare[node[0]] > taken[node[0]]:
            taken[node[0]] += 1
            common += node[1]
        else:
            rest.append(node)
    other = []
    for node in b:
        if taken[node[0]]:
            taken[node[0]] -= 1
        else:
            other.append(node)
    return common, rest, other


def likeness(a: tuple[str, list[Section]], b: tuple[str, list[Section]]) -> float:
    """Dice likeness of the leaves of two trees."""
    if a[0][:32] == b[0][:32]:
        return 1.0
    total = sum(n for _, n, _ in a[1]) + sum(n for _, n, _ in b[1])
    common, left, right = _left_over(a[1], b[1])
    below = lambda nodes: [(d, len(leaves), leaves) for _, _, paragraphs in nodes for d, leaves in paragraphs]
    more, left, right = _left_over(below(left), below(right))
    leaves = lambda nodes: [(x, 1, None) for _, _, own in nodes for x in own]
    last, _, _ = _left_over(leaves(left), leaves(right))
    return 2 * (common + more + last) / total if total else 0.0


def read(fingerprint: str) -> tuple[str, list[Section]]:
    """A serialized tree and its sections, as tree() gives them."""
    sections = []
    for section in fingerprint.split("|", 1)[1].split(";"):
        digest, own = section.split(":", 1)
        paragraphs = []
        for paragraph in own.split(","):
            name, labels = paragraph.split("=", 1)
            paragraphs.append((name, [labels[i : i + 8] for i in range(0, len(labels), 8)]))
        sections.append((digest, sum(len(x) for _, x in paragraphs), paragraphs))
    return fingerprint, sections


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of b, counted from 0, that a doesn't hold at all; empty if the roots are equal."""
    if a.split("|", 1)[0] == b.split("|", 1)[0]:
        return []
    known = {s for s in a.split("|", 1)[1].split(";")}
    paragraphs = {p.split("=", 1)[0] for s in known for p in s.split(":", 1)[1].split(",")}
    out = []
    for k, section in enumerate(b.split("|", 1)[1].split(";")):
        if section not in known:
            out += [(k, i) for i, p in enumerate(section.split(":", 1)[1].split(",")) if p.split("=", 1)[0] not in paragraphs]
    return out


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(doc: object, text: str, own: tuple[str, list[Section]], following: str, next_tree: tuple[str, list[Section]]) -> dict:
    edited = edited_text(text, following)
    changed = own if edited == text else tree(edited)
    return {
        "doc_id": doc, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(), "fingerprint": own[0],
        "edited_fingerprint": changed[0], "near_edited": likeness(own, changed), "near_next": likeness(own, next_tree),
    }


ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
NAMES = [c.split()[0] for c in ROWS.split(", ")]
BORDER = "part int, first binary, last binary, last_id long"


def _batch(rows: list[dict], part: int | None = None, first: bytes | None = None, last: bytes | None = None, last_id: int | None = None) -> pa.RecordBatch:
    n = len(rows)
    columns = [pa.array([r.get(c) for r in rows], k) for c, k in zip(NAMES, KINDS, strict=True)]
    extra = [pa.array([v] * n, k) for v, k in ((part, pa.int32()), (first, pa.binary()), (last, pa.binary()), (last_id, pa.int64()))]
    return pa.RecordBatch.from_arrays([*columns, *extra], [*NAMES, "part", "first", "last", "last_id"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([press.compress(t) for t in batch.column(3).to_pylist()], pa.binary())], ["doc_id", "did", "h", "text"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition's rows but the last one, then a border record with its first and last text."""
    press = zstandard.ZstdDecompressor()
    before, first, rows, last = None, None, [], None
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            plain = press.decompress(text).decode()
            own = tree(plain)
            if before is None:
                first = text
            else:
                rows.append(_row(*before, plain, own))
            before, last = (doc, plain, own), text
            if len(rows) >= 2000:
                yield _batch(rows)
                rows = []
    if rows:
        yield _batch(rows)
    if before is not None:
        yield _batch([{}], TaskContext.get().partitionId(), first, last, before[0])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for doc, text, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text, following = press.decompress(text).decode(), press.decompress(following).decode()
            rows.append(_row(doc, text, tree(text), following, tree(following)))
        if rows:
            yield pa.RecordBatch.from_arrays(_batch(rows).columns[: len(NAMES)], NAMES)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row for each document: its fingerprint, that of its edited text, and their likeness."""
    text = text_or_empty()
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_or_least().alias("did"), F.xxhash64(text).alias("h"), text.cast("binary").alias("text")).mapInArrow(_packed, "doc_id long, did long, h long, text binary")
    ordered = packed.repartitionByRange("did", "h").sortWithinPartitions("did", "h", "text").select("doc_id", "text")
    rows = store(ordered.mapInArrow(_neighbours, f"{ROWS}, {BORDER}"), "merkle-rows")
    borders = rows.filter(F.col("part").isNotNull())
    parts = sorted(r.part for r in borders.select("part").collect())  # a number for each partition
    spark = docs.sparkSession
    following = spark.createDataFrame([(p, parts[(k + 1) % len(parts)]) for k, p in enumerate(parts)], "part int, following int")
    last = borders.select("part", "last_id", "last").join(following, "part")
    ends = last.join(borders.select(F.col("part").alias("following"), "first"), "following").select("last_id", "last", "first")
    return rows.filter(F.col("part").isNull()).select(*NAMES).unionAll(ends.mapInArrow(_joined, ROWS))
