"""Sharding by minimax contiguous partition, in DataFrame functions only.

Atomic groups (equal texts) are put in corpus order, by their least document id. Prefix sums over the order come in two
passes: totals for each of `RANGES` id ranges (a bounded number of rows, added up on the driver) and a running sum inside
each range. The smallest feasible shard capacity is found by binary search; each check walks the shards greedily, and a
step of the walk asks for the last group boundary at or before a position.

The driver never holds the groups. It holds a bounded summary of at most `BLOCKS` byte ranges with their first and last
boundary. A question between those two is answered by a lower and an upper bound, which gives a lower and an upper bound of
the capacity; then only the byte ranges that the walk may still touch are summarised again, finer. This ends with the
exact capacity and exact cuts, as if all sizes had been searched at once.

Within that capacity the cuts are moved as near as feasible to equal sizes: a cut may lie anywhere between the backward
and the forward greedy walk. A group larger than an equal share takes a shard of the least possible capacity.

Slots count rows of a shard in group order, then by id: rows before the group (prefix sums), before the id range inside
the group (hot groups are split by ranges) and inside that range.

Defined results: a null text counts as empty, so both are one group; a null id comes first; rows that repeat an id and a
text get slots of their own in either order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import id_or_least, store, text_or_empty

SHARDS, OVERHEAD, RANGES, BLOCKS = 40, 16, 200, 20_000


class Boundaries:
    """What the driver knows of the sorted group boundaries: blocks (first, last, number) of consecutive boundaries."""

    def __init__(self, groups: DataFrame, total: int, blocks: int = BLOCKS):
        self.groups, self.total, self.limit = groups, total, blocks
        self.known = [(0, 0, 1), (total, total, 1)]
        self.refine([(0, total)])

    def refine(self, spans: list[tuple[int, int]]) -> None:
        """Summarises the boundaries inside the spans again, in at most self.limit + len(spans) blocks."""
        width = max(1, -(-sum(b - a for a, b in spans) // self.limit))
        start = F.col("start")
        inside = F.lit(False)
        for a, b in spans:
            inside = inside | start.between(a, b)
        span = F.lit(0)
        for k, (a, _) in enumerate(spans):
            span = F.when(start >= a, F.lit(k)).otherwise(span)
        rows = self.groups.filter(inside).groupBy(span.alias("s"), F.floor(start / width).alias("b")).agg(F.min("start").alias("lo"), F.max("start").alias("hi"), F.count(F.lit(1)).alias("n")).collect()
        kept = [x for x in self.known if not any(a <= x[0] and x[1] <= b for a, b in spans)]
        fresh = [(r.lo, r.hi, r.n) for r in rows]
        self.known = sorted({(0, 0, 1), (self.total, self.total, 1), *kept, *fresh})
        self.firsts = [x[0] for x in self.known]

    def block(self, x: int) -> tuple[int, int, int]:
        return self.known[bisect_right(self.firsts, x) - 1]

    def before(self, x: int) -> tuple[int, int, tuple[int, int] | None]:
        """Bounds of the last boundary at or before x, and the block that hides it."""
        lo, hi, n = self.block(x)
        if x >= hi:
            return hi, hi, None
        return (lo, lo, None) if n <= 2 or lo == x else (lo, x, (lo, hi))

    def after(self, x: int) -> tuple[int, tuple[int, int] | None]:
        """The first boundary at or after x, if no block hides it."""
        lo, hi, n = self.block(x)
        if lo == x:
            return x, None
        if x <= hi:
            return hi, None if n <= 2 or x == hi else (lo, hi)
        return self.firsts[bisect_right(self.firsts, x)], None


def _walk(known: Boundaries, capacity: int, shards: int, upper: bool) -> list[int] | None:
    """The greedy cuts under the lower or upper bounds, ending in the total; None if the shards don't suffice."""
    cuts, at = [], 0
    for _ in range(shards):
        if at + capacity >= known.total:
            return [*cuts, known.total]
        low, high, _ = known.before(at + capacity)
        at = high if upper else low
        cuts.append(at)
    return None


def _least(known: Boundaries, lo: int, hi: int, shards: int, upper: bool) -> int:
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if _walk(known, mid, shards, upper) else (mid + 1, hi)
    return lo


def minimax_cuts(known: Boundaries, shards: int, largest: int, big: list[tuple[int, int]]) -> tuple[int, list[int]]:
    """The least capacity, and the cuts between the shards. big: (start, bytes) of groups above an equal share."""
    total = known.total
    floor_, top = max(-(-total // shards), largest), total
    while True:
        low = _least(known, floor_, top, shards, upper=True)
        high = _least(known, low, top, shards, upper=False)
        near, far = _walk(known, low, shards, upper=False) or [], _walk(known, high, shards, upper=True) or []
        hidden = set()
        if low < high:
            at_low = at_high = 0
            full = [0]
            for _ in range(shards):  # without stopping at infeasible walks
                full.append(known.before(min(total, full[-1] + low))[0])
            for k in range(shards):
                at_low, at_high = full[k], far[k - 1] if 0 < k <= len(far) else (0 if not k else total)
                a, b = min(total, at_low + low), min(total, at_high + high)
                first = max(0, bisect_right(known.firsts, a) - 1)
                for lo, hi, n in known.known[first : bisect_right(known.firsts, b)]:
                    if n > 2 and hi > a:
                        hidden.add((lo, hi))
        else:
            at = 0
            for _ in range(shards):
                if at + low >= total:
                    break
                answer, _, block = known.before(at + low)
                if block:
                    hidden.add(block)
                    break
                at = answer
        if not hidden:
            break
        floor_, top = low, high
        known.refine(_merged(hidden))
    capacity = high
    while True:  # the backward walk and the even targets need exact answers too
        cuts, hidden = _even_cuts(known, capacity, shards, big)
        if not hidden:
            return capacity, cuts
        known.refine(_merged(hidden))


def _merged(spans: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """At most 64 spans that cover the given ones."""
    out = sorted(spans)
    while len(out) > 64:
        gaps = sorted(range(1, len(out)), key=lambda k: out[k][0] - out[k - 1][1])[: len(out) - 64]
        for k in sorted(gaps, reverse=True):
            out[k - 1 : k + 1] = [(out[k - 1][0], max(out[k - 1][1], out[k][1]))]
    return out


def _targets(total: int, shards: int, big: list[tuple[int, int]]) -> list[int]:
    """Positions of equal shares, if each big group counted as one share of what the others leave."""
    big = sorted(big)
    share = (total - sum(n for _, n in big)) / max(1, shards - len(big))
    out, pieces, at = [], [], 0
    for start, n in big:
        pieces += [(at, start, 1.0), (start, start + n, share / n)]
        at = start + n
    pieces.append((at, total, 1.0))
    done, k = 0.0, 1
    for a, b, rate in pieces:
        while k < shards and rate > 0 and done + (b - a) * rate >= k * share:
            out.append(min(b, max(a, round(a + (k * share - done) / rate))))
            k += 1
        done += (b - a) * rate
    return out + [total] * (shards - 1 - len(out))


def _even_cuts(known: Boundaries, capacity: int, shards: int, big: list[tuple[int, int]]) -> tuple[list[int], set]:
    total, hidden = known.total, set()
    back = [total]
    for _ in range(shards - 1):  # the least feasible position of each cut
        answer, block = known.after(max(0, back[-1] - capacity))
        if block:
            hidden.add(block)
            return [], hidden
        back.append(answer)
    least = back[:0:-1]
    cuts, at = [], 0
    for k, target in enumerate(_targets(total, shards, big)):
        most, _, block = known.before(min(total, at + capacity))
        low, _, block_low = known.before(target)
        up, block_up = known.after(target)
        if block or block_low or block_up:
            return [], {x for x in (block, block_low, block_up) if x}
        at = max(at, least[k], min(most, low if target - low <= up - target else up))
        cuts.append(at)
    return cuts, hidden


def _range_of(value: Column, edges: list[int]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= value)) if edges else F.lit(0)


def shard(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD, ranges: int = RANGES, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of docs."""
    text = text_or_empty()
    rows = store(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), id_or_least().alias("did"), (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"),
        ),
        "shard-rows",
    )
    facts = rows.agg(F.sum("size").alias("total"), F.percentile_approx("did", [k / ranges for k in range(1, ranges)], 20_000).alias("edges")).first()
    edges = sorted(set(facts.edges or []))
    group = ["h1", "h2", "text_crc32", "size"]
    rows = rows.withColumn("part", _range_of(F.col("did"), edges))
    parts = rows.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("n"), F.min("did").alias("first"))
    groups = parts.groupBy(*group).agg(F.sum("n").alias("n"), (F.sum("n") * F.col("size")).alias("bytes"), F.min("first").alias("first")).withColumn("range", _range_of(F.col("first"), edges))
    bytes_before, rows_before, sums = [0], [0], {r.range: r for r in groups.groupBy("range").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()}
    for k in range(len(edges) + 1):
        bytes_before.append(bytes_before[-1] + (sums[k].bytes if k in sums else 0))
        rows_before.append(rows_before[-1] + (sums[k].n if k in sums else 0))
    order = Window.partitionBy("range").orderBy("first", *group).rowsBetween(Window.unboundedPreceding, -1)
    at = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("range") + 1)
    groups = store(
        groups.select(*group, "n", "bytes", (at(bytes_before) + F.coalesce(F.sum("bytes").over(order), F.lit(0))).alias("start"), (at(rows_before) + F.coalesce(F.sum("n").over(order), F.lit(0))).alias("row")),
        "shard-groups",
    )
    total = facts.total or 0
    cuts: list[int] = []
    if total:
        largest = groups.agg(F.max("bytes")).first()[0]
        big = [(r.start, r.bytes) for r in groups.filter(F.col("bytes") * shards > total).select("start", "bytes").collect()]  # fewer than `shards`
        _, cuts = minimax_cuts(Boundaries(groups, total, blocks), shards, largest, big)
    first_rows = {r.start: r.row for r in groups.filter(F.col("start").isin(cuts)).select("start", "row").collect()} if cuts else {}
    first_rows[total] = rows_before[-1]
    groups = groups.withColumn("shard", _range_of(F.col("start"), cuts))
    bases = F.array(F.lit(0).cast("long"), *[F.lit(first_rows[c]).cast("long") for c in cuts])
    inside = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a group has at most `ranges` parts, whatever its rows
    placed = parts.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(groups.select(*group, "shard", (F.col("row") - F.element_at(bases, F.col("shard") + 1)).alias("base")), group)
    own = Window.partitionBy(*group, "part").orderBy("did", "doc_id")
    out = rows.join(placed.select(*group, "part", "shard", (F.col("base") + F.col("before")).alias("base")), [*group, "part"])
    return out.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("base") + F.row_number().over(own) - 1).cast("long").alias("slot"))
