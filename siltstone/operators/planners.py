"""What maintenance would do if it ran now: plans only, nothing is written.

Selections are joins and aggregates. Packing is sequential within its group, so it runs as one grouped function a group;
the groups are partitions or buckets of file metadata, never rows of data.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- packing


def first_fit(sizes: list[int], target: int, lookback: int, largest_first: bool = False) -> list[int]:
    """Bin numbers by first fit over at most `lookback` open bins; when a new one is needed beyond that, the oldest (or the
    heaviest) is closed."""
    bins: list[list] = []  # [number, weight] of open bins
    out, made = [], 0
    for size in sizes:
        home = next((b for b in bins if b[1] + size <= target), None)
        if home is None:
            if len(bins) >= lookback:
                bins.remove(max(bins, key=lambda b: b[1]) if largest_first else bins[0])
            home = [made, 0]
            made += 1
            bins.append(home)
        home[1] += size
        out.append(home[0])
    return out


def one_open_bin(sizes: list[int], target: int) -> list[int]:
    return first_fit(sizes, target, 1)


def ordered(sizes: list[int], target: int, open_cost: int = 0) -> list[int]:
    """Closes the bin when the next item would overflow it; each item weighs at least open_cost."""
    out, at, n = [], 0, 0
    for size in sizes:
        w = max(size, open_cost)
        if n and at + w > target:
            n, at = n + 1, 0
        n = n or 1
        at += w
        out.append(n - 1)
    return out


def packed(files: DataFrame, by: list[str], order: list[str], size: str, pack: Callable[[list[int]], list[int]]) -> DataFrame:
    """files with bin, packed within each group in the given order."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        return group.assign(bin=pd.Series(pack(group[size].tolist()), index=group.index, dtype="int64"))

    schema = files.schema.simpleString()[len("struct<") : -1]
    return files.groupBy(*by).applyInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", bin long") if schema else files


def output_files(total: Column, target: int, least: int, most: int) -> Column:
    """How many files a rewrite of `total` bytes writes: full targets, and the rest as one more unless it fits into those."""
    full, rest = F.floor(total / target), total % target
    average = total / F.greatest(full, F.lit(1))
    return F.when(total < target, 1).when(rest > least, full + 1).when(average < F.least(F.lit(1.1 * target), F.lit(most).cast("double")), full).otherwise(full + 1).cast("long")


# ---- rewrites


def rewrite_data_files(files: DataFrame, target: int, min_files: int = 5, max_removed_share: float = 0.3, min_deletes: int = 2**31) -> DataFrame:
    """(part, files, bytes, outputs) of the groups that would be rewritten: files outside 75-180 % of the target, or with too
    many deletes; a group qualifies by its number of files, by its bytes, or by a file with too many deletes."""
    odd = (F.col("size") < 0.75 * target) | (F.col("size") > 1.8 * target)
    heavy = (F.col("n_deletes") >= min_deletes) | (F.col("removed") / F.col("rows") >= max_removed_share)
    chosen = files.filter(odd | heavy).withColumn("heavy", heavy)
    groups = chosen.groupBy("part").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.bool_or("heavy").alias("heavy"))
    wanted = ((F.col("files") >= min_files) & (F.col("files") > 1)) | ((F.col("files") > 1) & (F.col("bytes") > target)) | (F.col("bytes") > 1.8 * target) | F.col("heavy")
    return groups.filter(wanted).select("part", "files", "bytes", output_files(F.col("bytes"), target, int(0.75 * target), int(1.8 * target)).alias("outputs"))


def dangling_deletes(deletes: DataFrame, data: DataFrame) -> DataFrame:
    """Deletes (delete_id, kind, part, delete_seq) that no data file of their partition is old enough for."""
    floor_ = data.groupBy("part").agg(F.min("seq").alias("floor"))
    joined = deletes.join(floor_, "part", "left")
    reaches = F.when(F.col("kind") == "equality", F.col("delete_seq") > F.col("floor")).otherwise(F.col("delete_seq") >= F.col("floor"))
    return joined.filter(F.col("floor").isNull() | ~reaches).select("delete_id")


def merge_manifests(manifests: DataFrame, target: int, min_count: int = 100) -> DataFrame:
    """Bins of manifests (content, ord, size), packed from the oldest end; the bin with the newest needs min_count."""
    bins = packed(manifests, ["content"], ["ord"], "size", lambda sizes: one_open_bin(sizes, target))
    own = bins.groupBy("content", "bin").agg(F.count(F.lit(1)).alias("manifests"), F.sum("size").alias("bytes"), F.max("ord").alias("newest"))
    top = F.max("newest").over(Window.partitionBy("content"))
    merged = (F.col("manifests") > 1) & ((F.col("newest") != top) | (F.col("manifests") >= min_count))
    return own.withColumn("merged", merged).drop("newest")


def rewrite_manifests(manifests: DataFrame, target: int) -> DataFrame:
    return manifests.groupBy("content").agg(F.count(F.lit(1)).alias("manifests"), F.ceil(F.sum("size") / target).cast("long").alias("outputs"))


def rewritten_paths(paths: DataFrame, source: str, to: str) -> DataFrame:
    """(path, copy_to) under another prefix; paths outside the source prefix are refused."""
    prefix = source.rstrip("/") + "/"
    inside = F.col("path").startswith(prefix)
    return paths.withColumn("copy_to", F.when(inside, F.concat(F.lit(to.rstrip("/") + "/"), F.substring("path", F.lit(len(prefix) + 1), F.length("path"))))).withColumn("refused", ~inside)


# ---- expiry


def expire_snapshots(chain: DataFrame, cutoff: Column, min_keep: int, named: DataFrame) -> DataFrame:
    """chain (snapshot_id, depth, at_time) of a branch with retained: the youngest min_keep and the young ones, up to the
    first that is neither; and every snapshot a ref names."""
    fails = F.when((F.col("depth") >= min_keep) & (F.col("at_time") < cutoff), 1).otherwise(0)
    w = Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)  # a row for each snapshot
    kept = F.max(fails).over(w) == 0
    refs = named.select("snapshot_id").distinct().withColumn("__ref", F.lit(True))
    return chain.withColumn("__kept", kept).join(refs, "snapshot_id", "left").withColumn("retained", F.col("__kept") | F.coalesce("__ref", F.lit(False))).drop("__kept", "__ref")


def expired_files(referenced: DataFrame, plan: DataFrame) -> DataFrame:
    """Files that only expired snapshots reference."""
    gone = referenced.join(plan.filter(~F.col("retained")), "snapshot_id", "left_semi").select("path").distinct()
    kept = referenced.join(plan.filter("retained"), "snapshot_id", "left_semi").select("path")
    return gone.join(kept, "path", "left_anti")


def expire_by_count(ids: DataFrame, now_ms: int, retain_ms: int, least: int, most: int, consumer: int | None = None, limit: int | None = None) -> DataFrame:
    """Consecutive snapshots (id, at_ms) with expired: beyond the newest `most`, or older than the retention but never among
    the newest `least`, never from a consumer's next on, and no further than the first young one."""
    top = ids.agg(F.max("id").alias("top"), F.min("id").alias("low"))
    own = ids.crossJoin(F.broadcast(top))  # one row
    end = F.col("top") - least + 1
    if consumer is not None:
        end = F.least(end, F.lit(consumer))
    start = F.greatest(F.col("low"), F.col("top") - most + 1)
    young = F.when((F.col("id") >= start) & (F.col("at_ms") > now_ms - retain_ms), F.col("id"))
    own = own.withColumn("__young", F.min(young).over(Window.partitionBy("top")))
    expired = (F.col("id") < end) & ((F.col("id") < start) | F.coalesce(F.col("id") < F.col("__young"), F.lit(True)))
    if limit is not None:
        expired = expired & (F.col("id") < F.col("low") + limit)
    return own.withColumn("expired", expired).drop("top", "low", "__young")


def expire_partitions(partitions: DataFrame, at: Column, now: Column, keep: str, most: int | None = None) -> DataFrame:
    """Partitions whose time is more than `keep` (an interval) before now, oldest first, at most `most`; unreadable times stay."""
    old = partitions.withColumn("at", at).filter(F.col("at") < now - F.expr(f"INTERVAL {keep}"))
    return old.orderBy("at", "part").limit(most) if most else old


def expire_tags(tags: DataFrame, now_ms: int, older_than_ms: int | None = None) -> DataFrame:
    out = F.col("created_ms") + F.col("retained_ms") < now_ms
    return tags.filter(out | (F.col("created_ms") < older_than_ms) if older_than_ms is not None else out)


def rollback(snapshots: DataFrame, target: int) -> DataFrame:
    """What a rollback to an id drops."""
    return snapshots.filter(F.col("snapshot_id") > target)


def fast_forward(branch_chain: DataFrame, to_chain: DataFrame, branch_tip: int) -> DataFrame:
    """Snapshots a branch gains by moving to another ref; none if its tip isn't an ancestor there."""
    allowed = to_chain.filter(F.col("snapshot_id") == branch_tip)
    gained = to_chain.join(branch_chain.select("snapshot_id"), "snapshot_id", "left_anti")
    return gained.join(allowed.select(F.lit(1).alias("__ok")).limit(1), F.lit(True), "left_semi")


def cherry_pick(parent: int | None, tip: int | None, published: bool, replaces: bool) -> str:
    if published:
        return "REFUSED"
    if parent == tip:
        return "FAST_FORWARD"
    return "REFUSED" if replaces else "PUBLISH"


# ---- orphans and vacuum


def orphans(listing: DataFrame, referenced: DataFrame, cutoff: int) -> DataFrame:
    return listing.join(referenced.select("path").distinct(), "path", "left_anti").filter(F.col("modified") < cutoff)


def hidden_name(name: Column, partitions: list[str]) -> Column:
    """Names a vacuum skips: _ or . in front, but not partition folders, _change_data or _delta_index."""
    keep = "|".join([f"{re.escape(p)}=" for p in partitions] + ["_change_data", "_delta_index"])
    return name.rlike(r"^[_.]") & ~name.rlike(f"^({keep})")


def vacuum(listing: DataFrame, kept: DataFrame, cutoff: int, partitions: list[str] = ()) -> DataFrame:
    """Files (path, modified) older than the cut-off that no kept file names and no hidden folder holds."""
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda p: hidden_name(p, list(partitions)))
    return listing.filter((F.col("modified") < cutoff) & ~hidden).join(kept.select("path").distinct(), "path", "left_anti")


def log_cleanup(commits: DataFrame, cutoff_ms: int, checkpoint: int) -> DataFrame:
    """Commits before the checkpoint whose forced-monotone time is before the UTC day of the cut-off."""
    from siltstone.operators.replay import monotone_times

    day = cutoff_ms - cutoff_ms % 86_400_000
    return monotone_times(commits).filter((F.col("version") < checkpoint) & (F.col("adjusted") <= day))


def next_checkpoint(version: int, every: int = 10) -> int:
    return (version // every + 1) * every


# ---- compaction


def optimize(files: DataFrame, target: int, max_removed: float = 0.05) -> DataFrame:
    """Bins of a compaction: small files or ones with many deleted rows, packed by size in each partition; bins of two or
    more, or of a file with deletes."""
    heavy = F.col("removed") / F.col("rows") > max_removed
    chosen = files.filter((F.col("size") < target) | heavy).withColumn("heavy", heavy)
    bins = packed(chosen, ["part"], ["size", "file"], "size", lambda sizes: ordered(sizes, target))
    own = bins.groupBy("part", "bin").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.bool_or("heavy").alias("heavy"))
    return own.filter("files > 1 OR heavy").drop("heavy")


def zorder(files: DataFrame) -> DataFrame:
    return files.groupBy("part").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def cluster(files: DataFrame, least: int, target: int) -> DataFrame:
    """Bins of a clustering: files of no cube or of a cube (cube, size) below `least` bytes."""
    total = F.sum("size").over(Window.partitionBy("cube"))
    chosen = files.withColumn("__t", total).filter(F.col("cube").isNull() | (F.col("__t") < least)).drop("__t")
    bins = packed(chosen.withColumn("all", F.lit(0)), ["all"], ["file"], "size", lambda sizes: ordered(sizes, target))
    return bins.groupBy("bin").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def append_compaction(files: DataFrame, target: int, min_files: int = 5) -> DataFrame:
    """Small files packed in order; a bin is compacted if it has min_files or reaches twice the target."""
    small = files.filter(F.col("size") < target * 0.7)
    bins = packed(small, ["part"], ["file"], "size", lambda sizes: ordered(sizes, 2 * target))
    return bins.groupBy("part", "bin").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")).filter((F.col("files") >= min_files) | (F.col("bytes") >= 2 * target))


def pick_runs(sizes: list[int], levels: list[int], trigger: int = 5, max_amplification: int = 200, ratio: int = 1, top: int = 5) -> tuple[str, int, int | None]:
    """Universal compaction over sorted runs, newest first: which rule fires, how many runs it takes and the level they go to."""
    n = len(sizes)
    if n < trigger:
        return "NONE", 0, None
    if sum(sizes[:-1]) * 100 > max_amplification * sizes[-1]:
        return "SIZE_AMPLIFICATION", n, top
    for rule, taken in (("SIZE_RATIO", 1), ("RUN_COUNT", n - trigger + 1)):  # the first so many runs, and then on while runs are of like size
        total = sum(sizes[:taken])
        while taken < n and sizes[taken] * 100 <= total * (100 + ratio):
            total += sizes[taken]
            taken += 1
        if taken > 1:
            return (rule, *_landing(levels, taken, top))
    return "NONE", 0, None


def _landing(levels: list[int], taken: int, top: int) -> tuple[int, int]:
    """Runs taken and their new level: below the first run that stays, but never level 0, so that level-0 runs join up to
    the first run of a higher level, into that level; all runs go to the top."""
    if taken < len(levels) and levels[taken] > 1:
        return taken, levels[taken] - 1
    higher = [k for k in range(taken, len(levels)) if levels[k] > 0]
    if not higher or higher[0] == len(levels) - 1:
        return len(levels), top
    return higher[0] + 1, levels[higher[0]]


def compactions(files: DataFrame, by: list[str], **options: int) -> DataFrame:
    """Each bucket's pick (rule, runs, output_level)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        zero = group[group.level == 0].sort_values("file", ascending=False)
        rest = group[group.level > 0].groupby("level")["bytes"].sum().sort_index()
        sizes, levels = [*zero["bytes"].tolist(), *rest.tolist()], [0] * len(zero) + rest.index.tolist()
        rule, runs, level = pick_runs(sizes, levels, **options)
        return pd.DataFrame({**{b: [group[b].iloc[0]] for b in by}, "rule": [rule], "runs": [runs], "output_level": pd.array([level], "Int64")})

    kinds = dict(files.dtypes)
    return files.groupBy(*by).applyInPandas(run, ", ".join(f"{b} {kinds[b]}" for b in by) + ", rule string, runs long, output_level long")


def full_compaction(sectioned: DataFrame, top_level: int) -> DataFrame:
    """Sections (bucket, section, level, ...): REWRITE if files overlap, UPGRADE if a lone file is below the top, else LEAVE."""
    own = sectioned.groupBy("bucket", "section").agg(F.count(F.lit(1)).alias("files"), F.max("level").alias("level"))
    return own.withColumn("verdict", F.when(F.col("files") > 1, "REWRITE").when(F.col("level") < top_level, "UPGRADE").otherwise("LEAVE")).drop("level")


# ---- scan tasks


def split_size(total: int, parallelism: int, size: int) -> int:
    """Shrinks the split size so that a small scan still uses the parallelism."""
    least = min(16 << 20, size)
    return max(least, min(size, math.ceil(total / max(1, parallelism))))


def splits(files: DataFrame, size: int) -> DataFrame:
    """Fixed slices of each file (file, offset, length)."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(size).cast("long")))
    cut = files.select("file", "size", starts.alias("offset"))
    return cut.select("file", "offset", F.least(F.lit(size), F.col("size") - F.col("offset")).cast("long").alias("length"))


def scan_tasks(cut: DataFrame, files: DataFrame, size: int, open_cost: int = 4 << 20, lookback: int = 10) -> DataFrame:
    """Tasks: splits packed by max(bytes, (1 + deletes) * open cost), within each partition."""
    weighed = cut.join(files.select("file", "part", "n_deletes"), "file").withColumn("weight", F.greatest(F.col("length"), (1 + F.col("n_deletes")) * open_cost).cast("long"))
    bins = packed(weighed, ["part"], ["file", "offset"], "weight", lambda sizes: first_fit(sizes, size, lookback, True))
    return bins.groupBy("part", "bin").agg(F.count(F.lit(1)).alias("splits"), F.sum("weight").alias("weight"))


# ---- merged tables: splits, manifests, tags, roll back


def key_splits(files: DataFrame, by: list[str], target: int, open_cost: int = 4 << 20, one_pass: bool = False) -> DataFrame:
    """Splits of keyed buckets: files (file, lo, hi, bytes, level, deleted). A bucket whose files need no merge (all above
    level 0, without deletes, and of one level or read by vectors) is packed file by file; else its sections are."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["lo", "hi", "file"], kind="stable")
        raw = bool((group.level > 0).all() and (group.deleted == 0).all() and (one_pass or group.level.nunique() == 1))
        if raw:
            unit = pd.Series(range(len(group)), index=group.index)
        else:
            before = group.hi.cummax().shift()
            unit = (before.isna() | (group.lo > before)).cumsum() - 1
        weights = group.groupby(unit)["bytes"].sum().clip(lower=open_cost)
        split = unit.map(dict(zip(weights.index, ordered(weights.tolist(), target), strict=True)))
        alone = split.map(split.value_counts()) == 1
        return group.assign(split=split.astype("int64"), raw=raw | (alone & (group.deleted == 0)))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.groupBy(*by).applyInPandas(run, f"{kinds}, split long, raw boolean")


def append_splits(files: DataFrame, by: list[str], target: int, open_cost: int = 4 << 20) -> DataFrame:
    return packed(files, by, ["min_seq", "file"], "bytes", lambda sizes: ordered(sizes, target, open_cost))


def engine_partitions(sizes: list[tuple[int, bool]], target: int, open_cost: int, parallelism: int) -> list[int]:
    """Partition numbers of files (bytes, raw) in split order: a file that needs a merge keeps its own, raw ones are repacked
    up to min(target, max(open cost, raw bytes / parallelism))."""
    bound = min(target, max(open_cost, sum(n + open_cost for n, raw in sizes if raw) // max(1, parallelism)))
    out, number, at = [], 0, 0
    reserved = sum(not raw for _, raw in sizes)
    merged = 0
    for n, raw in sizes:
        if not raw:
            out.append(merged)
            merged += 1
            continue
        if at and at + n + open_cost > bound:
            number, at = number + 1, 0
        at += n + open_cost
        out.append(reserved + number)
    return out


def merge_small_manifests(sizes: list[int], changed: list[bool], target: int, min_count: int, full_threshold: int) -> tuple[str, list[int | None]]:
    """(FULL, MINOR or NONE, bins): a full rewrite if the manifests that must change (small, or with deletions) reach the
    threshold; else bins closed by size in list order, the leftover merged by count. A manifest kept whole has no bin."""
    must = [c or s < target for s, c in zip(sizes, changed, strict=True)]
    if sizes and sum(s for s, m in zip(sizes, must, strict=True) if m) >= full_threshold:
        return "FULL", [0 if m else None for m in must]
    bins: list[list[int]] = [[]]
    total = 0
    for k, s in enumerate(sizes):
        bins[-1].append(k)
        total += s
        if total >= target:
            bins.append([])
            total = 0
    out: list[int | None] = [None] * len(sizes)
    number = 0
    for i, own in enumerate(bins):
        closed = i < len(bins) - 1
        if len(own) > 1 and (closed or len(own) >= min_count):
            for k in own:
                out[k] = number
            number += 1
    return ("MINOR" if number else "NONE"), out


def tag_deletion(tag_files: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Files (path) only the tag holds: those of neither the tag before nor the nearer of the earliest snapshot and the tag after."""
    return tag_files.select("path").distinct().join(neighbours.select("path").distinct(), "path", "left_anti")


def tag_neighbours(tags: list[int], tag: int, snapshots: list[int]) -> list[int] | None:
    """The snapshots whose files are skipped when a tag goes; None if only the tag file goes."""
    if tag in snapshots or tags.count(tag) > 1:
        return None
    before = [t for t in tags if t < tag]
    after = [t for t in tags if t > tag] + ([min(snapshots)] if snapshots else [])
    return ([max(before)] if before else []) + ([min(after)] if after else [])


def removed_by_expiry(entries: DataFrame, first_kept: int, tag_files: DataFrame) -> DataFrame:
    """Data files that expiring the snapshots before first_kept frees: the last entry up to first_kept deletes them, and no
    tag holds them. entries (snapshot_id, ord, path, kind 0 add, 1 delete)."""
    own = entries.filter(F.col("snapshot_id") <= first_kept)
    last = own.groupBy("path").agg(F.max_by("kind", F.struct("snapshot_id", "ord")).alias("kind"))
    return last.filter("kind = 1").select("path").join(tag_files.select("path").distinct(), "path", "left_anti")


def metadata_cleanup(items: DataFrame, uses: DataFrame, pinned: int) -> DataFrame:
    """Specs or schemas (id) that no retained snapshot's use (id) reaches and that isn't the current one."""
    return items.filter(F.col("id") != pinned).join(uses.select("id").distinct(), "id", "left_anti")


def stats_columns(fields: list, partitions: list[str], limit: int = 32, named: list[str] | None = None) -> list[str]:
    """Dotted paths whose statistics are kept: the listed ones, or the first `limit` leaves of the data columns (below zero:
    all). fields: (name, None or child fields)."""
    own = [f for f in fields if f[0] not in partitions]
    out: list[str] = []
    wanted = None if named is None else set(named)

    def walk(some: list, prefix: str, budget: float) -> int:
        used = 0
        for name, children in some:
            if used >= budget:
                break
            path = prefix + name
            if wanted is not None and not any(path == w or path.startswith(w + ".") or w.startswith(path + ".") for w in wanted):
                continue
            out.append(path)
            used += walk(children, path + ".", budget - used) if children else 1
        return used

    walk(own, "", math.inf if limit < 0 or wanted is not None else limit)
    return out


def zorder_refusal(columns: list[str], partitions: list[str], schema: list[str], with_stats: list[str], clustered: bool) -> str | None:
    if clustered:
        return "the table is clustered"
    for c in columns:
        if c in partitions:
            return f"{c} is a partition column"
        if c not in schema:
            return f"{c} is not a column"
        if c not in with_stats:
            return f"{c} has no statistics"
    return None


def optimize_kind(clustered: bool, zorder_by: list[str]) -> str:
    return "CLUSTERING" if clustered and not zorder_by else "ZORDER" if zorder_by else "COMPACTION"


def rollback_verdict(chain: list[int], known: list[int], current: int, target: int) -> tuple[str, list[int]]:
    """UNKNOWN_SNAPSHOT, NOTHING_TO_DO, MOVES or NOT_AN_ANCESTOR, and the snapshots left behind (newest first)."""
    if target not in known:
        return "UNKNOWN_SNAPSHOT", []
    if target == current:
        return "NOTHING_TO_DO", []
    if target in chain:
        return "MOVES", chain[: chain.index(target)]
    return "NOT_AN_ANCESTOR", list(chain)


def rollback_target(chain: DataFrame, at: Column) -> DataFrame:
    """The newest ancestor strictly before a time."""
    return chain.filter(F.col("at_time") < at).agg(F.max_by("snapshot_id", "at_time").alias("snapshot_id"))


def rewrite_position_deletes(files: DataFrame, target: int, format_version: int, min_files: int = 5) -> DataFrame:
    """Groups of positional-delete files outside the size window; tables with vectors are refused."""
    if format_version >= 3:
        raise ValueError("positional deletes of this format version are vectors")
    odd = files.filter((F.col("size") < 0.75 * target) | (F.col("size") > 1.8 * target))
    return odd.groupBy("part").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")).filter((F.col("files") >= min_files) | (F.col("bytes") > target))


def summary(plans: dict[str, DataFrame]) -> DataFrame:
    """One line a procedure: how many rows its plan has."""
    out = None
    for name, plan in plans.items():
        line = plan.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("procedure"), "n", F.when(F.col("n") > 0, "WOULD_RUN").otherwise("NOTHING_TO_DO").alias("verdict"))
        out = line if out is None else out.unionAll(line)
    return out
