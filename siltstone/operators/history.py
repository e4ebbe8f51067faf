"""Snapshots through time: ledgers, breakdowns, ancestry, time travel, row and schema history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ledger(entries: DataFrame, live_only: bool = False) -> DataFrame:
    """Manifest entries (manifest, ord, file, status, rows) with their contribution: REMOVAL, DUPLICATE (the file was
    counted by an earlier entry) or COUNTED. status 2 is deleted."""
    own = entries.filter("status <> 2") if live_only else entries
    rank = F.row_number().over(Window.partitionBy("file", F.col("status") == 2).orderBy("ord"))
    what = F.when(F.col("status") == 2, "REMOVAL").when(rank > 1, "DUPLICATE").otherwise("COUNTED")
    return own.withColumn("contribution", what)


def ledger_total(contributions: DataFrame, by: list[str] = ()) -> DataFrame:
    counted = F.col("contribution") == "COUNTED"
    return contributions.groupBy(*by).agg(F.count(F.lit(1)).alias("entries"), F.count_if(counted).alias("files"), F.coalesce(F.sum(F.when(counted, F.col("rows"))), F.lit(0)).alias("rows"), F.count_if(F.col("contribution") == "REMOVAL").alias("removed"))


def partition_breakdown(files: DataFrame, by: str = "part") -> DataFrame:
    """Files, rows, bytes and share of the rows, by partition; the total is one aggregate row."""
    per = files.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    total = files.agg(F.sum("rows").alias("__all"))
    return per.crossJoin(F.broadcast(total)).withColumn("share", F.col("rows") / F.col("__all")).drop("__all")


def ancestors(snapshots: DataFrame, of: int) -> DataFrame:
    """(snapshot_id, depth): the chain of parents, of any length. The two id columns of the snapshots, one row a snapshot of
    a table's metadata, are walked on the driver; a join for each level would cost more than the whole list."""
    parent = {r.snapshot_id: r.parent_id for r in snapshots.select("snapshot_id", "parent_id").toLocalIterator()}
    rows, at, seen = [], of, set()
    while at is not None and at in parent and at not in seen:
        seen.add(at)
        rows.append((at, len(rows)))
        at = parent[at]
    return snapshots.sparkSession.createDataFrame(rows, "snapshot_id long, depth long")


def chain(snapshots: DataFrame, of: int) -> DataFrame:
    """(snapshot_id, depth) by a recursive common table expression, for chains within its recursion limit."""
    return snapshots.sparkSession.sql(
        """WITH RECURSIVE up(snapshot_id, parent_id, depth) AS (
             SELECT snapshot_id, parent_id, 0 FROM {s} WHERE snapshot_id = :of
             UNION ALL SELECT s.snapshot_id, s.parent_id, depth + 1 FROM up JOIN {s} s ON s.snapshot_id = up.parent_id)
           SELECT snapshot_id, CAST(depth AS BIGINT) AS depth FROM up""",
        args={"of": of},
        s=snapshots,
    )


def tracks(snapshots: DataFrame, branches: DataFrame) -> DataFrame:
    """(snapshot_id, line, track): the order snapshots are drawn in and the column of each, so that a fork reads as lines side
    by side. snapshots (snapshot_id, parent_id, at_ms, sequence), branches (branch, snapshot_id, made: the metadata version
    that made it, or null).

    A snapshot's first child stays in its column, each later one opens a column of its own, and none is used twice. First is
    the child on the older line (main, then branches by age and name), then the older child. One row a snapshot of a table's
    metadata is walked on the driver, as in `ancestors`."""
    own = {r.snapshot_id: r for r in snapshots.select("snapshot_id", "parent_id", "at_ms", "sequence").toLocalIterator()}
    last = float("inf")
    known = lambda v: last if v is None else v
    tips = sorted(branches.select("branch", "snapshot_id", "made").toLocalIterator(), key=lambda r: (r.branch != "main", known(r.made), r.branch))
    rank: dict[int, int] = {}
    for k, tip in enumerate(tips):
        at = tip.snapshot_id
        while at in own and at not in rank:
            rank[at] = k
            at = own[at].parent_id
    age = lambda k: (known(own[k].at_ms), known(own[k].sequence), k)
    children: dict[int, list[int]] = {}
    for k, r in own.items():
        if r.parent_id in own:
            children.setdefault(r.parent_id, []).append(k)
    for found in children.values():
        found.sort(key=lambda k: (rank.get(k, last), *age(k)))
    stack = sorted((k for k, r in own.items() if r.parent_id not in own), key=age, reverse=True)
    rows, column, opened = {}, {}, 0
    while stack:
        at = stack.pop()
        if at not in column:
            column[at], opened = opened, opened + 1
        rows[at] = (at, len(rows), column[at])
        for n, child in enumerate(children.get(at, [])):
            column[child] = column[at] if n == 0 else opened
            opened += n > 0
        stack += reversed(children.get(at, []))
    return snapshots.sparkSession.createDataFrame(list(rows.values()), "snapshot_id long, line long, track long")


def as_of(snapshots: DataFrame, times: DataFrame) -> DataFrame:
    """times (t) with the newest snapshot at or before each: one sort of both sides and a running last value, no range join."""
    a = times.select(F.col("t"), F.lit(None).cast("long").alias("snapshot_id"), F.lit(1).alias("side"))
    b = snapshots.select(F.col("at_time").alias("t"), "snapshot_id", F.lit(0).alias("side"))
    w = Window.orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)  # a row for each snapshot and asked time
    return a.unionAll(b).withColumn("found", F.last("snapshot_id", ignorenulls=True).over(w)).filter("side = 1").select("t", F.col("found").alias("snapshot_id"))


def log_events(log: DataFrame) -> DataFrame:
    """Snapshot-log entries (ord, snapshot_id) as COMMIT, or RESET where a snapshot comes back."""
    again = F.row_number().over(Window.partitionBy("snapshot_id").orderBy("ord")) > 1
    return log.withColumn("event", F.when(again, "RESET").otherwise("COMMIT"))


def left_behind(log: DataFrame) -> DataFrame:
    """Snapshots that a later reset went back behind: (snapshot_id, reset_ord), the first such reset.

    A reset covers the places between its snapshot's first one and its own. They are cut into ranges 2 ** level long that
    start at multiples of their length, at most two a level, and a snapshot looks up the one range of each level it lies in:
    an equality join, whatever the resets' lengths and nesting."""
    own = Window.partitionBy("snapshot_id")
    events = log_events(log.withColumn("ord", F.col("ord").cast("long")).filter("ord IS NOT NULL")).withColumn("to_ord", F.min("ord").over(own))
    resets = events.filter("event = 'RESET' AND snapshot_id IS NOT NULL AND to_ord < ord").selectExpr("ord AS reset_ord", "to_ord + 1 AS low", "ord AS high").filter("low < high")
    levels = resets.selectExpr("*", "explode(sequence(0, coalesce(length(bin(try_subtract(high, low))) - 1, 62))) AS level")
    ends = levels.selectExpr("reset_ord", "level", "-shiftright(-low, level) AS low", "shiftright(high, level) AS high").filter("low < high")
    cut = ends.selectExpr("reset_ord", "level", "explode(array(CASE WHEN low % 2 <> 0 THEN low END, CASE WHEN high % 2 <> 0 THEN high - 1 END)) AS place").filter("place IS NOT NULL")
    ranges = cut.groupBy("level", "place").agg(F.min("reset_ord").alias("reset_ord"))
    used = F.broadcast(ranges.select("level").distinct())  # at most 63 rows
    first = events.filter("event = 'COMMIT'").crossJoin(used).selectExpr("snapshot_id", "level", "shiftright(ord, level) AS place")
    return first.join(ranges, ["level", "place"]).groupBy("snapshot_id").agg(F.min("reset_ord").alias("reset_ord"))


def row_changes(states: DataFrame, key: str) -> DataFrame:
    """States of a key through steps (step, key, digest; digest null: not there): APPEARED, CHANGED, GONE or UNCHANGED."""
    before = F.lag("digest").over(Window.partitionBy(key).orderBy("step"))
    change = F.when(before.isNull() & F.col("digest").isNotNull(), "APPEARED").when(before.isNotNull() & F.col("digest").isNull(), "GONE").when(before.eqNullSafe(F.col("digest")), "UNCHANGED").otherwise("CHANGED")
    return states.withColumn("change", change)


def file_history(intervals: DataFrame) -> DataFrame:
    """(path, added_by, removed_by) of every stay of a file."""
    return intervals.groupBy("path", "since").agg((F.max("at_version")).alias("last_version"))


def schema_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Fields (id, name, type) of two schemas: ADDED, DROPPED, RENAMED, RETYPED; unchanged fields are left out."""
    x, y = a.select(F.col("id"), F.col("name").alias("n1"), F.col("type").alias("t1")), b.select(F.col("id").alias("id2"), F.col("name").alias("n2"), F.col("type").alias("t2"))
    what = F.when(F.col("id").isNull(), "ADDED").when(F.col("id2").isNull(), "DROPPED").when(F.col("n1") != F.col("n2"), "RENAMED").when(F.col("t1") != F.col("t2"), "RETYPED")
    return x.join(y, F.col("id") == F.col("id2"), "full_outer").select(F.coalesce("id", "id2").alias("id"), what.alias("change")).filter("change IS NOT NULL")


def moved(old: list, new: list) -> list:
    """The fields that moved: those outside a longest common subsequence of the two orders (by patience over positions)."""
    from bisect import bisect_left

    at = {x: k for k, x in enumerate(old)}
    common = [x for x in new if x in at]
    tails, tail_items, link = [], [], {}
    for x in common:
        k = bisect_left(tails, at[x])
        link[x] = tail_items[k - 1] if k else None
        tails[k : k + 1], tail_items[k : k + 1] = [at[x]], [x]
    kept, x = set(), tail_items[-1] if tail_items else None
    while x is not None:
        kept.add(x)
        x = link[x]
    return [x for x in common if x not in kept]


def effective_sequence(entries: DataFrame) -> DataFrame:
    return entries.withColumn("sequence", F.coalesce("entry_seq", "manifest_seq", F.lit(0)))


def row_ids(files: DataFrame, by: str = "manifest_id") -> DataFrame:
    """First row id of each file: the manifest's, plus the rows of the files before it in the manifest."""
    w = Window.partitionBy(by).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("first_row_id", F.coalesce("own_first_row_id", F.col("manifest_first_row_id") + F.coalesce(F.sum("rows").over(w), F.lit(0))))


def missing_files(needed: DataFrame, listing: DataFrame) -> DataFrame:
    """Needed files that the listing lacks, with the snapshots that read them."""
    return needed.join(listing.select("path"), "path", "left_anti").groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("snapshot_id")), ",").alias("snapshots"))


def unreferenced_files(listing: DataFrame, referenced: DataFrame) -> DataFrame:
    return listing.join(referenced.select("path").distinct(), "path", "left_anti")
