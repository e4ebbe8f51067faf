"""Logs of actions: the live set of a version, traces, change feeds and checks, as windows over actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANGE_KINDS = {"insert": 0, "update_preimage": 1, "update_postimage": 2, "delete": 3}


def change_kind(change: Column) -> Column:
    """The record kind of a change type; null for an unknown one."""
    return F.create_map(*[F.lit(x) for pair in CHANGE_KINDS.items() for x in pair])[change]


def live_at(actions: DataFrame, version: int | None = None, keys: list[str] = ("path",)) -> DataFrame:
    """The adds that stand at a version: each key's last action, if that is an add."""
    own = actions if version is None else actions.filter(F.col("version") <= version)
    others = [c for c in actions.columns if c not in keys]
    last = own.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct("version", "ord")).alias("a"))
    return last.filter("a.action = 'add'").select(*keys, *[F.col(f"a.{c}").alias(c) for c in others if c != "action"])


def live_by_version(actions: DataFrame, keys: list[str] = ("path",)) -> DataFrame:
    """(version, keys..., since): every version's live set from one pass. An action stands until its key's next one, so each
    add becomes an interval of versions instead of a replay for each version."""
    w = Window.partitionBy(*keys).orderBy("version", "ord")
    spans = actions.withColumn("until", F.lead("version").over(w)).filter("action = 'add'")
    top = actions.agg(F.max("version").alias("top"))
    spans = spans.crossJoin(F.broadcast(top))  # one row
    end = F.coalesce(F.col("until") - 1, F.col("top"))
    return spans.filter(end >= F.col("version")).select(*keys, F.explode(F.sequence("version", end)).alias("at_version"), F.col("version").alias("since"))


def state_sums(live: DataFrame) -> DataFrame:
    """Files, bytes and rows; rows are unknown if any file's are."""
    return live.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.when(F.count("num_records") == F.count(F.lit(1)), F.sum("num_records")).alias("rows"))


def trace(actions: DataFrame, keys: list[str] = ("path",)) -> DataFrame:
    """Each action's effect: ADDED, REPLACED, REMOVED or REMOVED_ABSENT."""
    before = F.lag("action").over(Window.partitionBy(*keys).orderBy("version", "ord"))
    held = F.coalesce(before == "add", F.lit(False))
    effect = F.when((F.col("action") == "add") & held, "REPLACED").when(F.col("action") == "add", "ADDED").when(held, "REMOVED").otherwise("REMOVED_ABSENT")
    return actions.withColumn("effect", effect)


def contributions(traced: DataFrame) -> DataFrame:
    """What each version added to the live set."""
    delta = F.when(F.col("effect") == "ADDED", 1).when(F.col("effect") == "REMOVED", -1).otherwise(0)
    per = traced.groupBy("version").agg(F.sum(delta).alias("delta"), F.count_if(F.col("effect") == "REPLACED").alias("replaced"), F.count_if(F.col("effect") == "REMOVED_ABSENT").alias("absent"))
    return per.withColumn("live", F.sum("delta").over(Window.orderBy("version").rowsBetween(Window.unboundedPreceding, 0)))  # a row for each version


def from_checkpoint(checkpoint: DataFrame, actions: DataFrame, checkpoint_version: int, version: int, keys: list[str] = ("path",)) -> DataFrame:
    """The live set from a checkpoint's adds and the commits after it."""
    base = checkpoint.withColumns({"version": F.lit(checkpoint_version).cast("long"), "ord": F.lit(-1).cast("long"), "action": F.lit("add")})
    later = actions.filter(F.col("version").between(checkpoint_version + 1, version))
    return live_at(base.unionByName(later, allowMissingColumns=True).select(*actions.columns), version, list(keys))


def missing_versions(actions: DataFrame, low: int, high: int) -> DataFrame:
    """Versions of a range that no commit gives: a rebuild over it would be wrong."""
    spark = actions.sparkSession
    return spark.range(low, high + 1).withColumnRenamed("id", "version").join(actions.select("version").distinct(), "version", "left_anti")


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with the side."""
    return a.select(*keys).subtract(b.select(*keys)).withColumn("side", F.lit("ONLY_IN_FROM")).unionAll(b.select(*keys).subtract(a.select(*keys)).withColumn("side", F.lit("ONLY_IN_TO")))


def diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer difference of two file sets: ONLY_IN_FROM, ONLY_IN_TO, CHANGED or IN_BOTH."""
    left, right = a.select(F.col(key).alias("k"), F.col(value).alias("x")), b.select(F.col(key).alias("k2"), F.col(value).alias("y"))
    side = F.when(F.col("k2").isNull(), "ONLY_IN_FROM").when(F.col("k").isNull(), "ONLY_IN_TO").when(~F.col("x").eqNullSafe(F.col("y")), "CHANGED").otherwise("IN_BOTH")
    return left.join(right, F.col("k") == F.col("k2"), "full_outer").select(F.coalesce("k", "k2").alias(key), side.alias("side"))


def change_feed(actions: DataFrame, low: int, high: int) -> DataFrame:
    """Changes of a range of versions without recorded change files: an add is an insert, a remove a delete; actions that
    change no data are left out."""
    own = actions.filter(F.col("version").between(low, high))
    if "data_change" in actions.columns:
        own = own.filter("data_change")
    change = F.when(F.col("action") == "add", "insert").otherwise("delete")
    return own.select("version", "path", change.alias("change_type"), change_kind(change).alias("kind"), "num_records")


def monotone_times(commits: DataFrame) -> DataFrame:
    """Commit times forced to rise: each at least one millisecond after the one before."""
    w = Window.orderBy("version").rowsBetween(Window.unboundedPreceding, 0)  # a row for each commit
    rank = F.row_number().over(Window.orderBy("version"))
    return commits.withColumn("__k", rank).withColumn("adjusted", F.max(F.col("at_ms") - F.col("__k")).over(w) + F.col("__k")).drop("__k")


def not_rising(commits: DataFrame) -> DataFrame:
    before = F.lag("at_ms").over(Window.orderBy("version"))
    return commits.withColumn("before", before).filter("at_ms <= before")


def high_water(commits: DataFrame) -> DataFrame:
    """Row-id high-water mark after each commit (base_row_id, num_records): the greatest id given out so far."""
    own = commits.groupBy("version").agg(F.max(F.col("base_row_id") + F.col("num_records") - 1).alias("top"))
    return own.withColumn("high_water", F.max("top").over(Window.orderBy("version").rowsBetween(Window.unboundedPreceding, 0)))
