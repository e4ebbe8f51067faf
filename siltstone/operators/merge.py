"""Merge-on-read of keyed records: the latest state of each key, merge engines, and ordered folds.

Record kinds: 0 insert, 1 update before, 2 update after, 3 delete. A rule says which record of a key is kept and what
retractions do. Everything is a grouped aggregate with map-side combine; only ordered folds collect a key's own records.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KIND_NAMES = ("+I", "-U", "+U", "-D")


@dataclass(frozen=True)
class MergeRule:
    keep: str = "LATEST"  # LATEST, FIRST or COMBINED
    removing: tuple[int, ...] = (1, 3)
    ignores: tuple[int, ...] = ()
    rejects: tuple[int, ...] = ()
    skips_level_0: bool = False
    sequence_groups: tuple[tuple[str, tuple[str, ...]], ...] = ()


def merge_rule(options: dict[str, str], has_key: bool = True) -> MergeRule:
    """The rule that table options ask for."""
    if not has_key:
        return MergeRule(keep="ALL", removing=())
    flag = lambda name: options.get(name, "false").lower() == "true"
    engine = options.get("merge-engine", "deduplicate")
    ignores = (1, 3) if flag("ignore-delete") else ()
    vectors = flag("deletion-vectors.enabled")
    if engine == "deduplicate":
        return MergeRule("LATEST", () if ignores else (1, 3), ignores, (), vectors)
    if engine == "first-row":
        return MergeRule("FIRST", (), ignores, () if ignores else (1, 3), True)
    groups = tuple((k.split(".")[1], tuple(v.split(","))) for k, v in sorted(options.items()) if k.startswith("fields.") and k.endswith(".sequence-group"))
    if engine == "partial-update":
        removes = flag("partial-update.remove-record-on-delete")
        on_group = "partial-update.remove-record-on-sequence-group" in options
        return MergeRule("COMBINED", (3,) if removes else (), ignores or ((1,) if removes or on_group or groups else ()), () if ignores or removes or on_group or groups else (1, 3), vectors, groups)
    removes = flag("aggregation.remove-record-on-delete")
    return MergeRule("COMBINED", (3,) if removes else (), ignores or ((1,) if removes else ()), () if ignores or removes else (), vectors)


def retracts(kind: Column) -> Column:
    return kind.isin(1, 3)


def kind_name(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KIND_NAMES]), kind + 1)


def latest_per_key(records: DataFrame, keys: list[str], removing: tuple[int, ...] = (1, 3), order: str = "s") -> DataFrame:
    """One row a key: its last record's order and kind, its first insert, counts, whether it was ever retracted, the last
    removal, and the records after that."""
    s = F.col(order)
    last_removal = F.max(F.when(F.col("kind").isin(*removing), s)).over(Window.partitionBy(*keys))
    return (
        records.withColumn("__removed", last_removal)
        .groupBy(*keys)
        .agg(
            F.max(s).alias("last"), F.max_by("kind", s).alias("last_kind"), F.min(F.when(F.col("kind") == 0, s)).alias("first_insert"), F.count(F.lit(1)).alias("records"),
            F.bool_or(retracts(F.col("kind"))).alias("retracted"), F.max("__removed").alias("last_removal"), F.count_if(F.col("__removed").isNull() | (s > F.col("__removed"))).alias("after_removal"),
        )
    )


def merged_count(state: DataFrame, rule: MergeRule, by: list[str]) -> DataFrame:
    """Keys that a read returns, from latest_per_key, for each group of `by`."""
    if rule.keep == "FIRST":
        live = F.col("first_insert").isNotNull()
    elif rule.keep == "COMBINED":
        live = F.col("after_removal") > 0
    else:
        live = ~F.col("last_kind").isin(*rule.removing) if rule.removing else F.lit(True)
    rejected = F.col("retracted") if rule.rejects else F.lit(False)
    return state.groupBy(*by).agg(F.count(F.lit(1)).alias("keys"), F.count_if(live).alias("live"), F.count_if(rejected).alias("rejected"))


def row_fates(records: DataFrame, state: DataFrame, keys: list[str], rule: MergeRule, order: str = "s") -> DataFrame:
    """records with fate: RETRACTION, LIVE, SUPERSEDED, MERGED or SKIPPED (level 0 of a table that reads compacted files)."""
    s = F.col(order)
    joined = records.join(state, keys)
    fate = F.lit(None).cast("string")
    ladder = [(F.col("level") == 0, "SKIPPED")] if rule.skips_level_0 else []
    ladder.append((F.col("kind").isin(*rule.removing) if rule.removing else F.lit(False), "RETRACTION"))
    if rule.keep == "FIRST":
        ladder += [(s == F.col("first_insert"), "LIVE")]
    elif rule.keep == "COMBINED":
        ladder += [(F.col("last_removal").isNotNull() & (s <= F.col("last_removal")), "SUPERSEDED"), (F.col("after_removal") > 1, "MERGED"), (F.lit(True), "LIVE")]
    else:
        ladder += [(s == F.col("last"), "LIVE")]
    fate = F.when(*[ladder[0][0], F.lit(ladder[0][1])])
    for condition, name in ladder[1:]:
        fate = fate.when(condition, F.lit(name))
    return joined.withColumn("fate", fate.otherwise("SUPERSEDED"))


def deduplicated(records: DataFrame, keys: list[str], columns: list[str], order: str = "s") -> DataFrame:
    rows = records.groupBy(*keys).agg(F.max_by(F.struct("kind", *columns), order).alias("r"))
    return rows.filter(~F.col("r.kind").isin(1, 3)).select(*keys, *[F.col(f"r.{c}").alias(c) for c in columns])


def first_rows(records: DataFrame, keys: list[str], columns: list[str], order: str = "s") -> DataFrame:
    return records.filter("kind = 0").groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in columns])


def _after_removal(records: DataFrame, keys: list[str], removing: tuple[int, ...], order: str) -> DataFrame:
    if not removing:
        return records
    w = F.max(F.when(F.col("kind").isin(*removing), F.col(order))).over(Window.partitionBy(*keys))
    return records.withColumn("__r", w).filter(F.col("__r").isNull() | (F.col(order) > F.col("__r"))).drop("__r")


def partially_updated(records: DataFrame, keys: list[str], columns: list[str], removing: tuple[int, ...] = (3,), order: str = "s") -> DataFrame:
    """Each column's last non-null value among the records after the key's last removal."""
    own = _after_removal(records.filter("kind <> 1"), keys, removing, order)
    return own.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def aggregated(records: DataFrame, keys: list[str], functions: dict[str, str], removing: tuple[int, ...] = (3,), order: str = "s") -> DataFrame:
    """Columns folded by name: sum, product, max, min, count, last_value, last_non_null_value, first_value, bool_or, bool_and, listagg."""
    own = _after_removal(records.filter("kind <> 1"), keys, removing, order)
    made = {
        "sum": lambda c: F.sum(c), "product": lambda c: F.product(c), "max": lambda c: F.max(c), "min": lambda c: F.min(c), "count": lambda c: F.count(c), "last_value": lambda c: F.max_by(c, order), "first_value": lambda c: F.min_by(c, order),
        "last_non_null_value": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))), "bool_or": lambda c: F.bool_or(c), "bool_and": lambda c: F.bool_and(c),
        "listagg": lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).cast("string").alias("v"))))), lambda x: x.v), ","),
    }
    return own.groupBy(*keys).agg(*[made[f](c).alias(c) for c, f in functions.items()])


def sequence_groups(records: DataFrame, keys: list[str], groups: dict[str, list[str]], order: str = "s") -> DataFrame:
    """Each group's columns follow its own sequence column: a record replaces them if its sequence value is not null and at
    least the one kept. So a group's state is the record with the greatest (sequence, order); no ordered walk is needed."""
    own = records.filter("kind IN (0, 2)")
    out = [F.max_by(F.struct(g, *cs), F.when(F.col(g).isNotNull(), F.struct(g, order))).alias(f"__{g}") for g, cs in groups.items()]
    rows = own.groupBy(*keys).agg(*out)
    return rows.select(*keys, *[F.col(f"__{g}.{c}").alias(c) for g, cs in groups.items() for c in (g, *cs)])


def removed_fold(records: DataFrame, keys: list[str], column: str, group: str, order: str = "s") -> DataFrame:
    """A sequence group whose deletes at or above the kept sequence reset the key: an ordered fold over the key's records."""
    steps = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("kind").alias("kind"), F.col(group).cast("long").alias("g"), F.col(column).cast("long").alias("v"))))
    none = F.lit(None).cast("long")
    start = F.struct(none.alias("g"), none.alias("v"), F.lit(False).alias("alive"))

    def step(acc, x):
        takes = x.g.isNotNull() & (acc.g.isNull() | (x.g >= acc.g))
        removed = F.struct(x.g.alias("g"), none.alias("v"), F.lit(False).alias("alive"))
        set_ = F.struct(x.g.alias("g"), x.v.alias("v"), F.lit(True).alias("alive"))
        return F.when(takes & (x.kind == 3), removed).when(takes & x.kind.isin(0, 2), set_).otherwise(F.struct(acc.g.alias("g"), acc.v.alias("v"), (acc.alive | x.kind.isin(0, 2)).alias("alive")))

    return records.groupBy(*keys).agg(F.aggregate(steps, start, step).alias("r")).filter("r.alive").select(*keys, F.col("r.g").alias(group), F.col("r.v").alias(column))


def key_range_files(files: DataFrame, keys: DataFrame) -> DataFrame:
    """Files (file, lo, hi) that may hold one of the keys (key): a range join on buckets of the key space, so no pair of a
    file and a key is formed unless they share a bucket."""
    width = 256
    f = files.withColumn("__b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    k = keys.withColumn("__b", F.floor(F.col("key") / width))
    return f.join(k, "__b").filter("key BETWEEN lo AND hi").select("file", "key").distinct()


def sections(files: DataFrame, by: list[str]) -> DataFrame:
    """files (lo, hi) with their section: a new one begins where lo is above every hi before it."""
    w = Window.partitionBy(*by).orderBy("lo", "hi", "file")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("lo") > before), 1).otherwise(0)
    return files.withColumn("__new", fresh).withColumn("section", F.sum("__new").over(w)).drop("__new")


def lsm_shape(files: DataFrame, by: list[str]) -> DataFrame:
    """Sorted runs: each level above 0 is one run, each level-0 file one of its own."""
    return files.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), (F.count_if(F.col("level") == 0) + F.count_distinct(F.when(F.col("level") > 0, F.col("level")))).alias("runs"))
