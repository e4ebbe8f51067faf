"""Recorded against counted: every check is rows (what, place, figure, recorded, counted); a finding is a row whose sides
differ. A side that can't be counted is not checked, which is neither agreement nor a finding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(rows: DataFrame, what: str, place: Column, figures: dict[str, tuple[Column, Column]]) -> DataFrame:
    """rows' figures (recorded, counted) in the common shape."""
    cells = F.array(*[F.struct(F.lit(k).alias("figure"), r.cast("string").alias("recorded"), c.cast("string").alias("counted")) for k, (r, c) in figures.items()])
    return rows.select(F.lit(what).alias("what"), place.cast("string").alias("place"), F.explode(cells).alias("cell")).select("what", "place", "cell.*")


def report(checks: list[DataFrame]) -> DataFrame:
    """All checks with verdict: AGREES, DIFFERS or NOT_CHECKED."""
    rows = reduce(DataFrame.unionByName, checks)
    verdict = F.when(F.col("recorded").isNull() | F.col("counted").isNull(), "NOT_CHECKED").when(F.col("recorded") == F.col("counted"), "AGREES").otherwise("DIFFERS")
    return rows.withColumn("verdict", verdict)


def findings(checks: list[DataFrame]) -> DataFrame:
    return report(checks).filter("verdict = 'DIFFERS'")


def against(recorded: DataFrame, counted: DataFrame, keys: list[str], figures: list[str], what: str) -> DataFrame:
    """Two aggregates of the same figures, full outer by key."""
    c = counted.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(f).alias(f"__{f}") for f in figures])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    joined = recorded.join(c, on, "full_outer")
    place = F.concat_ws("/", *[F.coalesce(F.col(k), F.col(f"__{k}")).cast("string") for k in keys])
    return check(joined, what, place, {f: (F.col(f), F.col(f"__{f}")) for f in figures})


def column_bounds(recorded: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Recorded bounds and counts (least, greatest, nulls, rows) against the rows: counts exact, bounds one-sided."""
    a = actual.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in ("least", "greatest", "nulls", "rows")])
    joined = recorded.join(a, F.col(key) == F.col("__k"))
    ok = lambda c: F.when(c, "ok").otherwise("out of bounds")
    return check(
        joined, "column statistics", F.col(key),
        {"rows": (F.col("rows"), F.col("__rows")), "nulls": (F.col("nulls"), F.col("__nulls")), "least": (F.lit("ok"), ok(F.col("least") <= F.col("__least"))), "greatest": (F.lit("ok"), ok(F.col("greatest") >= F.col("__greatest")))},
    )


def partition_bounds(files: DataFrame, transform, source: str) -> DataFrame:
    """A file's partition against its own bounds: both ends transform to it."""
    low, high = transform(F.col(f"{source}_min")), transform(F.col(f"{source}_max"))
    verdict = F.when(F.col("partition").isNull() | low.isNull() | high.isNull(), "NOT_CHECKED").when((low == F.col("partition")) & (high == F.col("partition")), "AGREES").otherwise("DIFFERS")
    return files.withColumn("verdict", verdict)


def metrics_mode(columns: list[str], properties: dict[str, str], limit: int = 100) -> dict[str, str]:
    """The metrics mode of each column: its own setting, else the default, none beyond the limit, sorted by position."""
    default = properties.get("write.metadata.metrics.default")
    out = {}
    for k, c in enumerate(columns):
        own = properties.get(f"write.metadata.metrics.column.{c}")
        out[c] = own or default or ("truncate(16)" if k < limit else "none")
    return out


def commit_metrics(actions: DataFrame) -> DataFrame:
    """What each version's actions add up to."""
    add = F.col("action") == "add"
    return actions.groupBy("version").agg(F.count_if(add).alias("added"), F.count_if(~add).alias("removed"), F.coalesce(F.sum(F.when(add, F.col("size"))), F.lit(0)).alias("added_bytes"), F.coalesce(F.sum(F.when(add, F.col("num_records"))), F.lit(0)).alias("added_rows"))
