"""Merge-on-read: delete files against data files, and each row's fate.

Deletes are positions of deletion vectors, positional deletes and equality deletes, each with a sequence number. Vectors
and positions apply to rows of the same or an older sequence, equality deletes to strictly older ones; equality is
null-safe. A row claimed by several deletes reports the first by delete key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIVE, VECTOR, POSITION, EQUALITY = "LIVE", "VECTOR_DELETED", "POSITION_DELETED", "EQUALITY_DELETED"


def applies(kind: str, data_sequence: Column, delete_sequence: Column) -> Column:
    return delete_sequence > data_sequence if kind == EQUALITY else delete_sequence >= data_sequence


def position_claims(positions: DataFrame) -> DataFrame:
    """(file_id, pos, delete_seq, delete_key), one row for each position: the newest delete claims it."""
    return positions.groupBy("file_id", "pos").agg(F.max("delete_seq").alias("delete_seq"), F.min("delete_key").alias("delete_key"))


def with_fate(rows: DataFrame, vectors: DataFrame | None, positions: DataFrame | None, equality: DataFrame | None, columns: list[str] = ()) -> DataFrame:
    """rows (file_id, pos, seq, ...) with fate. vectors (file_id, pos, delete_key), positions (file_id, pos, delete_seq,
    delete_key), equality (columns..., delete_seq, delete_key). The claims are aggregated to one row a key before they are
    joined, so no join multiplies rows."""
    out, claims = rows, []
    if vectors is not None:
        own = vectors.groupBy("file_id", "pos").agg(F.min("delete_key").alias("__v"))
        out = out.join(own, ["file_id", "pos"], "left")
        claims.append((F.col("__v"), VECTOR))
    if positions is not None:
        own = position_claims(positions).select("file_id", "pos", F.col("delete_seq").alias("__ps"), F.col("delete_key").alias("__pk"))
        out = out.join(own, ["file_id", "pos"], "left")
        claims.append((F.when(F.col("__ps") >= F.col("seq"), F.col("__pk")), POSITION))
    if equality is not None:
        own = equality.groupBy(*columns).agg(F.max("delete_seq").alias("__es"), F.min("delete_key").alias("__ek"))
        own = own.select(*[F.col(c).alias(f"__{c}") for c in columns], "__es", "__ek")
        on = F.lit(True)
        for c in columns:
            on = on & out[c].eqNullSafe(own[f"__{c}"])
        out = out.join(own, on, "left")
        claims.append((F.when(F.col("__es") > F.col("seq"), F.col("__ek")), EQUALITY))
    pairs = F.array_sort(F.filter(F.array(*[F.struct(k.alias("key"), F.lit(name).alias("kind")) for k, name in claims]), lambda x: x.key.isNotNull()))
    fate = F.when(F.size(pairs) > 0, F.element_at(pairs, 1).kind).otherwise(LIVE) if claims else F.lit(LIVE)
    return out.withColumn("fate", fate).select(*rows.columns, "fate")


def reach(data: DataFrame, deletes: DataFrame) -> DataFrame:
    """Delete files paired with the data files of their partition scope (global ones with all), and the verdict.

    data (file_id, seq, part, k_min, k_max, k_nulls); deletes (delete_id, kind, delete_seq, part, target, k_min, k_max,
    k_nulls): part null is global, target a single file or null. Scoped deletes meet data by an equi-join on the partition;
    only the global ones, few by nature, are paired with every file."""
    d = deletes.withColumnRenamed("part", "delete_part").withColumnsRenamed({"k_min": "d_min", "k_max": "d_max", "k_nulls": "d_nulls"})
    scoped = data.join(d.filter("delete_part IS NOT NULL"), data.part == F.col("delete_part"))
    everywhere = data.join(d.filter("delete_part IS NULL"), F.lit(True))
    pairs = scoped.unionByName(everywhere)
    old = F.when(F.col("kind") == "equality", F.col("delete_seq") > F.col("seq")).otherwise(F.col("delete_seq") >= F.col("seq"))
    nulls_meet = (F.col("k_nulls") > 0) & (F.col("d_nulls") > 0)
    overlap = F.coalesce((F.col("k_max") >= F.col("d_min")) & (F.col("k_min") <= F.col("d_max")), F.lit(False))
    verdict = (
        F.when(~old, "RULED_OUT_BY_SEQUENCE")
        .when(F.col("target").isNotNull() & (F.col("target") != F.col("file_id")), "RULED_OUT_BY_TARGET")
        .when((F.col("kind") == "equality") & ~nulls_meet & ~overlap, "RULED_OUT_BY_BOUNDS")
        .when(F.col("target").isNotNull(), "REACHES")
        .otherwise("MAY_REACH")
    )
    return pairs.withColumn("verdict", verdict)


def targets(positions: DataFrame) -> DataFrame:
    """Positional deletes by the file they name."""
    return positions.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def live_counts(files: DataFrame, vectors: DataFrame, positions: DataFrame) -> DataFrame:
    """Live rows of each file (file_id, rows, seq): its count less the distinct removed positions, no data file opened."""
    own = positions.join(files.select("file_id", "seq"), "file_id").filter(F.col("delete_seq") >= F.col("seq"))
    removed = own.select("file_id", "pos").unionAll(vectors.select("file_id", "pos")).distinct()
    n = removed.groupBy("file_id").agg(F.count(F.lit(1)).alias("removed"))
    return files.join(n, "file_id", "left").select("file_id", "rows", F.coalesce("removed", F.lit(0)).alias("removed"), (F.col("rows") - F.coalesce("removed", F.lit(0))).alias("live"))
