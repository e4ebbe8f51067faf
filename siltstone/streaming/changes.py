"""Published change records as a stream: the schema of the batch reads, over a growing folder of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.merge import kind_name


def changes(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(…, kind as +I, -U, +U or -D) of Parquet change files (kind as a number) as they appear."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.withColumn("kind", kind_name(F.col("kind")))


def latest(changes_: DataFrame, key: str, order: str) -> DataFrame:
    """The running last record of each key: one state row a key."""
    others = [c for c in changes_.columns if c != key]
    return changes_.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("last")).select(key, "last.*")


def log_actions(spark: SparkSession, table: str) -> DataFrame:
    """New commits of a transaction log as they are written."""
    from siltstone.sources.delta import ACTIONS

    lines = spark.readStream.option("pathGlobFilter", "*.json").text(f"{table}/_delta_log/")
    return lines.select(F.from_json("value", ACTIONS).alias("a"), F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("long").alias("version")).select("a.*", "version")
