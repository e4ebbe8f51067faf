"""Shared helpers: where intermediate tables live, and how documents are read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space in the sense of the text contracts: space and \t \n \v \f \r.
SPACES = b" \t\n\x0b\x0c\r"
#: Stands for a null document id: smaller than any id in use.
NO_ID = -(2**63)

_local_base: dict[str, str] = {}


def shared_base(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a fresh local one where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_base:
        _local_base[app] = tempfile.mkdtemp(prefix="siltstone-")
    return _local_base[app]


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_base(spark)}/siltstone-{re.sub(r'[^A-Za-z0-9]+', '-', name)}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    writer = df.write.option("compression", "zstd")
    writer = writer.partitionBy(partition_by) if partition_by else writer
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def remove(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that no later plan reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_or_least(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def text_hashes(name: str = "text") -> list[Column]:
    """h1 and h2: 128 bits that tell texts apart."""
    return [F.xxhash64(text_or_empty(name)).alias("h1"), F.xxhash64(F.lit(31), text_or_empty(name)).alias("h2")]


def row_of_others(df: DataFrame, *own: str) -> Column:
    """All columns but `own` as one struct, so that an operator can carry them whatever their names are."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in own]
    return F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))


def few_by_hash(df: DataFrame, name: str, most: int) -> DataFrame:
    """At most `most` distinct values of column `name` of df, nulls aside: those with the smallest hashes, a bounded sample that
    is the same on every run. A first cut by the hash leaves about four times as many values, so that no task hands many to
    the final sort; how often a value repeats plays no part."""
    values = df.select(name).filter(F.col(name).isNotNull())
    step = max(1, values.agg(F.approx_count_distinct(name)).first()[0] // (4 * most))
    first = values.filter(F.pmod(F.xxhash64(name), F.lit(step)) == 0).distinct()
    return first.withColumn("__order", F.xxhash64(F.lit(31), name)).orderBy("__order", name).limit(most).drop("__order")
