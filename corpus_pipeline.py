"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, packing. Counted as part of siltstone.llm.

Each stage works on all that the one before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, line_dedup, packing, quality, simhash
from siltstone.llm.common import id_or_least, store, table, text_hashes

#: What tells rows apart: the id and the text.
ROW = ["__id", "__h1", "__h2"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled training rows of its own input."""
    network = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, network).filter("predicted = 1").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the text. A document that loses every line stays, with an empty text."""
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, that with the smallest id. Ids that are null or repeat join no groups."""
    kept = simhash.representatives(docs).select(id_or_least().alias("__kept"), F.col("h1").alias("__k1"), F.col("h2").alias("__k2"))
    rows = docs.withColumns(dict(zip(ROW, [id_or_least(), *text_hashes()], strict=True))).dropDuplicates(ROW)
    return rows.join(kept, (F.col("__id") == F.col("__kept")) & (F.col("__h1") == F.col("__k1")) & (F.col("__h2") == F.col("__k2")), "left_semi").select(*docs.columns)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, told by their texts."""
    leaks = store(decontaminate.leaking_texts(docs, table(spark, sf_dir, "benchmark")).toDF("__k1", "__k2"), "leaking-documents")
    rows = docs.withColumns(dict(zip(ROW[1:], text_hashes(), strict=True)))
    return rows.join(leaks, (F.col("__h1") == F.col("__k1")) & (F.col("__h2") == F.col("__k2")), "left_anti").select(*docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences as pieces of documents."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", leak_stage),
    ("packing", pack_stage),
]

#: SQL can express neither the classifier nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
