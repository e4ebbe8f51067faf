"""Line dedup over levelled sorted runs of line hashes.

The store is a log-structured set of runs in the shared folder. A run holds, sorted by the 128-bit hash of a line's key,
how many documents hold the key and the largest id among them. Batches of documents arrive by descending id. Each batch
first merge-anti-joins the runs: a key that the runs have settled already (held by `min_docs` documents, all with larger
ids) cannot change any more and is not added again. What is left becomes a new level-0 run. `fanout` runs of one level
are compacted to one run of the next.

A key's lines go from every document but the one with the largest id, if the key has at least `min_chars` code points
and at least `min_docs` documents hold it. Texts move once: the hashes to drop are collected for each document and
joined to it.

Defined results: a null or empty text is one empty line; a null id counts as one document with the smallest id; rows that
repeat an id are one document (its lines are lost or kept together); an empty table gives no rows; other columns are
carried unchanged whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import SPACES, id_or_least, remove, row_of_others, store, text_or_empty, work_path

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 20, 3, 4, 2


def line_key(line: bytes) -> bytes:
    return line.strip(SPACES).lower()  # bytes.lower() changes A-Z only


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)


def _digests(text: bytes, min_chars: int) -> set[bytes]:
    keys = map(line_key, text.split(b"\n"))
    return {xxhash.xxh3_128_digest(k) for k in keys if len(k) >= min_chars and long_enough(k, min_chars)}


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(did, h1, h2): the distinct hashes of each row's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for did, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = _digests(text, min_chars)
                ids += [did] * len(own)
                found += own
            pair = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["did", "h1", "h2"])

    return docs.select("did", "text").mapInArrow(run, "did long, h1 long, h2 long")


class LineRuns:
    """The levelled runs: rows (h1, h2, n, last), n documents and the largest id."""

    SCHEMA = "h1 long, h2 long, n long, last long"

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, min_docs: int = MIN_DOCS):
        self.spark, self.fanout, self.min_docs, self.levels = spark, fanout, min_docs, []

    def all(self) -> DataFrame:
        """Every run's rows; a key may have one in several runs."""
        paths = [p for level in self.levels for p in level]
        return self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)

    def merged(self) -> DataFrame:
        return self.all().groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def _write(self, rows: DataFrame, level: int) -> None:
        path = work_path(self.spark, f"line-run-{level}")
        rows.sortWithinPartitions("h1", "h2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def add(self, lines: DataFrame) -> None:
        """lines: (did, h1, h2) of a batch whose ids are smaller than those of all batches before, and not in them."""
        own = lines.select("h1", "h2", "did").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("did").alias("last"))
        if any(self.levels):
            settled = self.merged().filter(F.col("n") >= self.min_docs).select("h1", "h2")
            own = own.join(settled.hint("merge"), ["h1", "h2"], "left_anti")
        self._write(own, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        old = self.levels[level]
        runs = self.spark.read.schema(self.SCHEMA).parquet(*old)
        self._write(runs.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last")), level + 1)
        self.levels[level] = []
        for path in old:
            remove(self.spark, path)


def build_runs(lines: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, min_docs: int = MIN_DOCS) -> LineRuns:
    """Adds stored lines, batch after batch by descending id, to a new set of runs."""
    runs = LineRuns(lines.sparkSession, fanout, min_docs)
    cuts = lines.agg(F.percentile_approx("did", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    edges = sorted(set(cuts or []))
    for k in range(len(edges), -1, -1):
        part = lines
        if k < len(edges):
            part = part.filter(F.col("did") < edges[k])
        if k > 0:
            part = part.filter(F.col("did") >= edges[k - 1])
        runs.add(part)
    return runs


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs (doc_id, text, ...) with the repeated lines gone from text, and n_lines, n_dropped; a column of the input with
    such a name gives way to the operator's."""
    own = docs.select("doc_id", id_or_least().alias("did"), text_or_empty().cast("binary").alias("text"), row_of_others(docs, "doc_id", "text", "n_lines", "n_dropped").alias("rest"))
    lines = store(hashed_lines(own, min_chars), "line-hashes")
    runs = build_runs(lines, batches, fanout, min_docs)
    # stored, so that the join has a plain side and adaptive execution can split a hot key's lines
    repeated = store(runs.merged().filter(F.col("n") >= min_docs), "repeated-lines")
    lost = lines.join(repeated, ["h1", "h2"]).filter(F.col("did") < F.col("last"))
    lost = lost.groupBy("did").agg(F.collect_set(F.struct("h1", "h2")).alias("lost")).withColumnRenamed("did", "lost_did")
    joined = own.join(lost, own.did == lost.lost_did, "left").select("doc_id", "text", "lost", "rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, gone = [], [], []
            lost = batch.column(2)
            for k, text in enumerate(batch.column(1).to_pylist()):
                lines = text.split(b"\n")
                total.append(len(lines))
                if lost[k].is_valid:
                    own = lost[k].values
                    pairs = np.stack([own.field(0).to_numpy(), own.field(1).to_numpy()], 1).astype("<i8").tobytes()
                    drop = {pairs[i : i + 16] for i in range(0, len(pairs), 16)}
                    lines = [x for x in lines if not (long_enough(key := line_key(x), min_chars) and xxhash.xxh3_128_digest(key) in drop)]
                    text = b"\n".join(lines)
                gone.append(total[-1] - len(lines))
                texts.append(text)
            new = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), new, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), batch.column(3)], ["doc_id", "text", "n_lines", "n_dropped", "rest"])

    schema = T.StructType([joined.schema["doc_id"], *T.StructType.fromDDL("text string, n_lines long, n_dropped long"), joined.schema["rest"]])
    out = joined.mapInArrow(run, schema)
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_dropped")]
    return out.select("doc_id", "text", "n_lines", "n_dropped", *[F.col("rest").getField(c).alias(c) for c in others])
