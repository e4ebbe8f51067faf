"""Benchmark decontamination: rare-word seeds that lose no copy, then Smith-Waterman alignment.

Words are lower-cased runs free of white space and ASCII punctuation. A copy's score is that of the best alignment of the
item with a passage by Smith-Waterman over words (match 2, mismatch and gap -1), as a share of the item's score against
itself; `threshold` and above counts as a leak, so edited, shortened and paraphrased copies are found.

Seeds are n-grams of one word: a longer one is broken by any edit inside it, so a copy edited every few words would hold no
whole seed though its alignment passes. The seeds only rule out what cannot reach the threshold. A passing alignment matches at least threshold * m of the item's
m words and covers at most m words and the gaps that the surplus pays for. So of the item's rarest words, as many as may
be unmatched and `need` more, at least `need` stand within one such stretch of the document, whatever was edited. The words
are counted over the documents first, in how many each occurs; then each stretch with `need` seeds is widened to hold any
passing alignment, overlapping stretches are joined, and those that hold enough of the item's words are aligned. The result
is the one of aligning every item with every whole document.

The items are taken in blocks of at most `block_bytes` of text, so what is sent to the executors is bounded whatever the
benchmark's size; each block is a pass over the documents. Nothing is shuffled but the counts of the items' own words.

Items of fewer than `least_words` words leak nothing: a word or two that a document happens to hold is no copy of a test.

Defined results: null or empty texts, on either side, leak nothing; items that repeat an id are items of their own;
repeated documents are found once each; a null id is carried; an empty table gives no rows; other columns are ignored.
n_seeds is the number of the document's words that are seeds of the item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import text_hashes, text_or_empty

THRESHOLD, MATCH, PENALTY, BLOCK_BYTES, LEAST_WORDS = 0.6, 2, 1, 16 << 20, 5

_PUNCTUATION = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_TABLE = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_TABLE).split()


class Block:
    """Items of one block, as word numbers from 1 (0 is any other word)."""

    def __init__(self, items: list[tuple[int, str]], least_words: int = LEAST_WORDS):
        self.ids, self.words = [], []
        self.vocabulary: dict[bytes, int] = {}
        for item, text in items:
            words = words_of(text)
            if len(words) >= max(1, least_words):
                self.ids.append(item)
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64))

    def numbers(self, text: str) -> np.ndarray:
        words = words_of(text)
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))


class Seeds:
    """Each item's seeds, given the number of documents that hold each word: word w is a seed of items[edges[w] : edges[w + 1]]."""

    def __init__(self, block: Block, documents: np.ndarray, threshold: float):
        m = np.array([len(w) for w in block.words], np.int64)
        self.score = threshold * MATCH * m
        self.matched = np.clip(np.ceil(self.score / MATCH - 1e-9).astype(np.int64), 1, m)
        self.span = m + np.maximum((MATCH * m - self.score) // PENALTY, 0).astype(np.int64)
        self.need = -(-self.matched // 3)
        pairs = []
        for k, words in enumerate(block.words):
            rarest = words[np.lexsort((words, documents[words]))][: m[k] - self.matched[k] + self.need[k]]
            own = np.unique(rarest)
            pairs.append(np.stack([own, np.full(len(own), k)]))
        word, item = np.concatenate(pairs, 1)
        order = np.argsort(word, kind="stable")
        self.items = item[order]
        self.edges = np.searchsorted(word[order], np.arange(len(block.vocabulary) + 2))

    def stretches(self, words: np.ndarray) -> Iterator[tuple[int, int, list[list[int]]]]:
        """(item, seeds, joined [start, end)) for each item with enough seeds close together in a document."""
        at = np.flatnonzero(words)
        low, count = self.edges[words[at]], self.edges[words[at] + 1] - self.edges[words[at]]
        total = int(count.sum())
        if not total:
            return
        item = self.items[np.repeat(low - np.cumsum(count) + count, count) + np.arange(total)]
        order = np.argsort(item, kind="stable")
        item, place = item[order], np.repeat(at, count)[order]
        last = np.arange(total) + self.need[item] - 1
        end = np.minimum(last, total - 1)
        good = np.flatnonzero((last < total) & (item[end] == item) & (place[end] - place < self.span[item]))
        joined: dict[int, list[list[int]]] = {}
        for k, p in zip(item[good].tolist(), place[good].tolist(), strict=True):
            span, runs = int(self.span[k]), joined.setdefault(k, [])
            low, high = max(0, p - span), min(len(words), p + span)
            if runs and low < runs[-1][1]:
                runs[-1][1] = high
            else:
                runs.append([low, high])
        for k, runs in joined.items():
            yield k, int(np.searchsorted(item, k + 1) - np.searchsorted(item, k)), runs


def align(item: np.ndarray, passage: np.ndarray, match: int = MATCH, penalty: int = PENALTY) -> tuple[int, int, int]:
    """Smith-Waterman over word numbers: the best score and the passage's words [start, end) it covers."""
    m = len(passage)
    index = np.arange(1, m + 1)
    score, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    best, best_at = 0, (0, 0)
    for word in item:
        same = passage == word
        diagonal = score[:-1] + np.where(same, match, -penalty)
        above = score[1:] - penalty
        take = diagonal >= above
        gain, begun = np.where(take, diagonal, above), np.where(take, start[:-1], start[1:])
        fresh = gain <= 0
        gain, begun = np.where(fresh, 0, gain), np.where(fresh, index, begun)
        # a gap in the item costs `penalty` a word: the running maximum of gain + penalty * position
        lifted = gain + penalty * index
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(m), 0))
        score = np.concatenate([[0], np.maximum(top - penalty * index, 0)])
        begun = np.where(score[1:] > 0, begun[source], index)
        start = np.concatenate([[0], begun])
        at = int(np.argmax(score))
        if score[at] > best:
            best, best_at = int(score[at]), (int(start[at]), at)
    return best, *best_at


def leaks_in(block: Block, words: np.ndarray, seeds: Seeds) -> list[tuple[int, float, int, int, int]]:
    """(item index, score, seeds, start, end) of the best passage for each item that leaks."""
    out = []
    for item, n_seeds, runs in seeds.stretches(words):
        own, matched, span = block.words[item], int(seeds.matched[item]), int(seeds.span[item])
        distinct = np.unique(own)
        best = (0, 0, 0)
        tried = {}
        for low, high in runs:
            passage = words[low:high]
            key = passage.tobytes()  # a passage repeated within the document is aligned once
            if key not in tried:
                held = distinct[np.minimum(np.searchsorted(distinct, passage), len(distinct) - 1)] == passage
                within = np.cumsum(held)
                within[span:] -= within[:-span].copy()
                enough = within.max() >= matched and np.isin(own, passage).sum() >= matched
                tried[key] = align(own, passage) if enough else (0, 0, 0)
            score, a, b = tried[key]
            if score > best[0]:
                best = (score, low + a, low + b)
        if best[0] > 0 and best[0] >= seeds.score[item]:
            out.append((item, best[0] / (MATCH * len(own)), n_seeds, best[1], best[2]))
    return out


def blocks_of(spark: SparkSession, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, least_words: int = LEAST_WORDS) -> Iterator[Block]:
    """The items in blocks of bounded text, one after the other."""
    items, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).toLocalIterator():
        n = len(row.text.encode())
        if items and size + n > block_bytes:
            yield Block(items, least_words)
            items, size = [], 0
        items.append((row.item_id, row.text))
        size += n
    if items:
        yield Block(items, least_words)


LEAKS = "doc_id long, item_id long, score double, n_seeds long, start_word long, end_word long"


def _of_block(docs: DataFrame, block: Block, threshold: float) -> DataFrame | None:
    if not block.ids:
        return None
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(block)  # at most block_bytes of text

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        seen = np.zeros(len(own.vocabulary) + 1, np.int64)
        for batch in batches:
            for text in batch.column(1).to_pylist():
                seen[own.numbers(text)] += 1  # once a document: repeated indexes are added once
        at = np.flatnonzero(seen[1:]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["word", "n"])

    documents = np.zeros(len(block.vocabulary) + 1, np.int64)
    for r in docs.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator():
        documents[r.word] = r.n
    schema = ", ".join([LEAKS, *(f"{c} long" for c in docs.columns[2:])])
    seeds = spark.sparkContext.broadcast(Seeds(block, documents, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chosen = sent.value, seeds.value
        for batch in batches:
            rows = []
            for at, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                rows += [(at, doc, own.ids[item], *rest) for item, *rest in leaks_in(own, own.numbers(text), chosen)]
            at, *columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            arrays += [batch.column(k).take(pa.array(at, pa.int64())) for k in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in schema.split(", ")])

    return docs.mapInArrow(run, schema)


def leaking_texts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(h1, h2), the hashes of the texts that hold an item: a leak is a matter of the text, whatever a document's id."""
    return leaks(docs, benchmark, hashed=True).select("h1", "h2").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES, hashed: bool = False, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, item_id, score, n_seeds, start_word, end_word): each item that a document holds, with its best passage;
    hashed: and the text's hashes."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *(text_hashes() if hashed else []))
    out = None
    for block in blocks_of(spark, benchmark, block_bytes, least_words):
        found = _of_block(texts, block, threshold)
        if found is not None:
            out = found if out is None else out.unionAll(found)
    return out if out is not None else spark.createDataFrame([], LEAKS + (", h1 long, h2 long" if hashed else ""))
