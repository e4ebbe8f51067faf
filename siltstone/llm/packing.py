"""Packing by concatenating and cutting.

Pass one tokenizes each document once and writes its ids to the shared folder, with the tokens that lie before it in its
own partition. The partitions' totals, a number for each partition, are added up on the driver to the partitions' global
offsets. Pass two reads the ids back: a document's global offset is its partition's plus its own, so every document is cut
on its own at the fixed windows it crosses. Each piece is a boundary record: where it starts in its document and in its
sequence. All sequences but the last are full.

The vocabulary's pattern looks ahead at white space; an expression that does has to backtrack, which takes most of the
time and fails on a million spaces. So texts are cut where the look-ahead ends a piece, and the same pattern without it, in
linear time, gives the same pieces; a text without white space next to other white space needs no cut. The mark
<|endoftext|> in a text is one id, as the vocabulary's own tokenizer reads it.

Defined results: a null or empty text is the end id alone; repeated rows are packed once each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import store, text_or_empty

LENGTH, END_ID, VOCABULARY = 2048, 1, "byte_bpe_50k.tiktoken"
#: A document's end where it stands in a text: the vocabulary's added token, one id.
MARK, _MARK_ID = "<|endoftext|>", np.array([50256], "<u2").tobytes()
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where the vocabulary's pattern ends a piece by looking ahead: before the last white space of a run that a word follows.
_CUT = re.compile(f"(?<=[{_SPACES}])(?=[{_SPACES}][^{_SPACES}])")
#: What a plain text does not hold: white space next to white space or of another kind, and the mark.
_NOT_PLAIN = ("  ", "\n\n", " \n", "\n ", MARK, *"\t\r\x0b\x0c\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))


class Encoder:
    """Ids as little-endian unsigned 16-bit numbers. Nothing is cached; `cached` is taken for callers that bound a cache of words."""

    def __init__(self, path: str, cached: int = 0):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if max(ranks.values()) > 0xFFFF:
            raise ValueError("the vocabulary needs more than 16 bits")
        ending = r"|\s+(?!\S)|\s+"
        if not public_tokenizers.PATTERN.endswith(ending):
            raise ValueError("the vocabulary's pattern ends otherwise")
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN.removesuffix(ending) + r"|\s+", mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u2").tobytes()

    def encode(self, text: str) -> bytes:
        if not any(x in text for x in _NOT_PLAIN):
            return self.plain(text)
        return _MARK_ID.join(b"".join(map(self.plain, _CUT.split(part))) for part in text.split(MARK))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


TOKENS = "doc_id long, part int, before long, n long, ids binary"


def tokenized(docs: DataFrame, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, part, before, n, ids): pass one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary or public_tokenizers.path(VOCABULARY))
        end = np.array([end_id], "<u2").tobytes()
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [own.encode(t) + end for t in batch.column(1).to_pylist()]
            n = np.fromiter((len(x) // 2 for x in ids), np.int64, len(ids))
            before = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(before), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "part", "before", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, TOKENS)


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """One row for each piece; ids are little-endian unsigned 32-bit numbers. vocabulary: a file of byte-pair ranks."""
    rows = store(tokenized(docs, end_id, vocabulary), "token-ids")
    totals = {r.part: r.n for r in rows.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a number for each partition
    starts = np.zeros(max(totals, default=0) + 1, np.int64)
    for k, n in totals.items():
        starts[k] = n
    starts = np.cumsum(starts) - starts
    offsets = rows.sparkSession.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], [], [], []]
            at = offsets.value[batch.column(1).to_numpy()] + batch.column(2).to_numpy()
            for doc, first, n, ids in zip(batch.column(0).to_pylist(), at.tolist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(first + start, length)
                    size = min(n - start, length - offset)
                    for column, value in zip(out, (doc, start, size, wide[start : start + size].tobytes(), n, sequence, offset), strict=True):
                        column.append(value)
                    start += size
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    return rows.mapInArrow(run, PIECES)
