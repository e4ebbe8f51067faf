"""LM scoring with a gated recurrent network in numpy.

Counts: every training document's tokens (lower-cased words, then one end) are counted. They give the base score, an
additively smoothed unigram. The `head` most frequent words, a bounded table, go to the executors; the counts of all other
words reach their documents by a join, so every token's count is exact.

Texts are split twice: for the counts, and for the table of ids, on which training and scoring both work.

Model: a GRU over the `vocabulary` most frequent words and one unknown word. Its output softmax is factored into classes of
words of similar frequency: P(word) = P(class | state) * P(word | class, state). An unknown word is spelled by its count:
P(unknown | state) times its share of the smoothed unigram mass outside the vocabulary, so the model spreads exactly one
unit of probability over the same events as the base.

Training covers all training documents. They are laid end to end on parallel lanes; the state is carried over windows and
reset where a document begins. Truncated backpropagation (k1, k2): every token is a target; the weights change after each
`K1` steps, by the loss of all of them, whose gradient goes back within stretches of `K2` steps. Every partition trains its own copy, and the copies are averaged, weighted by
their tokens, in a tree of bounded fan-in; a second round starts from the average.

Scoring lays the documents out in the same way and sums every token's log-probability, so long documents are scored whole.

Defined results: a null or empty text is its end token; repeated rows are scored once each; a null id counts as the empty
string for the split; with no training documents N and V are 0 and the model falls back to uniform weights; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import store, text_or_empty

HEAD, VOCABULARY, HIDDEN, CLASSES, K1, K2, LANES, ROUNDS, FAN_IN, SMOOTH, FOLDS = 1 << 17, 2000, 16, 40, 32, 16, 512, 2, 16, 0.1, 10
#: Frequent words whose input gradients are summed by a product; it changes the time alone.
OFTEN = 14
#: Tokens that are laid out at a time.
CHUNK = 4_000_000
END = b""


def tokens(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


def fold(folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary")) % folds


# ---- counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "c"])

    for batch in batches:
        for text in batch.column(1).to_pylist():
            found.update(tokens(text))
            if len(found) > 300_000:
                yield out()
                found = Counter()
    yield out()


def counts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text binary). (word, c)."""
    return docs.mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counted: DataFrame, head: int = HEAD) -> tuple[int, int, list[tuple[bytes, int]]]:
    """N, V and at most `head` most frequent words, cut between classes of counts an eighth of a power of two wide."""
    width = F.floor(F.log2("c") * 8)
    sizes = counted.groupBy(width.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect()  # at most 8 * 63 rows
    total, distinct = sum(r.c for r in sizes), sum(r.n for r in sizes)
    least, taken = None, 0
    for r in sorted(sizes, key=lambda r: -r.w):
        taken += r.n
        if taken > head:
            break
        least = r.w
    rows = counted.filter(width >= least).toPandas() if least is not None else None
    words = list(zip(map(bytes, rows.word), rows.c.tolist(), strict=True)) if rows is not None else []
    return total, distinct, sorted(words, key=lambda x: (-x[1], x[0]))


# ---- the network


class Shape:
    """Words, classes and the split of a flat weight vector. Word ids below `size` are in the vocabulary; `size` is the
    unknown word, `size + 1` a document's beginning."""

    def __init__(self, word_counts: np.ndarray, unknown: float, hidden: int = HIDDEN, classes: int = CLASSES):
        self.size, self.hidden = len(word_counts), hidden
        mass = np.append(word_counts, max(unknown, 1)) + SMOOTH
        order = np.argsort(-mass, kind="stable")
        root = np.sqrt(mass[order])
        at = (np.cumsum(root) - root / 2) / root.sum()
        group = np.minimum((at * classes).astype(np.int64), classes - 1)
        group = np.unique(group, return_inverse=True)[1]
        self.classes = int(group[-1]) + 1
        # the output's columns stand in class order: class k has columns edges[k] to edges[k + 1]
        self.edges = np.searchsorted(group, np.arange(self.classes + 1))
        self.class_of, self.place = np.zeros(self.size + 1, np.int16), np.zeros(self.size + 1, np.int64)
        self.class_of[order] = group
        self.place[order] = np.arange(self.size + 1) - self.edges[group]
        self.mass = mass[order]
        self.kind = "<u2" if self.size + 1 < 0x10000 else "<u4"  # of stored ids
        h = hidden
        self.parts = {"input": (self.size + 2, 3 * h), "state": (h, 3 * h), "bias": (3 * h,), "class": (h, self.classes), "class_bias": (self.classes,), "word": (h, self.size + 1), "word_bias": (self.size + 1,)}

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.parts.items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def start(self, seed: int = 5) -> np.ndarray:
        """Weights whose output is the unigram."""
        rng = np.random.default_rng(seed)
        flat = np.zeros(sum(int(np.prod(s)) for s in self.parts.values()), np.float32)
        w = self.split(flat)
        w["input"][:] = rng.normal(0, 0.3, w["input"].shape)
        w["state"][:] = rng.normal(0, 1 / np.sqrt(self.hidden), w["state"].shape)
        w["bias"][self.hidden : 2 * self.hidden] = 1  # keep the state at first
        sums = np.add.reduceat(self.mass, self.edges[:-1])
        w["class_bias"][:] = np.log(sums / sums.sum())
        w["word_bias"][:] = np.log(self.mass / np.repeat(sums, np.diff(self.edges)))
        return flat


class Cell:
    """The GRU over all lanes at once. Arrays run (units, lanes), so that each gate is one stretch of memory. The squashing
    function is x / (1 + |x|), several times as fast in numpy as tanh; a gate is half of it plus one half."""

    def __init__(self, w: dict[str, np.ndarray], hidden: int):
        self.n = hidden
        self.input = np.ascontiguousarray((w["input"] + w["bias"]).T)
        self.state = np.ascontiguousarray(w["state"].T)

    def gates(self, before: np.ndarray) -> np.ndarray:
        """What the inputs give to the gates: (steps, 3 * units, lanes)."""
        out = np.empty((len(before), *self.input.shape[:1], before.shape[1]), self.input.dtype)
        for ids, to in zip(before, out, strict=True):
            np.take(self.input, ids, axis=1, out=to, mode="clip")
        return out

    def step(self, x: np.ndarray, h: np.ndarray, u: np.ndarray, out: np.ndarray) -> None:
        """One step from h to out. x, the gates' inputs, becomes the gates: reset, keep, candidate; u becomes state @ h."""
        n = self.n
        np.matmul(self.state, h, out=u)
        rz, new = x[: 2 * n], x[2 * n :]
        rz += u[: 2 * n]
        size = np.abs(rz)
        size += 1
        rz /= size
        rz *= 0.5
        rz += 0.5
        np.multiply(rz[:n], u[2 * n :], out=out)
        new += out
        np.abs(new, out=out)
        out += 1
        new /= out
        np.subtract(h, new, out=out)
        out *= rz[n:]
        out += new


def log_probs(shape: Shape, w: dict, states: np.ndarray, targets: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural-log probabilities of target ids given states (rows); with grad, adds the mean loss's gradients to it and
    returns that of the states."""
    n = len(targets)
    groups, place = shape.class_of[targets], shape.place[targets]
    order = np.argsort(groups, kind="stable")  # a radix sort
    states = np.concatenate([states, np.ones((n, 1), states.dtype)], 1)[order]  # the last column meets the bias
    groups, place = groups[order], place[order]
    edges = np.searchsorted(groups, np.arange(shape.classes + 1)).tolist()
    found = np.zeros(n, states.dtype)
    back = None if grad is None else np.zeros((n, shape.hidden), states.dtype)

    def softmax(low: int, high: int, weights: np.ndarray, bias: np.ndarray, cols: np.ndarray, to: tuple | None) -> None:
        some, rows = states[low:high], np.arange(high - low)
        p = some @ np.concatenate([weights, bias[None]])
        own = p[rows, cols]
        np.exp(p, out=p)  # the state is within [-1, 1], so the logits are bounded by the weights
        total = p @ np.ones(p.shape[1], p.dtype)
        found[low:high] += own - np.log(total)
        if to is not None:
            p[rows, cols] -= total
            share = (1 / (n * total))[:, None]
            both = p.T @ (some * share)
            to[0][:] += both[:, :-1].T
            to[1][:] += both[:, -1]
            back[low:high] += (p @ weights.T) * share

    for low in range(0, n, 4096):  # a block stays in the processor's cache
        high = min(low + 4096, n)
        softmax(low, high, w["class"], w["class_bias"], groups[low:high], None if grad is None else (grad["class"], grad["class_bias"]))
    for k in range(shape.classes):
        low, high, a, b = edges[k], edges[k + 1], shape.edges[k], shape.edges[k + 1]
        if low < high and b - a > 1:
            softmax(low, high, w["word"][:, a:b], w["word_bias"][a:b], place[low:high], None if grad is None else (grad["word"][:, a:b], grad["word_bias"][a:b]))
    out = np.empty_like(found)
    out[order] = found
    if back is not None:
        unsorted = np.empty_like(back)
        unsorted[order] = back
        back = unsorted
    return out, back


def lay_out(ids: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents end to end on lanes of nearly equal length, longest first: ids and documents, (steps, lanes); document
    -1 is padding."""
    lanes = max(1, min(lanes, len(ids)))
    total = sum(map(len, ids))
    longest = max(map(len, ids))
    lanes = max(1, min(lanes, total // max(longest, 1) + 1))
    load = [(0, k) for k in range(lanes)]
    import heapq

    placed: list[list[int]] = [[] for _ in range(lanes)]
    for doc in sorted(range(len(ids)), key=lambda i: -len(ids[i])):
        size, lane = heapq.heappop(load)
        placed[lane].append(doc)
        heapq.heappush(load, (size + len(ids[doc]), lane))
    steps = max(n for n, _ in load)
    out, of = np.zeros((steps, lanes), ids[0].dtype), np.full((steps, lanes), -1, np.int32)
    for lane, docs in enumerate(placed):
        if docs:
            row = np.concatenate([ids[i] for i in docs])
            out[: len(row), lane] = row
            of[: len(row), lane] = np.repeat(docs, [len(ids[i]) for i in docs])
    return out, of


def inputs(laid: np.ndarray, of: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids before each, `begin` where a document begins; and where that is."""
    first = np.ones(laid.shape, bool)
    first[1:] = of[1:] != of[:-1]
    before = np.empty_like(laid)
    before[1:] = laid[:-1]
    before[first] = begin
    return before, first


def train(shape: Shape, flat: np.ndarray, laid: np.ndarray, of: np.ndarray, moments: list, rate: float, k1: int = K1, k2: int = K2) -> None:
    """Truncated backpropagation over one layout; changes flat and moments (Adam's, and the number of steps). Every token is
    a target: the weights change after each k1 steps, by the mean loss of those, which goes back within stretches of k2."""
    w = shape.split(flat)
    before, first = inputs(laid, of, shape.size + 1)
    any_first = first.any(1).tolist()
    n, lanes, kind = shape.hidden, laid.shape[1], flat.dtype
    carried = np.zeros((n, lanes), kind)
    # arrays of all windows: fresh ones would cost a page fault for every few thousand bytes
    all_u, all_gates, all_us = (np.empty((k1, 3 * n, lanes), kind) for _ in range(3))
    all_starts, all_states = (np.empty((k1, n, lanes), kind) for _ in range(2))
    all_rows = np.empty((k1 * lanes, n), kind)
    slope, left = np.empty((2 * n, lanes), kind), np.empty((n, lanes), kind)
    often = np.unique([*range(min(OFTEN, shape.size)), shape.size, shape.size + 1]).astype(laid.dtype)
    is_often = np.zeros(shape.size + 2, bool)
    is_often[often] = True
    for low in range(0, len(laid), k1):
        high = min(low + k1, len(laid))
        live = of[low:high].ravel() >= 0
        if not live.any():
            break
        steps = high - low
        grad_flat = np.zeros_like(flat)
        grad = shape.split(grad_flat)
        cell = Cell(w, n)
        x = cell.gates(before[low:high])
        u, starts, states = all_u[:steps], all_starts[:steps], all_states[:steps]
        for t in range(steps):
            h = starts[t]
            if any_first[low + t]:
                np.multiply(states[t - 1] if t else carried, ~first[low + t], out=h)
            else:
                h[:] = states[t - 1] if t else carried
            cell.step(x[t], h, u[t], states[t])
        carried = states[-1].copy()
        at = np.flatnonzero(live)
        rows = all_rows[: steps * lanes]
        rows.reshape(steps, lanes, n)[:] = states.transpose(0, 2, 1)
        _, d_states = log_probs(shape, w, rows if len(at) == len(live) else rows[at], laid[low:high].ravel()[at], grad)
        d_all = d_states
        if len(at) < len(live):
            d_all = np.zeros_like(rows)
            d_all[at] = d_states
        d_all = np.ascontiguousarray(d_all.reshape(steps, lanes, n).transpose(0, 2, 1))
        d_gates, d_us = all_gates[:steps], all_us[:steps]
        back = np.ascontiguousarray(w["state"])
        dh = np.zeros((n, lanes), kind)
        for t in range(steps - 1, -1, -1):
            if (t + 1) % k2 == 0:
                dh = d_all[t]
            else:
                dh += d_all[t]
            g, d_u, r, z, new = d_gates[t], d_us[t], x[t, :n], x[t, n : 2 * n], x[t, 2 * n :]
            d_new, own = g[2 * n :], d_u[: 2 * n]
            # the candidate's slope is (1 - |new|) squared; a gate's is 2 min(gate, 1 - gate) squared
            np.abs(new, out=d_new)
            np.subtract(1, d_new, out=d_new)
            d_new *= d_new
            np.subtract(1, x[t, : 2 * n], out=slope)
            d_new *= slope[n:]
            d_new *= dh
            np.minimum(slope, x[t, : 2 * n], out=slope)
            slope *= slope
            slope *= 2
            np.multiply(d_new, u[t, 2 * n :], out=own[:n])
            np.subtract(starts[t], new, out=own[n:])
            own[n:] *= dh
            own *= slope
            g[: 2 * n] = own
            np.multiply(d_new, r, out=d_u[2 * n :])
            dh *= z
            np.matmul(back, d_u, out=left)
            dh += left
            if any_first[low + t]:
                dh *= ~first[low + t]
        grad["state"] += np.matmul(starts, d_us.transpose(0, 2, 1)).sum(0)
        # the sum of each id's rows: most tokens have one of few ids, whose sums are one product; the others' rows are sorted
        ids = before[low:high]
        grad["input"][often] += np.matmul((ids[:, None] == often[:, None]).astype(kind), d_gates.transpose(0, 2, 1)).sum(0)
        rest = np.flatnonzero(~is_often[ids])
        if len(rest):
            seldom = ids.ravel()[rest]
            order = np.argsort(seldom, kind="stable")
            seldom, (step, lane) = seldom[order], np.divmod(rest[order], lanes)
            edges = np.flatnonzero(np.diff(seldom, prepend=-1))
            grad["input"][seldom[edges]] += np.add.reduceat(d_gates[step, :, lane], edges, axis=0)
        grad["bias"] += grad["input"].sum(0)  # every step has one input
        norm = float(np.sqrt((grad_flat * grad_flat).sum()))
        if norm > 1:
            grad_flat /= norm
        moments[2] += 1
        moments[0] += 0.1 * (grad_flat - moments[0])
        moments[1] += 0.01 * (grad_flat * grad_flat - moments[1])
        flat -= rate * (moments[0] / (1 - 0.9 ** moments[2])) / (np.sqrt(moments[1] / (1 - 0.99 ** moments[2])) + 1e-6)


def score_laid(shape: Shape, flat: np.ndarray, laid: np.ndarray, of: np.ndarray, n_docs: int, window: int = 64) -> np.ndarray:
    """Each document's natural-log probability, unknown words as the unknown word; the state runs on from window to window."""
    w = shape.split(flat)
    cell = Cell(w, shape.hidden)
    before, first = inputs(laid, of, shape.size + 1)
    out = np.zeros(n_docs)
    h = np.zeros((shape.hidden, laid.shape[1]), flat.dtype)
    for low in range(0, len(laid), window):
        live = np.flatnonzero((of[low : low + window] >= 0).any(0))  # lanes that have ended drop out
        if not len(live):
            break
        if len(live) < h.shape[1]:
            h, laid, of, before, first = h[:, live], laid[:, live], of[:, live], before[:, live], first[:, live]
        high = min(low + window, len(laid))
        states = np.empty((high - low, shape.hidden, len(live)), flat.dtype)
        x = cell.gates(before[low:high])
        u = np.empty_like(x[0])
        for t in range(high - low):
            cell.step(x[t], h * ~first[low + t], u, states[t])
            h = states[t]
        docs = of[low:high].ravel()
        at = np.flatnonzero(docs >= 0)
        found, _ = log_probs(shape, w, states.transpose(0, 2, 1).reshape(-1, shape.hidden)[at], laid[low:high].ravel()[at])
        out += np.bincount(docs[at], found, minlength=n_docs)
    return out


# ---- distributed training


def _chunks(ids: Iterator[np.ndarray], most: int) -> Iterator[list[np.ndarray]]:
    own, n = [], 0
    for x in ids:
        own.append(x)
        n += len(x)
        if n >= most:
            yield own
            own, n = [], 0
    if own:
        yield own


def _lanes(n: int, most: int) -> int:
    return int(np.clip(n // 2048, 8, most))


def trained(encoded: DataFrame, shape: Shape, rounds: int = ROUNDS, lanes: int = LANES, fan_in: int = FAN_IN) -> np.ndarray:
    """Averaged weights of the partitions' copies. encoded: (ids binary) of the training documents."""
    spark = encoded.sparkSession
    flat = shape.start()
    sent_shape = spark.sparkContext.broadcast(shape)
    for number in range(rounds):
        sent = spark.sparkContext.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, number=number) -> Iterator[pa.RecordBatch]:
            own, shape = sent.value.copy(), sent_shape.value
            moments, seen = [np.zeros_like(own), np.zeros_like(own), 0], 0
            ids = (np.frombuffer(x, shape.kind) for batch in batches for x in batch.column(0).to_pylist())
            for chunk in _chunks(ids, CHUNK):
                n = sum(map(len, chunk))
                seen += n
                train(shape, own, *lay_out(chunk, _lanes(n, lanes)), moments, 0.01 / (1 + 2 * number))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(seen)]), pa.array([own.tobytes()], pa.binary())], ["k", "n", "w"])

        copies = store(encoded.select("ids").mapInArrow(run, "k long, n double, w binary"), "lm-copies")
        left = copies.count()
        while left > 1:
            copies = copies.withColumn("k", F.floor(F.col("k") / fan_in)).groupBy("k").applyInArrow(_average, "k long, n double, w binary")
            copies = store(copies, "lm-copies")
            left = copies.count()
        row = copies.first()
        if row is not None:
            flat = np.frombuffer(row.w, np.float32).copy()
    return flat


def _average(rows: pa.Table) -> pa.Table:
    n = rows.column("n").to_numpy()
    total = None
    for share, w in zip(n / n.sum(), rows.column("w"), strict=True):
        part = np.frombuffer(w.as_buffer(), np.float32) * np.float32(share)
        total = part if total is None else total + part
    return pa.table({"k": pa.array([rows.column("k")[0].as_py()], pa.int64()), "n": pa.array([float(n.sum())]), "w": pa.array([total.tobytes()], pa.binary())})


# ---- scoring

ROWS = "uid long, doc_id long, n_tokens long, n_known long, base double, spell double, ids binary, words array<binary>, times array<int>"


def encoded(texts: DataFrame, index: dict[bytes, int], numbers: np.ndarray, shape: Shape, mass: float, outside: float) -> DataFrame:
    """texts (doc_id, text binary) as ids below shape.size + 1, with what the counts alone decide: the base score and the
    spelling of unknown words, both without the words outside the head, which are listed with their times."""
    sent = texts.sparkSession.sparkContext.broadcast((shape.size, shape.kind, index, np.append(np.log10(numbers + SMOOTH), 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, kind, index, logs = sent.value
        get, uid = index.get, TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for low, high in _slices(column, 8 << 20):
                split = [tokens(t) for t in column.slice(low, high - low).to_pylist()]
                n = len(split)
                sizes = np.fromiter(map(len, split), np.int64, n)
                flat_words = [w for own in split for w in own]
                found = np.fromiter(map(get, flat_words, repeat(len(index))), np.int32, len(flat_words))
                starts = np.cumsum(sizes) - sizes
                doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
                of_token = logs[found]
                base = np.add.reduceat(of_token, starts)
                rare = np.flatnonzero(found == len(index))
                spelled = np.flatnonzero(found >= size)
                spell = np.bincount(doc[spelled], of_token[spelled], minlength=n) - np.bincount(doc[spelled], minlength=n) * np.log10(outside)
                modelled = np.minimum(found, size).astype(kind)
                rare_words = [flat_words[i] for i in rare.tolist()]
                edges = np.searchsorted(doc[rare], np.arange(n + 1, dtype=np.int32)).tolist()
                tails = [Counter(rare_words[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in tails])]), pa.int32())
                tail_words = pa.ListArray.from_arrays(offsets, pa.array([w for x in tails for w in x], pa.binary()))
                tail_times = pa.ListArray.from_arrays(offsets, pa.array([c for x in tails for c in x.values()], pa.int32()))
                known = sizes - np.bincount(doc[rare], minlength=n)
                packed = pa.array([x.tobytes() for x in np.split(modelled, starts[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid + np.arange(n)), ids.slice(low, high - low), pa.array(sizes), pa.array(known), pa.array(base - sizes * np.log10(mass)), pa.array(spell), packed, tail_words, tail_times],
                    [c.split()[0] for c in ROWS.split(", ")],
                )
                uid += n

    return texts.mapInArrow(run, ROWS)


def modelled(encoded: DataFrame, shape: Shape, flat: np.ndarray, lanes: int = LANES) -> DataFrame:
    """encoded (uid, doc_id, n_tokens, n_known, base, spell, ids) with the model's log10 probability instead of ids and spell."""
    sent = encoded.sparkSession.sparkContext.broadcast((shape, flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, flat = sent.value
        rows = (batch.slice(k, 1) for batch in batches for k in range(batch.num_rows))

        def done(own: list[pa.RecordBatch], n: int) -> pa.RecordBatch:
            table = pa.Table.from_batches(own).combine_chunks()
            ids = [np.frombuffer(x, shape.kind) for x in table.column("ids").to_pylist()]
            model = score_laid(shape, flat, *lay_out(ids, _lanes(n, lanes)), len(ids)) / np.log(10)
            table = table.append_column("score", pa.array(model + table.column("spell").to_numpy()))
            return table.select(["uid", "doc_id", "n_tokens", "n_known", "base", "score"]).to_batches()[0]

        own, n = [], 0
        for row in rows:
            own.append(row)
            n += row.column(2)[0].as_py()
            if n >= CHUNK:
                yield done(own, n)
                own, n = [], 0
        if own:
            yield done(own, n)

    return encoded.select("uid", "doc_id", "n_tokens", "n_known", "base", "spell", "ids").mapInArrow(run, "uid long, doc_id long, n_tokens long, n_known long, base double, score double")


def score(docs: DataFrame, head: int = HEAD, vocabulary: int = VOCABULARY, folds: int = FOLDS, rounds: int = ROUNDS, lanes: int = LANES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs; log10."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    counted = store(counts(texts.filter(fold(folds) != 0)), "lm-counts")
    n, v, top = frequent(counted, head)
    words, numbers = [w for w, _ in top], np.array([c for _, c in top], float)
    known = numbers[:vocabulary]
    shape = Shape(known, n - known.sum())
    mass = n + SMOOTH * (v + 1)
    ids = store(encoded(texts, {w: k for k, w in enumerate(words)}, numbers, shape, mass, mass - (known + SMOOTH).sum()), "lm-ids")
    rows = modelled(ids, shape, trained(ids.filter(fold(folds) != 0), shape, rounds, lanes), lanes)
    rare = ids.select("uid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("uid", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    seen = F.coalesce("c", F.lit(0))
    rare = rare.join(counted, "word", "left").groupBy("uid").agg(F.sum(F.col("times") * F.log10(seen + SMOOTH)).alias("logs"), F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    rare = rare.withColumnRenamed("uid", "rare_uid")
    logs = F.coalesce("logs", F.lit(0.0))
    out = rows.join(rare, rows.uid == rare.rare_uid, "left")
    return out.select(
        "doc_id", (fold(folds) == 0).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("score") + logs).alias("score"),
    )


def _slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, or one row."""
    sizes = np.fromiter((0 if x is None else x for x in pa.compute.binary_length(column).to_pylist()), np.int64, len(column))
    low, n = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > low and n + size > most:
            yield low, k
            low, n = k, 0
        n += size
    if len(sizes) > low:
        yield low, len(sizes)
