"""Quality classifier by positive-unlabelled learning.

The model sees trusted positives (training rows whose label is 1) and unlabelled web text (training rows of any kind, labels
unread). It minimises the non-negative unbiased risk of Kiryo et al. (2017),

    prior * R_positive(+1) + max(0, R_unlabelled(-1) - prior * R_positive(-1)),

with the logistic loss over a one-hidden-layer network in numpy. The class prior is estimated from the same two sets, without
any label 0, by best bin estimation (Garg et al., 2021): a network is fitted on one half of each set to tell positives from
unlabelled text; on the other half, over the thresholds of its score, the least ratio of the unlabelled share above the
threshold to the positive share above it bounds the prior, with an allowance for the shares' errors. Training takes the
estimate less three standard errors, as too high a prior counts negatives among the positives while one slightly too low
costs little. Inputs are statistics of the whole text alone (characters, words, repeats, lines).

Training takes at most `sample` positives and `sample` unlabelled rows, the ones with the smallest hashes of their ids;
nothing else is bounded. Of rows that repeat an id, the one with the greatest text is learnt from. Scores are the network's posterior, computed for every document in one pass over its whole text.

Defined results: a null or empty text is scored from the statistics of an empty text; repeated rows get equal scores; a
null id is held out unless crc32 of the empty string says otherwise, never labelled; with no labelled positives every
score is 0.5; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import few_by_hash, text_or_empty

SAMPLE, THRESHOLD, HIDDEN, FOLDS = 6000, 0.3, 16, 5

#: Byte classes whose shares are inputs.
CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)), "space": b" ", "break": b"\n", "stop": b".", "comma": b",", "bang": b"!?", "pipe": b"|", "star": b"*#$%&@^~",
    "bracket": b"<>{}[]()", "quote": b"\"'`", "slash": b"/\\=+_-:;", "control": bytes([*range(10), *range(11, 32), 127]), "high": bytes(range(128, 256)),
}
_TABLE = np.zeros((256, len(CLASSES)))
for _k, _bytes in enumerate(CLASSES.values()):
    _TABLE[list(_bytes), _k] = 1
FEATURES = len(CLASSES) + 16


def features(text: bytes) -> np.ndarray:
    """Statistics of the whole text."""
    out = np.zeros(FEATURES)
    n = len(text)
    if not n:
        out[-1] = 1
        return out
    out[: len(CLASSES)] = np.sqrt(np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _TABLE / n)
    words = text.split()
    lines = text.split(b"\n")
    at = len(CLASSES)
    out[at] = np.log1p(n)
    if words:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        count = len(words)
        out[at + 1] = np.log1p(count)
        out[at + 2] = np.log1p(lengths.mean())
        out[at + 3] = np.log1p(lengths.std())
        out[at + 4] = np.log1p(lengths.max())
        out[at + 5] = len(set(words)) / count
        out[at + 6] = sum(map(bytes.__eq__, words, words[1:])) / count
        out[at + 7] = sum(map(bytes.isupper, words)) / count
        out[at + 8] = sum(map(bytes.islower, words)) / count
        out[at + 9] = (lengths == 1).mean()
        pairs = set(zip(words, words[1:], strict=False))
        out[at + 10] = len(pairs) / max(1, count - 1)
    out[at + 11] = np.log1p(len(lines))
    out[at + 12] = len(set(lines)) / len(lines)
    out[at + 13] = np.log1p(n / len(lines))
    out[at + 14] = np.log1p(max(map(len, lines)))
    return out


class Network:
    """One hidden layer; posterior() is the probability of label 1."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: list[np.ndarray], constant: float | None = None):
        self.mean, self.scale, self.weights, self.constant = mean, scale, weights, constant

    def posterior(self, rows: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(rows), self.constant)
        a, b, c, d = self.weights
        x = np.clip((rows - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(np.tanh(x @ a + b) @ c + d, -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, hidden: int = HIDDEN, epochs: int = 60, rate: float = 0.03, batch: int = 512, seed: int = 7) -> Network:
    """Adam on the non-negative risk; where the negative part falls below zero, its gradient is followed upwards. Without a
    prior, on the plain risk of telling the two sets apart."""
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = np.clip((positive - mean) / scale, -8, 8), np.clip((unlabelled - mean) / scale, -8, 8)
    start = 0.0 if prior is None else np.log(prior / (1 - prior))
    weights = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), start * np.ones(1)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    average = [np.zeros_like(w) for w in weights]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    softplus = lambda z: np.logaddexp(0, z)
    rounds = max(8, len(u) // batch)
    for epoch in range(epochs):
        p_order, u_order = rng.permutation(len(p)), rng.permutation(len(u))
        for k in range(rounds):
            xp, xu = p[np.take(p_order, range(k * batch, (k + 1) * batch), mode="wrap")], u[np.take(u_order, range(k * batch, (k + 1) * batch), mode="wrap")]
            a, b, c, d = weights
            hp, hu = np.tanh(xp @ a + b), np.tanh(xu @ a + b)
            zp, zu = hp @ c + d, hu @ c + d
            if prior is None:
                gp, gu = -sigmoid(-zp) / len(zp), sigmoid(zu) / len(zu)
            else:
                negative = softplus(zu).mean() - prior * softplus(zp).mean()
                positive_part = -prior * sigmoid(-zp) / len(zp)
                up, uu = -prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
                gp, gu = (positive_part + up, uu) if negative >= 0 else (-up, -uu)
            dhp, dhu = gp[:, None] * c * (1 - hp**2), gu[:, None] * c * (1 - hu**2)
            grads = [xp.T @ dhp + xu.T @ dhu + 1e-4 * a, dhp.sum(0) + dhu.sum(0), hp.T @ gp + hu.T @ gu + 1e-4 * c, np.array([gp.sum() + gu.sum()])]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                weights[i] = weights[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        if epoch >= epochs // 2:
            average = [s + w for s, w in zip(average, weights, strict=True)]
    kept = epochs - epochs // 2
    return Network(mean, scale, [s / kept for s in average])


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """The share of positives among the unlabelled rows, by best bin estimation on halves that were not trained on."""
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    network = train(positive[::2], unlabelled[::2], None, epochs=30)
    p, u = np.sort(network.posterior(positive[1::2])), np.sort(network.posterior(unlabelled[1::2]))
    cuts = np.unique(p)
    of_p, of_u = 1 - np.searchsorted(p, cuts) / len(p), 1 - np.searchsorted(u, cuts) / len(u)
    error = np.sqrt(np.log(4 / doubt) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    best = np.argmin((of_u + error) / of_p)
    return float(np.clip(of_u[best] / of_p[best], 0.02, 0.98))


def fold(folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo the folds; rows with 0 are held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary")) % folds


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t).tolist() for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "kind", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> Network:
    """The network from the training rows of docs, with at most `sample` rows of either kind."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter((F.col("quality") == 1) & (fold(folds) != 0)).select("doc_id").distinct()
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(F.col("doc_id").isNotNull() & (fold(folds) != 0))
    few = lambda rows: sorted(r.doc_id for r in few_by_hash(rows, "doc_id", sample).collect())
    trusted = few(ids.join(known, "doc_id", "left_semi"))
    anything = few(ids)
    if not trusted or not anything:
        return Network(np.zeros(FEATURES), np.ones(FEATURES), [], 0.5)
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(i, 1) for i in trusted] + [(i, 0) for i in anything], "doc_id long, kind int")  # at most 2 * sample rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text")).join(F.broadcast(wanted), "doc_id")
    texts = texts.groupBy("doc_id", "kind").agg(F.max("text").alias("text"))
    rows = texts.mapInArrow(_featured, "doc_id long, kind int, x array<double>").toPandas().sort_values(["kind", "doc_id"])
    split = [np.array(rows.x[rows.kind == k].tolist(), float).reshape(-1, FEATURES) for k in (1, 0)]
    prior = estimated_prior(split[0], split[1])
    return train(split[0], split[1], max(0.02, prior - 3 * np.sqrt(prior * (1 - prior) / (len(split[1]) / 2))))


def score(docs: DataFrame, network: Network, folds: int = FOLDS, threshold: float = THRESHOLD) -> DataFrame:
    """docs with held_out, score and predicted; columns of those names give way."""
    model = docs.sparkSession.sparkContext.broadcast(network)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("held_out", "score", "predicted")]

    @F.pandas_udf("double")
    def posterior(texts):
        import pandas as pd

        return pd.Series(model.value.posterior(np.array([features(t) for t in texts], float).reshape(-1, FEATURES)))

    scored = docs.select(*others, (fold(folds) == 0).alias("held_out"), posterior(text_or_empty().cast("binary")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
