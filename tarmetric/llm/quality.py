"""Quality classifier: random-indexing word vectors, pooled per document, and a small calibrated network.

Two passes over the texts. The first adds up, for every word of every document, the sparse ternary index
vectors of its neighbours; integer sums, so the result does not depend on the order of the tasks. Words are
filed in a fixed number of hash buckets, which bounds the table that is sent to the tasks (buckets x dims).
The second pools the vectors of a document's words (mean, spread, length) and applies a two-layer network
whose logit is divided by a temperature fitted on rows the network did not learn from.

The network is fitted on at most ``train_rows`` labelled rows, those with the smallest hash of their id.

Cases: a null text is empty; an empty text has zero pooled vectors and gets a score like any other; rows
sharing an id are scored apart, and a label that is given twice counts by its smallest value; without usable
labels of both kinds every score is the share of good labels (0.5 without labels); other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tarmetric.llm.common import table

BUCKETS, DIMS, NONZERO, WINDOW, SEED = 8192, 32, 4, 2, 7
POOLED = 2 * DIMS + 4
SLICE = 100_000
WORDS_KEPT = 300_000
TRAIN_ROWS = 8192
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


class WordIds(dict):
    """Word to bucket, remembered up to a limit."""

    def __missing__(self, word: str) -> int:
        bucket = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        if len(self) < WORDS_KEPT:
            self[word] = bucket
        return bucket


_IDS = WordIds()


def word_ids(text: str | None) -> np.ndarray:
    words = _WORD.findall(text) if text else []
    return np.fromiter(map(_IDS.__getitem__, words), dtype=np.int32, count=len(words))


def index_vectors() -> np.ndarray:
    """One sparse ternary vector per bucket, and a zero row for places outside a document."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS + 1, DIMS), dtype=np.int16)
    for row in out[:-1]:
        row[rng.choice(DIMS, NONZERO, replace=False)] = rng.choice((-1, 1), NONZERO)
    return out


def add_contexts(total: np.ndarray, base: np.ndarray, ids: np.ndarray) -> None:
    """Add to each word's row the index vectors of its neighbours. ``ids`` holds documents apart by ``BUCKETS``."""
    for start in range(0, len(ids), SLICE):
        left, right = max(0, start - WINDOW), min(len(ids), start + SLICE + WINDOW)
        own = ids[left:right]
        near = base[own]
        context = np.zeros_like(near)
        for k in range(1, WINDOW + 1):
            context[k:] += near[:-k]
            context[:-k] += near[k:]
        keep = slice(start - left, start - left + min(SLICE, len(ids) - start))
        own, context = own[keep], context[keep]
        order = np.argsort(own.astype(np.uint16), kind="stable")
        ranked = own[order]
        first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        total[ranked[first]] += np.add.reduceat(context[order], first, axis=0, dtype=np.int64)


def _context_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    base, total = index_vectors(), np.zeros((BUCKETS + 1, DIMS), dtype=np.int64)
    gap = np.full(WINDOW, BUCKETS, dtype=np.int32)
    for batch in batches:
        waiting, size = [], 0
        for text in batch["text"]:
            ids = word_ids(text)
            waiting += [ids, gap]
            size += len(ids) + WINDOW
            if size >= SLICE:
                add_contexts(total, base, np.concatenate(waiting))
                waiting, size = [], 0
        if waiting:
            add_contexts(total, base, np.concatenate(waiting))
    used = np.flatnonzero(total[:-1].any(axis=1))
    yield pd.DataFrame({"bucket": used, **{f"v{k}": total[used, k] for k in range(DIMS)}})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit word vectors of all documents: at most ``BUCKETS`` rows come to the driver."""
    schema = "bucket long, " + ", ".join(f"v{k} long" for k in range(DIMS))
    sums = docs.select("text").mapInPandas(_context_sums, schema).groupBy("bucket").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(DIMS)])
    got = sums.toPandas()
    out = np.zeros((BUCKETS, DIMS))
    out[got["bucket"].to_numpy(dtype=np.int64)] = got[[f"v{k}" for k in range(DIMS)]].to_numpy(dtype=np.float64)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors, length of the mean, logarithm of the number of words, and how alike
    neighbouring words are: the mean product of their vectors and the share of equal neighbours."""
    ids = word_ids(text)
    if not len(ids):
        return np.zeros(POOLED)
    total, square, alike = np.zeros(DIMS), np.zeros(DIMS), 0.0
    for start in range(0, len(ids), SLICE):
        part = vectors[ids[start : start + SLICE + 1]]
        alike += float(np.einsum("ij,ij->", part[1:], part[:-1], dtype=np.float64))
        part = part[:SLICE]
        total += part.sum(axis=0, dtype=np.float64)
        square += np.einsum("ij,ij->j", part, part, dtype=np.float64)
    mean = total / len(ids)
    spread = np.sqrt(np.maximum(square / len(ids) - mean**2, 0))
    return np.concatenate([mean, spread, [np.linalg.norm(mean), np.log1p(len(ids)) / 10, alike / len(ids), np.mean(ids[1:] == ids[:-1]) if len(ids) > 1 else 0.0]])


@dataclass
class Network:
    """Two layers over standardised pooled vectors; the logit is divided by ``temperature``."""

    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.first + self.first_bias) @ self.second + self.second_bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, batch: int = 128, rate: float = 0.01, decay: float = 1e-4) -> Network:
    rng = np.random.default_rng(SEED)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = (x - mean) / scale
    w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for epoch in range(epochs):
        order = rng.permutation(len(z))
        for start in range(0, len(z), batch):
            rows = order[start : start + batch]
            a = np.tanh(z[rows] @ w[0] + w[1])
            error = (1 / (1 + np.exp(-np.clip(a @ w[2] + w[3], -60, 60))) - y[rows]) / len(rows)
            back = error[:, None] * w[2] * (1 - a**2)
            grads = [z[rows].T @ back + decay * w[0], back.sum(axis=0), a.T @ error + decay * w[2], np.array([error.sum()])]
            step += 1
            pace = rate * (1 - epoch / epochs)
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, w[0], w[1], w[2], float(w[3][0]))


def calibrated(net: Network, x: np.ndarray, y: np.ndarray) -> Network:
    """Choose the temperature of least log loss on ``x``; without rows it stays 1."""
    if len(y):
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        logit = np.clip(net.logits(x)[:, None] / grid, -60, 60)
        loss = np.where(y[:, None] > 0.5, np.log1p(np.exp(-logit)), np.log1p(np.exp(logit))).mean(axis=0)
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def fold():
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.col("doc_id").cast("string")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``train_rows`` labelled rows outside the held-out fold: doc_id, text, label, calibration."""
    clean = labels.select("doc_id", F.col("quality").cast("int").alias("_label")).where("doc_id is not null and _label in (0, 1)")
    chosen = clean.groupBy("doc_id").agg(F.min("_label").alias("_label")).where(fold() != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # bounded by train_rows
    return (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.first("_label").alias("_label"))
        .withColumn("_calibrate", fold() == 1)
    )


class Scorer:
    """Scores of texts by fitted word vectors and network; small enough to send to every task."""

    def __init__(self, vectors: np.ndarray, net: Network | None, prior: float):
        self.vectors, self.net, self.prior = vectors, net, prior

    def scores(self, texts: pd.Series) -> pd.Series:
        if self.net is None:
            return pd.Series(np.full(len(texts), self.prior))
        x = np.stack([pooled(t, self.vectors) for t in texts]) if len(texts) else np.zeros((0, POOLED))
        return pd.Series(self.net.scores(x))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Scorer:
    vectors = word_vectors(docs)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["_label"], "calibrate": b["_calibrate"], "x": [pooled(t, sent.value).tolist() for t in b["text"]]})

    got = training_rows(docs, labels, train_rows).mapInPandas(features, "doc_id long, label int, calibrate boolean, x array<double>").toPandas().sort_values("doc_id")
    y, held = got["label"].to_numpy(dtype=np.float64), got["calibrate"].to_numpy(dtype=bool)
    if len(set(y[~held])) < 2:
        return Scorer(vectors, None, float(y.mean()) if len(y) else 0.5)
    x = np.stack([np.asarray(r) for r in got["x"]])
    return Scorer(vectors, calibrated(fit_network(x[~held], y[~held]), x[held], y[held]), float(y.mean()))


def score_column(spark: SparkSession, scorer: Scorer):
    sent = spark.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return sent.value.scores(texts)

    return score(F.col("text"))


def score_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    score = score_column(docs.sparkSession, fit(docs, labels, train_rows))
    scored = docs.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows scored at ``threshold`` or more, with all their columns."""
    score = score_column(docs.sparkSession, fit(docs, labels))
    return docs.where(score >= threshold)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
