"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good in the training folds, unlabelled web text is any document of those folds, and the class
prior is the share of good ones among the labelled training rows (nothing else is taken from bad labels). A small network on figures of
the text minimises the non-negative unbiased risk  p E_pos[l(f)] + max(0, E_unl[l(-f)] - p E_pos[l(-f)]),  with logistic loss l; a
step at which the second term is negative climbs it instead, so the network can't drive the risk below zero by learning positives by
heart. Fitting uses bounded samples drawn by hash, MOST_POSITIVE and MOST_UNLABELLED documents on average; scoring reads every text.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import trimmed
from lanewise.llm.hashing import WHITE, runs, separators, words

FOLDS, HELD_OUT = 3, 1
MOST_POSITIVE, MOST_UNLABELLED = 4000, 8000
HIDDEN, STEPS, RATE, DECAY = 16, 1500, 0.02, 1e-4
#: Prior where no labelled training row is bad, or none is there.
PLAIN_PRIOR = 0.5

_UPPER = separators((65, 90))
_LETTER = separators((65, 90), (97, 122))
_DIGIT = separators((48, 57))
_STOP = separators((44, 44), (46, 46))
_MARK = separators((33, 43), (47, 47), (58, 64), (91, 96), (123, 126))
_LINE = separators((10, 10))
_HIGH = separators((128, 255))
N_FEATURES = 13


def features(off: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A row of figures per text of a run: shares of kinds of bytes, word lengths, repetition, size. Empty texts are zeros."""
    def share(table: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(table[data])))[off]).astype(np.float64)

    def total(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(x)))[at]).astype(np.float64)

    h, rows, start, end = words(off, data, WHITE)
    size = np.maximum(np.diff(off), 1)
    n = np.diff(rows)
    some = np.maximum(n, 1)
    letters = np.maximum(share(_LETTER), 1)
    row = np.repeat(np.arange(len(n)), n)
    length = end - start
    mean = total(length, rows) / some
    # Distinct words of a row: the first of each equal run, counted at its row.
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    last = data[np.maximum(end - 1, 0)] if len(end) else np.zeros(0, np.uint8)
    distinct = np.bincount(row[order][new], minlength=len(n)).astype(np.float64)
    return np.column_stack((
        share(_UPPER) / letters, share(_MARK) / size, share(_DIGIT) / size, share(_STOP) / some, share(_HIGH) / size, share(_LINE) / some,
        np.log1p(n), mean, np.sqrt(np.maximum(total(length.astype(np.float64)**2, rows) / some - mean**2, 0)), distinct / some,
        np.log1p(distinct) / np.log1p(some), total(again, rows) / some, total(_MARK[last], rows) / some))


@dataclasses.dataclass
class Network:
    """Scores are probabilities of being good."""

    centre: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        return z, np.tanh(z @ self.weights[0] + self.weights[1])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x)[1] @ self.weights[2] + self.weights[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -500, 500)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 4) -> Network:
    """Minimise the non-negative risk by Adam on all rows at once. Without positives or unlabelled rows every score is the prior."""
    rng = np.random.default_rng(seed)
    both = np.concatenate((positive, unlabelled)) if len(positive) and len(unlabelled) else np.zeros((1, N_FEATURES))
    net = Network(both.mean(0), np.maximum(both.std(0), 1e-3), [
        rng.normal(0, 0.4, (N_FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.4, HIDDEN), np.zeros(1)])
    if not len(positive) or not len(unlabelled):
        p = min(max(prior, 1e-6), 1 - 1e-6)
        net.weights[2][:], net.weights[3][:] = 0, np.log(p / (1 - p))
        return net
    first, second = ([np.zeros_like(w) for w in net.weights] for _ in range(2))
    for step in range(1, STEPS + 1):
        grads = [DECAY * w for w in net.weights]
        zp, hp = net.hidden(positive)
        zu, hu = net.hidden(unlabelled)
        sp, su = (1 / (1 + np.exp(-(h @ net.weights[2] + net.weights[3]))) for h in (hp, hu))
        rest = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        sign = 1.0 if rest >= 0 else -1.0
        # d/df of each loss, by row: l(f) has s - 1, l(-f) has s.
        dp = (prior * (sp - 1) * (sign > 0) - sign * prior * sp) / len(positive)
        du = sign * su / len(unlabelled)
        for z, h, d in ((zp, hp, dp), (zu, hu, du)):
            back = d[:, None] * net.weights[2] * (1 - h**2)
            for i, g in enumerate((z.T @ back, back.sum(0), h.T @ d, d.sum(keepdims=True))):
                grads[i] = grads[i] + g
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g**2
            net.weights[i] = net.weights[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _drawn(share: float, salt: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) < int(share * 1_000_000) + 1


def train(docs: DataFrame, labels: DataFrame) -> Network:
    """Fit on `docs` (doc_id, text) and `labels` (doc_id, quality); a document counts as good if all its labels say so."""
    learn = ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter(learn & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("quality"))
    n, good = known.agg(F.count("*"), F.sum((F.col("quality") == 1).cast("long"))).collect()[0]
    prior = good / n if n and 0 < good < n else PLAIN_PRIOR
    # At most about MOST_POSITIVE ids, drawn by hash.
    positive = known.filter("quality = 1").filter(_drawn(min(1.0, MOST_POSITIVE / max(good or 0, 1)), 1)).select("doc_id", F.lit(True).alias("positive"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(learn)
    web = texts.select("doc_id").count()
    rows = texts.join(F.broadcast(positive), "doc_id", "left").withColumn("positive", F.coalesce("positive", F.lit(False))).withColumn(
        "unlabelled", _drawn(min(1.0, MOST_UNLABELLED / max(web, 1)), 2)).filter("positive OR unlabelled").select("positive", "unlabelled", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, off, data in runs(batch):
                x = features(off, data)
                yield pa.record_batch([*(batch.column(c).slice(first, len(x)) for c in ("positive", "unlabelled")), pa.array(list(x), pa.list_(pa.float64()))],
                                      names=["positive", "unlabelled", "x"])

    found = rows.mapInArrow(task, "positive boolean, unlabelled boolean, x array<double>").collect()
    # Sorted, so that the order of arrival doesn't show in the weights.
    pick = lambda kind: np.array(sorted(tuple(r["x"]) for r in found if r[kind])).reshape(-1, N_FEATURES)
    return fit(pick("positive"), pick("unlabelled"), prior)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score (0 to 1) and predicted (1 if the score is 0.5 or more).

    Only doc_id and text, doc_id and quality are read; documents of the held-out fold and null doc_ids are never learned from. Null
    and empty texts get the score of an empty text. Rows that share a doc_id are scored one by one.
    """
    net = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, off, data in runs(batch):
                s = net.value.score(features(off, data))
                yield pa.record_batch([batch.column("doc_id").slice(first, len(s)), pa.array(s)], names=["doc_id", "score"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(task, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that score 0.5 or more, with all their columns."""
    net = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [net.value.score(features(off, data)) >= 0.5 for _, off, data in runs(batch)]
            yield batch.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    return docs.mapInArrow(trimmed(task), docs.schema)
