"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ORDER bytes, counted over a bounded sample of its labelled texts and then frozen. A
byte costs -log2 of its share in the longest known context; where that context never saw it, the escape (distinct / (total + distinct))
is paid and the next shorter context asked, down to a uniform byte. The language with the shortest exact code for the whole text wins.

Texts are lower-cased; runs of ASCII bytes that aren't letters are one space, and a text follows a space.

A context longer than two bytes is kept only where it was seen twice. The trees become tables: per order, the cost of every
(context, byte) that some language knows, for all languages at once, escapes included. A text is scored by looking all its bytes up in
the longest order, those missing there in the next, and so on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.hashing import U, mix, runs

FOLDS, HELD_OUT = 4, 2
ORDER = 4
#: Labelled texts per language in the sample, on average; drawn by hash.
MOST_TEXTS = 400
UNKNOWN = "und"

_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)
_EMPTY = U(2**64 - 1)


def plain_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts one after another, each after ORDER spaces, and where each begins (one more at the end)."""
    raw = [(" " * ORDER + t.lower()).encode("utf-8", "replace") for t in texts]
    x = _PLAIN[np.frombuffer(b"".join(raw), np.uint8)]
    off = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))))
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    for i in range(ORDER):  # the spaces that stand before a text
        keep[off[:-1] + i] = True
    return x[keep], np.concatenate(([0], np.cumsum(keep)))[off]


def codes(x: np.ndarray, order: int) -> np.ndarray:
    """At each byte, the `order` bytes before it and itself as one number."""
    out = x.astype(np.uint64)
    for i in range(1, order + 1):
        out[i:] |= x[:-i].astype(np.uint64) << U(8 * i)
    return out


def _counted(batch_texts: list[str], lang: list[str]) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    for name in sorted(set(lang)):
        x, off = plain_bytes([t for t, own in zip(batch_texts, lang, strict=True) if own == name])
        inside = np.ones(len(x), bool)
        for i in range(ORDER):
            inside[off[:-1] + i] = False
        for order in range(ORDER + 1):
            yield (name, order, *np.unique(codes(x, order)[inside], return_counts=True))


class Table:
    """A hash table from codes to rows of costs."""

    def __init__(self, keys: np.ndarray, costs: np.ndarray):
        self.mask = (1 << max(4, int(len(keys) * 4).bit_length())) - 1
        self.keys, self.row = np.full(self.mask + 1, _EMPTY), np.zeros(self.mask + 1, np.int32)
        self.costs, self.probes = costs.astype(np.float32), 0
        left = np.arange(len(keys))
        at = self.place(keys)
        while len(left):
            free = self.keys[at[left]] == _EMPTY
            _, first = np.unique(at[left][free], return_index=True)
            put = left[free][first]
            self.keys[at[put]], self.row[at[put]] = keys[put], put
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask
            self.probes += 1

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) & U(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it isn't known."""
        at = self.place(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.row[at], -1)
        left = np.flatnonzero((held != keys) & (held != _EMPTY))
        for _ in range(self.probes):
            if not len(left):
                break
            at[left] = (at[left] + 1) & self.mask
            held = self.keys[at[left]]
            hit = held == keys[left]
            out[left[hit]] = self.row[at[left[hit]]]
            left = left[~hit & (held != _EMPTY)]
        return out


class Trees:
    """Frozen context trees of all languages, as tables. `counts` has (lang, order, codes, counts) in any order."""

    def __init__(self, counts: list[tuple[str, int, np.ndarray, np.ndarray]]):
        self.langs = sorted({c[0] for c in counts})
        n = len(self.langs)
        self.costs, self.escapes = [], []
        shorter: Table | None = None
        for order in range(ORDER + 1):
            trees = []
            for lang in self.langs:
                own = [c for c in counts if c[0] == lang and c[1] == order]
                key, which = np.unique(np.concatenate([c[2] for c in own]), return_inverse=True)
                count = np.bincount(which, np.concatenate([c[3] for c in own]), len(key))
                context, of = np.unique(key >> U(8), return_inverse=True)
                total, distinct = np.bincount(of, count), np.bincount(of)
                kept = (total >= 2) | (order <= 2)
                cost = -np.log2(count / (total + distinct)[of])
                escape = -np.log2(distinct / (total + distinct))
                trees.append((key[kept[of]], cost[kept[of]], context[kept], escape[kept]))
            contexts = np.unique(np.concatenate([t[2] for t in trees]))
            escapes = np.zeros((len(contexts), n))
            for i, t in enumerate(trees):
                escapes[np.searchsorted(contexts, t[2]), i] = t[3]
            self.escapes.append(Table(contexts, escapes))
            keys = np.unique(np.concatenate([t[0] for t in trees]))
            if shorter is None:
                costs = np.full((len(keys), n), 8.0)
            else:
                costs = self._down(order - 1, keys & U((1 << 8 * order) - 1))
            costs = costs + escapes[np.searchsorted(contexts, keys >> U(8))]
            for i, t in enumerate(trees):
                costs[np.searchsorted(keys, t[0]), i] = t[1]
            shorter = Table(keys, costs)
            self.costs.append(shorter)

    def _down(self, order: int, keys: np.ndarray) -> np.ndarray:
        """Costs of (context of `order` bytes, byte) per language."""
        if order < 0:
            return np.full((len(keys), len(self.langs)), 8.0, np.float32)
        row = self.costs[order].find(keys)
        out = self.costs[order].costs[row]
        if len(miss := np.flatnonzero(row < 0)):
            at = self.escapes[order].find(keys[miss] >> U(8))
            escape = np.where(at[:, None] >= 0, self.escapes[order].costs[at], 0)
            out[miss] = escape + self._down(order - 1, keys[miss] & U((1 << 8 * order) - 1))
        return out

    def bits(self, texts: list[str]) -> np.ndarray:
        """Code length of each text in each language."""
        x, off = plain_bytes(texts)
        cost = self._down(ORDER, codes(x, ORDER)).astype(np.float64)
        for i in range(ORDER):
            cost[off[:-1] + i] = 0
        return np.add.reduceat(cost, off[:-1], axis=0)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame) -> Trees | None:
    """Trees of all langs in `docs` (doc_id, text, lang) outside the held-out fold; None if there are none."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang").filter(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.trim("text") != "") & ~held_out(F.col("doc_id")))
    # One row per language.
    sizes = known.groupBy("lang").count().withColumn("share", F.least(F.lit(1.0), MOST_TEXTS / F.col("count"))).drop("count")
    drawn = known.join(F.broadcast(sizes), "lang").filter(
        F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) <= F.col("share") * 1_000_000).select("lang", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, order, key, count in _counted(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                yield pa.record_batch([pa.array([name] * len(key), pa.string()), pa.array([order] * len(key), pa.int32()),
                                       pa.array(key.view(np.int64)), pa.array(count, pa.int64())], names=["lang", "order", "code", "n"])

    counts = drawn.mapInArrow(task, "lang string, order int, code long, n long").groupBy("lang", "order", "code").agg(F.sum("n").alias("n"))
    # No more rows than the sample has bytes and orders.
    found = counts.toArrow()
    if not found.num_rows:
        return None
    lang, order = np.array(found.column("lang").to_pylist(), object), found.column("order").to_numpy()
    code, n = found.column("code").to_numpy().view(np.uint64), found.column("n").to_numpy()
    return Trees([(x, k, code[at], n[at]) for x in sorted(set(lang)) for k in range(ORDER + 1) if len(at := np.flatnonzero((lang == x) & (order == k)))])


def identify(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, lang_pred, score (the winner's share of probability, 0 to 1) and bits_per_byte.

    Only doc_id, text and lang are read, lang for learning alone, from rows outside the held-out fold. lang_pred is `und`, with score
    0, where text is null or has no letter, or where no language could be learned. Ties go to the first language by name. Rows that
    share a doc_id are scored one by one.
    """
    trees = docs.sparkSession.sparkContext.broadcast(train(docs))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trees.value
        for batch in batches:
            for first, off, data in runs(batch):
                raw = data.tobytes()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                n = len(texts)
                if own is None:
                    lang, score, rate = [UNKNOWN] * n, np.zeros(n), np.zeros(n)
                else:
                    bits = own.bits(texts)
                    best = bits.argmin(axis=1)
                    least = bits.min(axis=1)
                    score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                    rate = least / np.maximum(np.diff(off), 1)
                    letters = np.fromiter(map(_has_letter, texts), bool, n)
                    lang = [own.langs[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), letters, strict=True)]
                    score, rate = np.where(letters, score, 0.0), np.where(letters, rate, 0.0)
                yield pa.record_batch([batch.column("doc_id").slice(first, n), pa.array(lang, pa.string()), pa.array(score), pa.array(rate)],
                                      names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(task, "doc_id long, lang_pred string, score double, bits_per_byte double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")
