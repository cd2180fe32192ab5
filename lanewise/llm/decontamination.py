"""Benchmark decontamination: BM25 over test items with block-max pruning, then a check of question and answer.

The test items are the index, the training passages are the queries. Items are cut into units of UNIT words at most, an inverted
index has the BM25 weight of every word in every unit as a share of the unit's own best score, and units lie in blocks of BLOCK with
the largest weight of each word per block. A passage is PASSAGE words, one begins every PASSAGE / 2, so any UNIT words of a text lie
in one passage. Of a passage's distinct words those of least weight are set aside while even all of them together could not reach
the threshold (the pivot); blocks are met by the other words only, a block is scored when its bound reaches the threshold, and every
unit at the threshold or above is retrieved, not a top few. A retrieved item is a leak when the text around the passage holds enough
of its question's and of its answer's word runs, or of the whole item's.

Test sets are small by nature, but their size is not taken on trust: items are indexed SHARD at a time, and every shard is one pass
over the training data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import trimmed
from lanewise.llm.hashing import NOT_ALNUM, grams, hash_words, runs, words

UNIT, PASSAGE, BLOCK = 64, 128, 8
THRESHOLD = 0.5
K1, B = 1.2, 0.75
#: Items in one index, and so in one broadcast.
SHARD = 10_000
RUN = 3
PART_OVERLAP, WHOLE_OVERLAP = 0.6, 0.8


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence of several is the answer; of a single sentence it is the last quarter of the words."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text) if re.search(r"\w", p)]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    own = text.split()
    cut = max(1, len(own) - max(1, len(own) // 4))
    return " ".join(own[:cut]), " ".join(own[cut:])


def _runs_of(text: str) -> np.ndarray:
    h = hash_words(text.encode(), NOT_ALNUM)
    return np.unique(grams(h, np.array([0, len(h)]), RUN, short=True)[0])


class Index:
    """Block-max inverted index of items (id, text). Items without words are left out: they can't leak."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.parts, unit_of, units = [], [], [], []
        for item, text in items:
            h = hash_words((text or "").encode(), NOT_ALNUM)
            if len(h):
                self.parts.append((*map(_runs_of, question_and_answer(text)), _runs_of(text), len(h)))
                for at in range(0, len(h), UNIT):
                    units.append(h[max(0, min(at, len(h) - UNIT)):at + UNIT])
                    unit_of.append(len(self.ids))
                self.ids.append(item)
        self.unit_of = np.array(unit_of, np.int64)
        n = len(units)
        self.blocks = -(-n // BLOCK)
        if not n:
            self.vocabulary = np.zeros(0, np.uint64)
            return
        size = np.array(list(map(len, units)))
        word, unit, tf = np.concatenate(units), np.repeat(np.arange(n), size), None
        self.vocabulary, term = np.unique(word, return_inverse=True)
        pair, tf = np.unique(term.astype(np.int64) * n + unit, return_counts=True)
        term, unit = pair // n, pair % n
        df = np.bincount(term, minlength=len(self.vocabulary))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[unit] / size.mean()))
        self.weight = weight / np.bincount(unit, weight, n)[unit]
        self.unit, self.begin = unit, np.searchsorted(term, np.arange(len(self.vocabulary) + 1))
        block, where = np.unique(term * self.blocks + unit // BLOCK, return_inverse=True)
        top = np.zeros(len(block))
        np.maximum.at(top, where, self.weight)
        self.block, self.block_top = block % self.blocks, top
        self.block_begin = np.searchsorted(block // self.blocks, np.arange(len(self.vocabulary) + 1))
        self.top = np.zeros(len(self.vocabulary))
        np.maximum.at(self.top, term, self.weight)

    def terms(self, h: np.ndarray) -> np.ndarray:
        """Number of each word in the index's vocabulary, -1 for others."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at, -1)

    @staticmethod
    def _expand(begin: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = begin[term + 1] - begin[term]
        to = np.concatenate(([0], np.cumsum(n)))
        return np.repeat(np.arange(len(term)), n), np.repeat(begin[term] - to[:-1], n) + np.arange(to[-1])

    def retrieve(self, passage: np.ndarray, term: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, unit, score) of all at the threshold or above; distinct (passage, term) pairs of `count` passages are given."""
        order = np.lexsort((self.top[term], passage))
        passage, term = passage[order], term[order]
        first = np.searchsorted(passage, np.arange(count + 1))
        total = np.concatenate(([0.0], np.cumsum(self.top[term])))
        reach = total[1:] - total[first[passage]]
        aside = reach < THRESHOLD - 1e-9
        spare = np.zeros(count)
        np.maximum.at(spare, passage[aside], reach[aside])
        essential = np.flatnonzero(~aside)
        pair, at = self._expand(self.block_begin, term[essential])
        bound = np.bincount(passage[essential][pair] * self.blocks + self.block[at], self.block_top[at], count * self.blocks)
        bound = bound.reshape(count, self.blocks)
        alive = (bound > 0) & (bound + spare[:, None] >= THRESHOLD - 1e-9)
        if not alive.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        keep = alive.any(axis=1)[passage]
        passage, term = passage[keep], term[keep]
        pair, at = self._expand(self.begin, term)
        own, unit, weight = passage[pair], self.unit[at], self.weight[at]
        scored = alive[own, unit // BLOCK]
        n = len(self.unit_of)
        key, which = np.unique(own[scored] * n + unit[scored], return_inverse=True)
        score = np.bincount(which, weight[scored], len(key))
        good = score >= THRESHOLD - 1e-9
        return key[good] // n, key[good] % n, score[good]

    def leaks(self, off: np.ndarray, data: np.ndarray) -> list[tuple[int, int, float, float, float, int]]:
        """(row, item, score, question and answer overlap, first word of the passage) of a run of rows, best passage per item."""
        if not len(self.vocabulary):
            return []
        h, rows, _, _ = words(off, data, NOT_ALNUM)
        term = self.terms(h)
        half = PASSAGE // 2
        # A row of n words has a passage at every half-passage but the last, and one at least.
        halves = -(-np.diff(rows) // half)
        begin = np.concatenate(([0], np.cumsum(halves)))
        known = np.flatnonzero(term >= 0)
        row = np.searchsorted(rows, known, "right") - 1
        stretch = begin[row] + (known - rows[row]) // half
        v = len(self.vocabulary)
        last = np.zeros(begin[-1], bool)
        last[begin[1:][halves > 0] - 1] = True
        single = np.zeros(begin[-1], bool)
        single[begin[:-1][halves == 1]] = True
        # Passage i is stretch i and the next one of the same row.
        back = np.zeros(begin[-1], bool)
        back[1:] = True
        back[begin[:-1][halves > 0]] = False
        pairs = np.concatenate(((stretch * v + term[known])[~last[stretch] | single[stretch]], ((stretch - 1) * v + term[known])[back[stretch]]))
        if not len(pairs):
            return []
        pairs = np.unique(pairs)
        passage, unit, score = self.retrieve(pairs // v, pairs % v, int(begin[-1]))
        best: dict[tuple[int, int], tuple[float, float, float, int]] = {}
        for p, u, s in zip(passage.tolist(), unit.tolist(), score.tolist(), strict=True):
            r = int(np.searchsorted(begin, p, "right")) - 1
            item = int(self.unit_of[u])
            question, answer, whole, n = self.parts[item]
            at = (p - int(begin[r])) * half
            low, high = max(rows[r], rows[r] + at - n), min(rows[r + 1], rows[r] + at + PASSAGE + n)
            near = np.concatenate([grams(h[low:high], np.array([0, high - low]), k, short=True)[0] for k in range(1, RUN + 1)])
            q, a, w = (float(np.isin(x, near).mean()) for x in (question, answer, whole))
            if (q >= PART_OVERLAP and a >= PART_OVERLAP) or w >= WHOLE_OVERLAP:
                best[r, item] = max(best.get((r, item), (-1.0, 0.0, 0.0, 0)), (s, q, a, -at))
        return [(r, self.ids[i], s, q, a, -at) for (r, i), (s, q, a, at) in sorted(best.items())]


def indexes(items: DataFrame, shard: int = SHARD, unnamed: bool = False) -> Iterator[Index]:
    """Indexes of `items` (item_id, text), of `shard` items each at most: only these ever reach the driver at once.

    Items without an id are left out unless `unnamed`; they come first then.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    items = items if unnamed else items.filter("item_id IS NOT NULL")
    after = None
    while True:
        page = items if after is None else items.filter(F.struct("item_id", "text") > F.struct(F.lit(after[0]).cast("long"), F.lit(after[1])))
        found = [tuple(r) for r in page.distinct().orderBy("item_id", "text").limit(shard).collect()]
        if found:
            yield Index(found)
        if len(found) < shard:
            return
        after = found[-1]


def find_leaks(docs: DataFrame, items: DataFrame, shard: int = SHARD) -> DataFrame:
    """A row per document and item it holds: doc_id, item_id, score, question_overlap, answer_overlap, first_word.

    Only doc_id and text, item_id and text are read. Null and empty texts, and items without an id or words, give nothing. Rows of
    one doc_id give a row for each; repeated item rows count once. The best-scoring passage stands for the document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
    names = ("item_id", "score", "question_overlap", "answer_overlap", "first_word")
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(items, shard):
        # An index of `shard` items at most.
        held = docs.sparkSession.sparkContext.broadcast(index)

        def task(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, off, data in runs(batch):
                    found = held.value.leaks(off, data)
                    ids = batch.column("doc_id").take(pa.array([first + x[0] for x in found], pa.int64()))
                    rest = [pa.array([x[i] for x in found], pa.int64() if i in (1, 5) else pa.float64()) for i in range(1, 6)]
                    yield pa.record_batch([ids, *rest], names=["doc_id", *names])

        out = out.union(docs.mapInArrow(task, schema))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, shard: int = SHARD) -> DataFrame:
    """`docs` without the rows whose text leaks an item, with an id or without; all columns and all other rows stay as they are."""
    for index in indexes(items, shard, unnamed=True):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def task(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, off, data in runs(batch):
                    keep[[first + x[0] for x in held.value.leaks(off, data)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(trimmed(task), docs.schema)
    return docs
