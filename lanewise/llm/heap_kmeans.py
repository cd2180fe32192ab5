"""Exact k-means over heaps of bound gaps.

A vector's gap is the distance to its second nearest centroid less that to its nearest. When centroids move, the gap of a vector of cluster c
shrinks by at most what c moved plus what the farthest moved other centroid did. Instead of lowering every gap, a cluster accumulates
that drift: a vector enters with key = gap + drift so far, and expires in the round in which its cluster's drift reaches its key. Only
expired vectors are popped and compared exactly with all centroids; the others can't have changed their cluster.

The heaps are sorted runs in files. A round appends the vectors it rescanned as a table sorted by cluster and key within each part, and never
rewrites one: an entry is in its heap exactly as long as its key exceeds its cluster's drift, so popping is a filter on cluster and
key between two drifts, which Parquet statistics turn into short range reads. Vectors are never shuffled. Centroid sums are
adjusted by the vectors that changed cluster; all that crosses the network is sums of one row per task, cluster and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import materialize

SIZE, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256.0, 40, 5, 2
#: Largest scaled component: squared distances fit into a long up to it, and are exact in doubles up to EXACT.
LARGEST, EXACT = 1 << 27, 1 << 22
#: Share of the distances by which keys are lowered, far above the rounding errors of roots and drifts. It costs rescans, never an answer.
_SLACK = 1e-9
_ROWS = 4096
_ENTRY = "vec_id long, x array<int>, old int, cluster int, key double"


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, SIZE)


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors with SIZE components, none null or not finite; x is floor(SCALE * component)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.filter(pc.equal(pc.list_value_length(batch.column("v")), SIZE))
            if held.num_rows:
                v = _matrix(held.column("v"), held.num_rows).astype(np.float64)  # null components become NaN
                fit = np.isfinite(v).all(1)
                x = np.floor(SCALE * v[fit])
                if len(x) and np.abs(x).max() >= LARGEST:
                    raise ValueError(f"a component of {LARGEST / SCALE:g} or more: squared distances would exceed a long")
                yield _batch("vec_id x", held.column("vec_id").filter(pa.array(fit)), _lists(x.astype(np.int32)))

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).mapInArrow(
        task, "vec_id long, x array<int>")


def starts(vectors: DataFrame, clusters: int) -> np.ndarray:
    """The vectors of smallest sha256 of `SEED:vec_id`, in that order; equal hashes go by components, a null vec_id comes last."""
    mark = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(mark.alias("mark"), "x").orderBy(F.col("mark").asc_nulls_last(), "x").limit(clusters).collect()
    return np.array([r["x"] for r in rows], np.int64).reshape(-1, SIZE)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of `x` to every centroid."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (a @ c.T)).astype(np.int64)
    return np.stack([((x.astype(np.int64) - c) ** 2).sum(1) for c in centroids], 1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (of equally near ones the first) and the gap to the second, lowered by the slack."""
    d = squared(x, centroids)
    best = d.argmin(1)
    if len(centroids) == 1:
        return best, np.full(len(x), np.inf)
    low, high = np.sqrt(np.partition(d, 1, axis=1)[:, :2].T.astype(np.float64))
    return best, high - low - _SLACK * (1 + low + high)


def _assign(rows: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """Rescan (vec_id, x, old): the entries with their cluster and key."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                best, gap = nearest(_matrix(part.column("x"), part.num_rows), centroids)
                yield _batch("vec_id x old cluster key", part.column("vec_id"), part.column("x"), part.column("old"), best.astype(np.int32), gap + drift[best])

    return rows.mapInArrow(task, _ENTRY)


def _moves(entries: DataFrame, clusters: int) -> np.ndarray:
    """Exact change of each cluster's component sums and, last, of its count by the entries that came to it or left it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((clusters, SIZE + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = np.append(_matrix(batch.column("x"), batch.num_rows).astype(np.int64), np.ones((batch.num_rows, 1), np.int64), axis=1)
                old, new = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("old", "cluster"))
                np.add.at(total, new, x)
                left = old >= 0
                np.subtract.at(total, old[left], x[left])
        own = np.flatnonzero(total.any(1))
        yield _batch("cluster s", own.astype(np.int32), _lists(total[own]))

    sums = entries.filter("old <> cluster").select("x", "old", "cluster").mapInArrow(task, "cluster int, s array<long>")
    rows = sums.select("cluster", F.posexplode("s").alias("i", "v")).groupBy("cluster", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out = np.zeros((clusters, SIZE + 1), object)
    for r in rows.collect():  # a row per cluster and component
        out[r["cluster"], r["i"]] = int(r["v"])
    return out


def _between(low: np.ndarray | None, high: np.ndarray | None) -> Column:
    """Entries with low < key <= high by their cluster; a missing end is open."""
    ends = [(">", low)] * (low is not None) + [("<=", high)] * (high is not None)
    some = [c for c in range(len(ends[0][1])) if len(ends) < 2 or low[c] < high[c]]
    # One expression for all clusters, which Parquet can prune by.
    return F.expr(" OR ".join(f"(cluster = {c} AND " + " AND ".join(f"key {sign} {float(at[c])!r}D" for sign, at in ends) + ")" for c in some) or "false")


class Clustering:
    """The centroids, and the heaps as runs: each assignment's entries as a stored table."""

    def __init__(self, vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS):
        found = scaled(vectors)
        self.centroids = starts(found, clusters)
        self.runs: list[DataFrame] = []
        self.drifts = [np.zeros(len(self.centroids))]
        if not len(self.centroids):
            return
        sums = np.zeros((len(self.centroids), SIZE + 1), object)
        due = found.withColumn("old", F.lit(-1))
        for number in range(rounds + 1):
            entries = _assign(due, self.centroids, self.drifts[-1]).sortWithinPartitions("cluster", "key")
            self.runs.append(materialize(entries, f"heap-{number}"))
            if number == rounds:
                return
            sums = sums + _moves(self.runs[-1], len(self.centroids))
            self._move(sums)
            due = self.expired().select("vec_id", "x", F.col("cluster").alias("old"))

    def _move(self, sums: np.ndarray) -> None:
        """Centroids of the sums, and each cluster's drift with its own move and the largest other one added."""
        new = np.array([[s // row[-1] for s in row[:-1]] if row[-1] else old.tolist() for row, old in zip(sums, self.centroids, strict=True)], np.int64)
        moved = np.sqrt(((new - self.centroids) ** 2).sum(1).astype(np.float64))
        other = np.array([np.delete(moved, c).max(initial=0.0) for c in range(len(moved))])
        self.centroids = new
        self.drifts.append(self.drifts[-1] + moved + other)

    def expired(self) -> DataFrame:
        """Pop: entries that were in their heap before the last move and whose key the drift has reached."""
        before, now = self.drifts[-2:]
        return reduce(DataFrame.union, [run.filter(_between(None if run is self.runs[-1] else before, now)) for run in self.runs])

    def entries(self) -> DataFrame:
        """What the heaps hold: each vector once."""
        return reduce(DataFrame.union, [*(run.filter(_between(self.drifts[-1], None)) for run in self.runs[:-1]), self.runs[-1]])


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Only vec_id and embedding are read. Vectors that are null, of another length, or hold null or non-finite components are left out.
    With fewer kept vectors than clusters each is a start. Rows that share a vec_id are vectors of their own; a null vec_id starts a cluster
    only if others don't suffice. Ties go to the smaller cluster number. A scaled component of 2**27 or more is an error,
    as squared distances would exceed a long. Without kept vectors there are no rows.
    """
    found = Clustering(vectors, clusters, rounds)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not found.runs:
        return vectors.sparkSession.createDataFrame([], schema)
    centroids = found.centroids

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                d = _matrix(part.column("x"), part.num_rows).astype(np.int64) - centroids[part.column("cluster").to_numpy()]
                yield _batch("vec_id cluster distance", part.column("vec_id"), part.column("cluster"), (d * d).sum(1))

    told = materialize(found.entries().select("vec_id", "x", "cluster").mapInArrow(task, "vec_id long, cluster int, distance long"), "heap-distances")
    own = {r["cluster"]: r["s"] for r in told.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row per cluster
    total = sum(own.values())
    marks = [(c, s, total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in own.items()]
    named = vectors.sparkSession.createDataFrame(marks, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return told.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
