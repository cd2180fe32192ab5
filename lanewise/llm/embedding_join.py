"""Embedding near-dedup by epsilon grid order join.

Vectors of unit length are at most EPS apart exactly if their cosine reaches SIMILARITY. Their leading principal coordinates are cut into
cells of width EPS, and all vectors are sorted by their cells, coordinate after coordinate: the epsilon grid order, a range partitioning
in Spark. Consecutive vectors make units of UNIT_BYTES, which are stored once, and a unit has blocks of consecutive vectors. Any two units
whose boxes are at most EPS apart are read together, and of those any two such blocks are multiplied as matrices in single precision.
What lies too close to SIMILARITY for that is decided in double precision.

In many dimensions few boxes are apart, and the work is that of all pairs. Units are therefore met by a cartesian product of their files: it
reads them again and again, but shuffles and writes nothing, so that disk grows with the vectors and not with the pairs of units.

Equal neighbours in the order are one vector with a count. A pair of units returns counts and a spanning forest of its links, never the links
themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import few_rows, materialize, trimmed
from lanewise.llm.components import components

SIMILARITY = 0.95
EPS = math.sqrt(2 * (1 - SIMILARITY))
#: Leading principal coordinates that are sorted by, bytes of a unit's vectors, and vectors of a block.
LEADING, UNIT_BYTES, BLOCK = 6, 1 << 23, 1024
#: Parts in which either side of the product is read: so many at least, of so many full units at most.
PARTS, PART_UNITS = 12, 4
#: Vectors from which the principal axes are fitted, on average; they steer the order alone, never the result.
AXES_FROM = 10_000
#: Bits of a node that number it within its unit, which has at most that many vectors.
_WITHIN = 20


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings the largest component near 1: their cosines keep every digit, and squares stay finite."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _rows(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _one_list(values: pa.Array | np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def axes(vectors: DataFrame, size: int, count: int) -> np.ndarray:
    """Leading principal axes of a hash sample of about AXES_FROM vectors of one length."""
    share = min(1.0, AXES_FROM / max(count, 1))
    drawn = vectors.filter(F.pmod(F.xxhash64("row", F.lit(2)), F.lit(1_000_000)) <= share * 1_000_000).select("vector").collect()
    if len(drawn) < 2:
        return np.eye(size)[:, :LEADING]
    u = _unit(_scaled(np.array([r["vector"] for r in drawn], np.float64)))
    _, v = np.linalg.eigh(np.cov(u.T).reshape(size, size))
    return v[:, ::-1][:, :LEADING]


def _placed(vectors: DataFrame, basis: np.ndarray) -> DataFrame:
    """row, vec_id, vector, and the cell of each leading coordinate."""
    cells = [f"c{i}" for i in range(basis.shape[1])]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column("vector"), batch.num_rows)
                c = np.floor(_unit(_scaled(x)) @ basis / EPS).astype(np.int32)
                yield pa.record_batch([*(batch.column(k) for k in ("row", "vec_id", "vector")), *(pa.array(c[:, i]) for i in range(len(cells)))],
                                      names=["row", "vec_id", "vector", *cells])

    return vectors.select("row", "vec_id", "vector").mapInArrow(
        trimmed(task), "row long, vec_id long, vector array<double>, " + ", ".join(f"{c} int" for c in cells))


def _units(vectors: DataFrame, basis: np.ndarray, count: int, most: int) -> DataFrame:
    """Units of up to `most` consecutive rows in the grid order: part, number in the part, box, the vectors and their counts, and of each row
    vec_id, place of its vector among them, and count."""
    kind = ("part long, number long, low array<double>, high array<double>, vectors binary, counts binary, "
            "ids array<long>, places array<long>, copies array<long>")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, held_rows = TaskContext.get().partitionId(), 0, [], 0

        def cut(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks().to_batches()[0]
            x = _scaled(_rows(rows.column("vector"), rows.num_rows))
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]).any(1)
            place = np.cumsum(new) - 1
            x, n = x[new], np.bincount(place)
            y = _unit(x) @ basis
            columns = {"part": [part], "number": [number], "low": _one_list(y.min(0)), "high": _one_list(y.max(0)), "vectors": [x.tobytes()],
                       "counts": [n.tobytes()], "ids": _one_list(rows.column("vec_id")), "places": _one_list(place), "copies": _one_list(n[place])}
            return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))

        for batch in batches:
            held.append(batch)
            held_rows += batch.num_rows
            while held_rows >= most:
                rows = pa.Table.from_batches(held)
                yield cut(rows.slice(0, most))
                number += 1
                held, held_rows = rows.slice(most).to_batches(), held_rows - most
        if held_rows:
            yield cut(pa.Table.from_batches(held))

    placed = _placed(vectors, basis)
    cells = placed.columns[3:]
    placed = placed.withColumn("mark", F.xxhash64("vector"))  # equal vectors become neighbours
    # The row number lets copies of one vector go to several parts.
    order = [*cells, "mark", "row"]
    ordered = placed.repartitionByRange(max(1, -(-count // most)), *order).sortWithinPartitions(*order).select("vec_id", "vector")
    with few_rows(vectors.sparkSession, min(10_000, most)):
        return materialize(ordered.mapInArrow(trimmed(task), kind), "grid-units")


def local_roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index that each of n indices reaches by the links (i, j)."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, root[i], root[j])
        np.minimum.at(least, root[j], root[i])
        least = np.minimum(least, least[root])
        while not np.array_equal(least, jumped := least[least]):
            least = jumped
        if np.array_equal(least, root):
            return root
        root = least


class _Side:
    """The vectors of a unit, what they weigh, and the boxes of its blocks."""

    def __init__(self, vectors: np.ndarray, counts: np.ndarray, basis: np.ndarray):
        self.x, self.counts, self.squares = vectors, counts, np.einsum("ij,ij->i", vectors, vectors)
        u = vectors / np.sqrt(self.squares)[:, None]
        y = u @ basis
        self.u, self.starts = u.astype(np.float32), np.arange(0, len(u), BLOCK)
        self.low, self.high = np.minimum.reduceat(y, self.starts), np.maximum.reduceat(y, self.starts)

    def near(self, other: _Side) -> np.ndarray:
        """Pairs of starts of blocks whose boxes are at most EPS apart."""
        gap = np.maximum(np.maximum(self.low[:, None] - other.high[None], other.low[None] - self.high[:, None]), 0.0)
        return np.argwhere((gap * gap).sum(2) <= EPS**2 + 1e-9) * BLOCK


def links_between(x: _Side, y: _Side, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs, counted from `at` and `to`, of vectors of two blocks with a cosine of SIMILARITY or more, as double precision has it."""
    u, v = x.u[at:at + BLOCK], y.u[to:to + BLOCK]
    # Twice what rounding to single precision may change a product of unit vectors by.
    margin = max(1e-4, 2.4e-7 * (u.shape[1] + 2))
    found, step = [], max(1, (1 << 18) // len(v))
    for first in range(0, len(u), step):
        cosine = (u[first:first + step] @ v.T).ravel()
        near = np.flatnonzero(cosine >= np.float32(SIMILARITY - margin))
        if not len(near):
            continue
        i, j = near // len(v) + first, near % len(v)
        keep = cosine[near] >= np.float32(SIMILARITY + margin)
        open_, some = np.flatnonzero(~keep), max(1, (1 << 21) // u.shape[1])
        for k in (open_[k:k + some] for k in range(0, len(open_), some)):
            a, b = i[k] + at, j[k] + to
            keep[k] = np.einsum("ij,ij->i", x.x[a], y.x[b]) / np.sqrt(x.squares[a] * y.squares[b]) >= SIMILARITY
        found.append((i[keep], j[keep]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def unit_links(x: _Side, y: _Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, vectors linked to it, root) of the vectors of two units that have links; those of `y` count on from those of `x`, unless it is `x`."""
    same, n = x is y, len(x.x)
    behind = 0 if same else n
    total, trees = np.zeros(n if same else n + len(y.x), np.int64), []
    for at, to in x.near(y):
        if same and at > to:
            continue
        i, j = links_between(x, y, at, to)
        if same and at == to:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        here, there = len(x.u[at:at + BLOCK]), len(y.u[to:to + BLOCK])
        total[at:at + here] += np.bincount(i, y.counts[j + to], here).astype(np.int64)
        total[behind + to:behind + to + there] += np.bincount(j, x.counts[i + at], there).astype(np.int64)
        # Of the links of two blocks a forest is kept.
        own = np.concatenate((np.arange(at, at + here), np.arange(behind + to, behind + to + there)))
        root = local_roots(i, j + here, here + there)
        moved = np.flatnonzero(root != np.arange(here + there))
        trees.append((own[moved], own[root[moved]]))
    full = np.flatnonzero(total)
    if not len(full):
        return full, full, full
    root = local_roots(*(np.concatenate(t) for t in zip(*trees, strict=True)), len(total))
    return full, total[full], root[full]


def unit_pairs(units: DataFrame, parts: int, width: int) -> DataFrame:
    """Every two units (rank, low, high, vectors, counts) whose boxes are at most EPS apart, and every unit with itself; nothing is shuffled.

    Of (a, b) and (b, a) the sum of the ranks says which, so that the parts of the product have like work.
    """
    a, b = (units.select(*[F.col(c).alias(f"{s}_{c}") for c in ("rank", "low", "high", "vectors", "counts")]).coalesce(parts) for s in "ab")
    gap = [F.greatest(F.col("a_low")[i] - F.col("b_high")[i], F.col("b_low")[i] - F.col("a_high")[i], F.lit(0.0)) for i in range(width)]
    apart = sum((g * g for g in gap), F.lit(0.0))
    once = F.expr("a_rank = b_rank OR (a_rank < b_rank) = ((a_rank + b_rank) % 2 = 0)")
    return a.join(b.hint("shuffle_replicate_nl"), once & (apart <= EPS**2 + 1e-9)).drop("a_low", "a_high", "b_low", "b_high")


def _linked(units: DataFrame, basis: np.ndarray, parts: int) -> DataFrame:
    """(node, links, root) rows of all pairs of units of vectors of one length."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_struct_array():
                def side(s: str, r: pa.StructScalar = r) -> _Side:
                    vectors, counts = (np.frombuffer(r[f"{s}_{c}"].as_buffer(), kind) for c, kind in (("vectors", np.float64), ("counts", np.int64)))
                    return _Side(vectors.reshape(len(counts), -1), counts, basis)

                a, b = (r[f"{s}_rank"].as_py() for s in "ab")
                x = side("a")
                y = x if a == b else side("b")
                index, links, root = unit_links(x, y)
                if len(index):
                    nodes = np.concatenate([(rank << _WITHIN) + np.arange(len(z.x)) for rank, z in ((a, x), (b, y))])
                    yield pa.record_batch([pa.array(v) for v in (nodes[index], links, nodes[root])], names=["node", "links", "root"])

    with few_rows(units.sparkSession, 1):
        return materialize(unit_pairs(units, parts, basis.shape[1]).mapInArrow(trimmed(task), "node long, links long, root long"), "grid-links")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """Per row of `vectors`: vec_id, n_links, component_id, kept (vec_id = component_id).

    Only vec_id and embedding are read. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor
    do vectors of different lengths. n_links counts the other rows linked directly, equal ones among them. Rows that share a vec_id have a
    row each; a null vec_id is never the smallest. An empty table gives no rows.
    """
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    some = rows.filter(usable).withColumn("row", F.monotonically_increasing_id())
    sizes = some.groupBy(F.size("vector").alias("size")).count().collect()  # a row per length of vector
    found, members, first = [], [], 0
    for size, count in sorted(map(tuple, sizes)):
        own = some.filter(F.size("vector") == size)
        basis, most = axes(own, size, count), max(1, min(UNIT_BYTES // (8 * size), 1 << _WITHIN))
        units = _units(own, basis, count, most)
        part, number, stored = units.agg(F.max("part"), F.max("number"), F.count("*")).collect()[0]
        bits = number.bit_length()
        units = units.withColumn("rank", F.shiftleft("part", bits) + F.col("number") + F.lit(first))
        first += (part + 1) << bits
        found.append(_linked(units, basis, min(stored, max(PARTS, -(-count // (most * PART_UNITS))))))
        members.append(units.select("rank", F.inline(F.arrays_zip("ids", "places", "copies"))).select(
            (F.shiftleft("rank", _WITHIN) + F.col("places")).alias("node"), F.col("ids").alias("vec_id"), "copies"))
    if not found:
        return alone
    found, members = (reduce(DataFrame.union, x) for x in (found, members))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "grid").join(links, "node")
    named = members.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    out = named.join(smallest, "component").select("vec_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).union(alone)
