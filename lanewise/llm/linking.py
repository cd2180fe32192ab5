"""Candidate pairs from shared keys, without listing the pairs within a group.

Nodes post keys. A first pass links every node with one earlier holder of each key (its hub), so a key shared by g nodes makes g - 1
rows. The likeliest of these pairs are verified and joined into components. Only then are the other pairs of a key listed, and only
those between different components, so a group of near copies that is already one component makes none, and no pair whose link
could still change a component is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.common import materialize, trimmed
from lanewise.llm.components import components

# Entries of one task that are held before they are dealt to parts.
HELD = 400_000
BLOCKS = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary()), ("metas", pa.binary())])
BLOCKS_SQL = "part int, keys binary, nodes binary, metas binary"
ENTRY_BYTES = 20


class Posting:
    """Collects (key, node, meta) entries of a task and deals them to parts by key, one block of each part at a time."""

    def __init__(self, parts: int):
        self.parts, self.held, self.size = parts, [], 0

    def add(self, key: np.ndarray, node: np.ndarray, meta: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((key.view(np.int64), node.view(np.int64), meta.astype(np.int32)))
        self.size += len(key)
        if self.size >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            key, node, meta = (np.concatenate(x) for x in zip(*self.held, strict=True))
            part = ((key.view(np.uint64) >> np.uint64(17)) % np.uint64(self.parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(self.parts + 1))
            full = np.flatnonzero(np.diff(cut))
            columns = [[x[order[cut[p]:cut[p + 1]]].tobytes() for p in full] for x in (key, node, meta)]
            yield pa.record_batch([pa.array(full, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], schema=BLOCKS)
        self.held, self.size = [], 0


STARS = pa.schema([(c, pa.int64()) for c in ("key", "node", "meta", "hub", "hub_meta")])


def stars(blocks: DataFrame, parts: int, name: str) -> DataFrame:
    """(key, node, meta, hub, hub_meta) for every entry whose key an earlier node, the hub, holds. Single holders vanish.

    A task holds the distinct keys of its parts, whatever the number of entries of a key. Nodes that are posted by several tasks
    may stand in several rows.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            key, node = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int64) for c in ("keys", "nodes"))
            meta = np.frombuffer(b"".join(batch.column("metas").to_pylist()), np.int32).astype(np.int64)
            order = np.lexsort((node, key))
            key, node, meta = key[order], node[order], meta[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            other = new.copy()
            other[1:] |= node[1:] != node[:-1]
            key, node, meta, new = key[other], node[other], meta[other], new[other]
            first = np.flatnonzero(new)
            hub, hub_meta = node[first].copy(), meta[first].copy()
            fresh = np.ones(len(first), bool)
            if len(known[0]):
                at = np.minimum(np.searchsorted(known[0], key[first]), len(known[0]) - 1)
                old = known[0][at] == key[first]
                hub[old], hub_meta[old], fresh = known[1][at[old]], known[2][at[old]], ~old
            own = np.cumsum(new) - 1
            link = np.flatnonzero(node != hub[own])
            if len(link):
                yield pa.record_batch([pa.array(x) for x in (key[link], node[link], meta[link], hub[own[link]], hub_meta[own[link]])],
                                      schema=STARS)
            add = [x[fresh] for x in (key[first], hub, hub_meta)]
            together = np.argsort(merged := np.concatenate((known[0], add[0])), kind="stable")
            known = [merged[together], *(np.concatenate((k, a))[together] for k, a in zip(known[1:], add[1:], strict=True))]

    return materialize(blocks.repartition(parts, "part").mapInArrow(
        trimmed(task), "key long, node long, meta long, hub long, hub_meta long"), name)


class Sieve:
    """A bit per slot of a fixed number of slots: lets a task skip what certainly isn't wanted before it is shuffled."""

    def __init__(self, wanted: DataFrame, column: str, log2: int = 23):
        slot = F.shiftrightunsigned(F.col(column), 64 - log2)
        bits = wanted.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, CAST(slot AS INT) & 63)")).alias("bits"))
        table = np.zeros(1 << (log2 - 6), np.int64)
        # One row per 64 slots at most.
        for r in bits.collect():
            table[r["word"]] = r["bits"]
        self.shift, self.bits = np.uint64(64 - log2), wanted.sparkSession.sparkContext.broadcast(table)

    def may_hold(self, x: np.ndarray) -> np.ndarray:
        slot = x.view(np.uint64) >> self.shift
        return (self.bits.value.view(np.uint64)[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0

    def __getstate__(self):
        return self.shift, self.bits

    def __setstate__(self, state):
        self.shift, self.bits = state


def listings(held: DataFrame, fits: Callable, need: Callable | None) -> tuple[DataFrame, DataFrame]:
    """(rows a, b, meta_a, meta_b of pairs in different components, one for each key that lists them; the entries of keys that may list any).

    See :func:`link` for `fits` and `need`; `held` has key, node, meta and the component of the node.
    """
    mixed = held.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("largest"), F.count("*").alias("kinds"), F.sum("n").alias("holders")).filter("kinds > 1")
    held = held.join(mixed.select("key", "largest", "holders"), "key")
    # As many rows of a node as it has keys, at most.
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("holders"), "key")) if need else F.lit(1)
    held = held.withColumn("place", place)
    left = held.filter("component <> largest").select("key", F.col("node").alias("a"), F.col("meta").alias("meta_a"), F.col("component").alias("in_a"), F.col("place").alias("place_a"))
    right = held.select("key", F.col("node").alias("b"), F.col("meta").alias("meta_b"), F.col("component").alias("in_b"), "largest", F.col("place").alias("place_b"))
    pairs = left.join(right, "key").filter("in_a <> in_b AND (in_b = largest OR a < b)").filter(fits(None, F.col("meta_a"), F.col("meta_b")))
    if need:
        pairs = pairs.filter(F.least("place_a", "place_b") >= need(F.col("meta_a"), F.col("meta_b")))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
                         F.when(F.col("a") < F.col("b"), F.col("meta_a")).otherwise(F.col("meta_b")).alias("meta_a"),
                         F.when(F.col("a") < F.col("b"), F.col("meta_b")).otherwise(F.col("meta_a")).alias("meta_b"))
    return pairs, held


def listed_pairs(held: DataFrame, fits: Callable, need: Callable | None) -> DataFrame:
    """The pairs (a, b) in different components that share enough keys."""
    pairs, held = listings(held, fits, need)
    if need:
        keys = held.groupBy("node").agg(F.collect_list("key").alias("keys"))
        own = (keys.select(F.col("node").alias(n), F.col("keys").alias(f"keys_{n}")).hint("merge") for n in "ab")
        pairs = pairs.distinct().join(next(own), "a").join(next(own), "b").withColumn("shared", F.size(F.array_intersect("keys_a", "keys_b")))
    else:
        pairs = pairs.groupBy("a", "b", "meta_a", "meta_b").agg(F.count("*").alias("shared"))
    return pairs.filter(fits(F.col("shared"), F.col("meta_a"), F.col("meta_b"))).select("a", "b")


def link(star: DataFrame, fits: Callable, verify: Callable[[DataFrame], DataFrame], name: str, top: int = 3, need: Callable | None = None,
         compare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, component) of all nodes that verified pairs join.

    `fits(shared, meta, other_meta)` is the condition for a pair worth verifying, by the number of keys it shares and what the
    two nodes posted; `verify` keeps the pairs (a, b) that are links. First every node meets the `top` hubs it shares most keys
    with, of those that fit. Then every pair of a key whose ends still lie in different components is listed, those of the key's largest component
    never with each other.

    `need(meta, other_meta)` is the least number of keys that a pair worth verifying shares. Both ends order their keys alike, the widest held
    first; the last key that they share stands at that place or later in both, so a pair is listed by such keys only. A key that many hold
    then lists none of the pairs that share too few, and the keys shared by the listed ones are counted from both ends.

    `compare(held)`, if given, finds the links between different components itself, from key, node, meta and component, and no pair is listed.
    """
    entries = materialize(star.select("key", "node", "meta").union(star.select("key", "hub", "hub_meta")).distinct(), f"{name}-entries")
    # The hub of a key is its holder that shares most keys at all: of near copies one that was changed little.
    held = entries.join(entries.groupBy("node").agg(F.count("*").alias("keys")), "node")
    central = held.groupBy("key").agg(F.max_by(F.struct(F.col("node").alias("hub"), F.col("meta").alias("hub_meta")), F.struct("keys", "node")).alias("x")).select("key", "x.*")
    hubs = entries.join(central, "key").filter("node <> hub").groupBy("node", "hub", "meta", "hub_meta").agg(F.count("*").alias("shared"))
    # As many rows of a node as it has keys, at most.
    best = hubs.filter(fits(F.col("shared"), F.col("meta"), F.col("hub_meta"))).groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("shared", "hub", "meta", "hub_meta")), False), 1, top).alias("best"))
    first = best.select(F.col("node").alias("a"), F.explode("best").alias("x")).select("a", F.col("x.hub").alias("b"))
    near = materialize(verify(first), f"{name}-near")
    joined = components(near, f"{name}-near")

    held = materialize(entries.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")), f"{name}-held")
    rest = compare(held) if compare else verify(listed_pairs(held, fits, need))
    return components(near.union(rest), f"{name}-all")
