"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of distinct five-word shingles. All sets are put in one global order: shingles whose slot of a fixed-size count
table is fuller come later, ties by hash. Two sets of similarity 0.8 or more share at least l shingles among the first
n - ceil(0.8 n) + l of each. A document picks its own l: a longer prefix posts more shingles, but a pair must then share l of them,
which pays where the prefix meets many other documents, as the count table tells. A pair is verified when its prefixes share the
smaller of its two l; both prefixes then hold that many common shingles if the pair is a link, so none is lost; a pair of near sizes needs more, see `_fits`.

Documents of equal sets are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import few_rows, materialize, parts_for, trimmed
from lanewise.llm.hashing import WHITE, grams, runs, words
from lanewise.llm.linking import BLOCKS_SQL, ENTRY_BYTES, Posting, Sieve, link, stars

WORDS = 5
#: Similarity in hundredths.
SIMILARITY = 80
#: Slots of the count table, and how many of them make a row while it is summed.
SLOTS, SLOT_ROW = 1 << 18, 1 << 10
#: The longest required match; four bits hold it.
MOST_MATCHES = 12
#: Cost of verifying a pair against that of posting a shingle, and holders that a shingle meets beyond what its slot tells: the
#: table has more shingles than slots, so a passage of a few documents doesn't stand out in it.
VERIFY_COST, BACKGROUND = 50.0, 0.05
#: Texts or blocks and pairs of sets that Spark hands to a task at once, and known sets after which a task forgets them: a repeated set
#: costs a row, not an answer.
BATCH, PAIRS, KNOWN = 1024, 64, 1 << 17


def shingle_sets(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) of runs of rows."""
    for first, off, data in runs(batch):
        h, rows, _, _ = words(off, data, WHITE)
        g, begin = grams(h, rows, WORDS, short=True)
        sets = []
        for i in range(len(rows) - 1):
            s = np.sort(g[begin[i]:begin[i + 1]])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            sets.append(s)
        yield first, sets


def node_of(s: np.ndarray) -> int:
    """The node of a set: a 64-bit fingerprint."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(24)).astype(np.int64) & (SLOTS - 1)


def _measure(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, row, node, n_shingles) of the documents and, with a block, rows of the count table."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("node", pa.int64()), ("n_shingles", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for first, sets in shingle_sets(batch):
                if any(map(len, sets)):
                    count += np.bincount(_slots(np.concatenate(sets)), minlength=SLOTS)
                n = len(sets)
                yield pa.record_batch([
                    batch.column("doc_id").slice(first, n).cast(pa.int64()), batch.column("row").slice(first, n).cast(pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array(list(map(len, sets)), pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        rows = count.astype(np.int64).reshape(-1, SLOT_ROW)
        full = np.flatnonzero(rows.any(axis=1))
        m = len(full)
        yield pa.record_batch([pa.nulls(m, pa.int64())] * 4 + [pa.array(full, pa.int32()), pa.array([rows[i].astype(np.uint32).tobytes() for i in full], pa.binary())], schema=schema)

    return docs.mapInArrow(trimmed(task), "doc_id long, row long, node long, n_shingles long, block int, counts binary")


def _count_table(measured: DataFrame) -> np.ndarray:
    """The summed count table: SLOTS numbers, whatever the input."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, np.zeros(SLOT_ROW, np.int64)
        for batch in batches:
            for b, x in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                block, total = b, total + np.frombuffer(x, np.uint32)
        yield pa.record_batch([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "counts"])

    out = np.zeros((SLOTS // SLOT_ROW, SLOT_ROW), np.int64)
    summed = measured.filter("block IS NOT NULL").select("block", "counts").groupBy("block").applyInArrow(add, "block int, counts binary")
    for r in summed.collect():
        out[r["block"]] = np.frombuffer(r["counts"], np.int64)
    return out.ravel()


def choose(n: int, expected: np.ndarray) -> int:
    """The l of a document of n shingles, by the expected holders of its first shingles in the global order."""
    need = (SIMILARITY * n + 99) // 100
    start = n - need
    most = min(MOST_MATCHES, need)
    if most <= 1:
        return most
    meets = np.cumsum(expected[:start + most])[start:]
    l = np.arange(1, most + 1)
    # Posting start + l shingles; at most meets / l others share l of them, and each further match required thins them out.
    cost = start + l + meets + VERIFY_COST * meets / l**2
    return int(np.argmin(cost)) + 1


def _prefixes(docs: DataFrame, table: np.ndarray, parts: int) -> DataFrame:
    spark = docs.sparkSession
    # A fixed number of slots.
    shared = spark.sparkContext.broadcast(np.minimum(table, 2**31 - 1).astype(np.int32))
    floor = int(np.median(table))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, out, seen = shared.value, Posting(parts), set()
        for batch in batches:
            for _, sets in shingle_sets(batch):
                for s in sets:
                    n = len(s)
                    if not n or (node := node_of(s)) in seen:
                        continue
                    if len(seen) > KNOWN:
                        seen.clear()
                    seen.add(node)
                    c = count[_slots(s)]
                    order = np.argsort(c, kind="stable")[:n - (SIMILARITY * n + 99) // 100 + MOST_MATCHES]
                    l = choose(n, np.maximum(c[order] - floor, 0) + BACKGROUND)
                    order = order[:n - (SIMILARITY * n + 99) // 100 + l]
                    k = len(order)
                    yield from out.add(s[order], np.full(k, node, np.int64), np.full(k, n * 16 + l, np.int64))
        yield from out.flush()

    return docs.select("text").mapInArrow(trimmed(task), BLOCKS_SQL)


def _fits(shared: Column | None, a: Column, b: Column) -> Column:
    """Whether sizes, and the number of shared prefix shingles, allow a link.

    A link of sizes x and y has t / (1 + t) * (x + y) common shingles at least, and beyond the shorter-sighted of the two prefixes lie
    need - l of them at most, so the rest is shared in the prefixes: the smaller l, and more the closer the sizes are.
    """
    ok = F.least(_size(a), _size(b)) * 100 >= F.greatest(_size(a), _size(b)) * SIMILARITY
    return ok if shared is None else ok & (shared >= _need(a, b))


def _size(meta: Column) -> Column:
    return F.shiftright(meta, 4)


def _need(a: Column, b: Column) -> Column:
    """The number of prefix shingles that a link shares at least."""
    beyond = lambda m: F.floor((_size(m) * SIMILARITY + 99) / 100) - m.bitwiseAND(F.lit(15))
    common = F.ceil((_size(a) + _size(b)) * SIMILARITY / (100 + SIMILARITY))
    return common - F.greatest(beyond(a), beyond(b))


def _candidate_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, grams) of the wanted nodes. Tasks skip the sets that a fixed-size sieve excludes; a join decides on the rest."""
    sieve, schema = Sieve(wanted, "node"), pa.schema([("node", pa.int64()), ("grams", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for _, sets in shingle_sets(batch):
                sets = [s for s in sets if len(s)]
                node = np.array([node_of(s) for s in sets], np.int64)
                own = []
                if len(seen) > KNOWN:
                    seen.clear()
                for i in np.flatnonzero(sieve.may_hold(node)).tolist():
                    if (x := int(node[i])) not in seen:
                        seen.add(x)
                        own.append((x, sets[i].tobytes()))
                yield pa.record_batch([pa.array([x[i] for x in own], f.type) for i, f in enumerate(schema)], schema=schema)

    found = docs.select("text").mapInArrow(trimmed(task), "node long, grams binary")
    return found.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def _verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough. Only the sets of these nodes are fetched from the texts."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):  # a pair at a time: sets are large
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= SIMILARITY * (len(x) + len(y) - common))
            yield pa.record_batch([batch.column("a"), batch.column("b")], schema=schema).filter(pa.array(keep, pa.bool_()))

    pairs = materialize(pairs, "ngram-pairs")
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ngram-wanted")
    sets = materialize(_candidate_sets(docs, wanted), "ngram-sets")
    a, b = (sets.select(F.col("node").alias(n), F.col("grams").alias(g)) for n, g in (("a", "x"), ("b", "y")))
    # Dealt anew by pair: a set with many candidates would leave all of them to one task.
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").repartition("a", "b")
    with few_rows(docs.sparkSession, PAIRS):
        return materialize(both.mapInArrow(trimmed(task), "a long, b long"), "ngram-verified")


def row_components(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, row, text): doc_id, row, n_shingles, component (null without shingles) and component_id.

    Rows link by their texts alone, so a component holds all rows that links reach, whatever ids they share or lack.
    """
    spark = docs.sparkSession
    with few_rows(spark, BATCH):
        measured = materialize(_measure(docs), "ngram-measure")
        rows = measured.filter("block IS NULL").select("doc_id", "row", "node", "n_shingles")
        total = rows.agg(F.sum("n_shingles")).collect()[0][0] or 0
        parts = parts_for(spark, total * (1 - SIMILARITY / 100) * ENTRY_BYTES)
        star = stars(_prefixes(docs, _count_table(measured), parts), parts, "ngram-stars")
        joined = link(star, _fits, lambda pairs: _verify(docs, pairs), "ngram", need=_need)
    first = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    named = first.join(joined, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = named.join(smallest, "component").select("node", "component", "component_id")
    return rows.join(ids, "node", "left").select("doc_id", "row", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id (smallest doc_id that links reach).

    Two documents link when 100 * intersection >= 80 * union of their shingle sets. Only doc_id and text are read. Null and empty
    texts and texts without words have no shingles and link with nothing; 1 to 4 words are one shingle. Rows that share a doc_id
    each have their row; their components are joined only if their texts are. An empty table gives no rows. Hashes are 64 bits.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("row"), F.col("text").cast("string").alias("text"))
    return row_components(docs).select("doc_id", "n_shingles", "component_id")
