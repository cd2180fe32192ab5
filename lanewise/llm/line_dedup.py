"""Fuzzy line dedup by MinHash.

Lines are compared without case and outer white space. A line is its set of CHARS-character shingles. One permutation hashing deals
the shingles to BINS bins and keeps each bin's smallest hash; an empty bin borrows from the next full one. Every ROWS bins form a
band, and equal bands make lines candidates: at similarity 0.8 a pair shares no band with probability about (1 - 0.8**ROWS)**(BINS /
ROWS), 0.002. Candidates are verified by the exact Jaccard similarity of their shingle sets, links are joined by distributed
union-find, and of each component the first line, by doc_id, then row, then line number, stays. Every row of the table is a document of its
own, whatever its doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import few_rows, materialize, numbered, parts_for, trimmed
from lanewise.llm.hashing import U, char_grams, code_points, mix, runs
from lanewise.llm.linking import BLOCKS_SQL, ENTRY_BYTES, Posting, Sieve, link, stars

CHARS = 8
SIMILARITY = 80
BINS, ROWS = 48, 4
#: Lines that `signatures` takes at most (it numbers them in 20 bits), and characters of candidate lines that are taken apart at once.
LINES, CHARACTERS = 1 << 13, 1 << 18
#: Distinct shingles and lines of a block of candidate lines, common shingles that a product of two blocks takes at once, and pairs below which
#: two blocks are compared pair by pair.
BLOCK, BLOCK_LINES, COLUMNS, FEW = 1 << 18, 512, 1 << 13, 48
#: Texts or blocks that Spark hands to a task at once, and known lines after which a task forgets them: a repeated line costs a row, not an answer.
BATCH, KNOWN = 1024, 1 << 17
_EMPTY = U(2**64 - 1)


def line_node(line: str) -> int:
    """The node of a line that isn't blank: a fingerprint of its text without case and outer white space."""
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def plain(line: str) -> str:
    return line.strip().lower()


def lines_of(batch: pa.RecordBatch) -> Iterator[tuple[int, list[list[str]]]]:
    """(first row, plain lines of each row) of runs of rows."""
    for first, off, data in runs(batch):
        raw = data.tobytes()
        yield first, [[plain(x) for x in raw[a:b].decode("utf-8", "replace").split("\n")] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def signatures(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the bands, distinct shingles) of at most 2**20 lines that aren't empty."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    g, begin = char_grams(code_points("".join(lines)), np.concatenate(([0], np.cumsum(size))), CHARS)
    owner = np.repeat(np.arange(len(lines), dtype=np.uint64), np.diff(begin))
    # Line (20 bits), bin (6), hash (38) in one number: sorted, the first of each line and bin is its smallest hash.
    s = np.sort(owner << U(44) | (g >> U(26)) % U(BINS) << U(38) | (g >> U(40) ^ g & U(0x3FFFFFF) << U(12)) & U((1 << 38) - 1))
    distinct = np.bincount((s[np.concatenate(([True], s[1:] != s[:-1]))] >> U(44)).astype(np.int64), minlength=len(lines))
    head = s >> U(38)
    first = np.concatenate(([True], head[1:] != head[:-1]))
    s, head = s[first], head[first]
    sig = np.full((len(lines), BINS), _EMPTY)
    sig[(head >> U(6)).astype(np.int64), (head & U(63)).astype(np.int64)] = s & U((1 << 38) - 1)
    full = np.concatenate((sig, sig), axis=1) != _EMPTY
    source = np.where(full, np.arange(2 * BINS), 4 * BINS)
    source = np.minimum.accumulate(source[:, ::-1], axis=1)[:, ::-1][:, :BINS]
    lent = source - np.arange(BINS)
    sig = np.take_along_axis(sig, source % BINS, axis=1) + lent.astype(U) * U(0x9E3779B97F4A7C15)
    key = np.broadcast_to(np.arange(BINS // ROWS, dtype=np.uint64), (len(lines), BINS // ROWS))
    for i in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + sig[:, i::ROWS])
    return key, distinct


def keyed(lines: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first line, keys of the bands, distinct shingles) of any number of lines, LINES at a time."""
    for at in range(0, len(lines), LINES):
        yield at, *signatures(lines[at:at + LINES])


def _held_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line, node) of every line that isn't blank."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("line", pa.int32()), ("node", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, number = batch.column("doc_id"), batch.column("row")
            for first, rows in lines_of(batch):
                at = [(first + r, i, line_node(x)) for r, own in enumerate(rows) for i, x in enumerate(own) if x]
                row, line, node = zip(*at, strict=True) if at else ((), (), ())
                row = pa.array(row, pa.int64())
                yield pa.record_batch([doc.take(row), number.take(row), pa.array(line, pa.int32()), pa.array(node, pa.int64())], schema=schema)

    return docs.mapInArrow(trimmed(task), "doc_id long, row long, line int, node long")


def _posted(docs: DataFrame, parts: int) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = Posting(parts), set()
        for batch in batches:
            for _, rows in lines_of(batch):
                new = {n: x for own in rows for x in own if x and (n := line_node(x)) not in seen}
                if len(seen) > KNOWN:
                    seen.clear()
                seen.update(new)
                node = np.fromiter(new, np.int64, len(new))
                for at, key, size in keyed(list(new.values())):
                    k = key.shape[1]
                    yield from out.add(key.ravel(), np.repeat(node[at:at + len(key)], k), np.repeat(size, k))
        yield from out.flush()

    return docs.select("text").mapInArrow(trimmed(task), BLOCKS_SQL)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, words) of the wanted lines; tasks skip the lines that a fixed-size sieve excludes, a join decides on the rest."""
    sieve, schema = Sieve(wanted, "node"), pa.schema([("node", pa.int64()), ("line", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for _, rows in lines_of(batch):
                new = {n: x for own in rows for x in own if x and (n := line_node(x)) not in seen}
                node = np.fromiter(new, np.int64, len(new))
                node = node[sieve.may_hold(node)]
                if len(seen) > KNOWN:
                    seen.clear()
                seen.update(node.tolist())
                yield pa.record_batch([pa.array(node), pa.array([new[x] for x in node.tolist()], pa.string())], schema=schema)

    return docs.select("text").mapInArrow(trimmed(task), "node long, line string").join(wanted, "node", "left_semi").dropDuplicates(["node"])


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each line."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    g, begin = char_grams(code_points("".join(lines)), np.concatenate(([0], np.cumsum(size))), CHARS)
    return [np.unique(g[x:y]) for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def slices(size: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ends of runs of rows whose sizes sum up to `limit` at most; a larger row is a run of its own."""
    total, at = np.cumsum(size), 0
    while at < len(total):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
        yield at, end
        at = end


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two shingle sets have similarity 0.8 or more."""
    if 100 * min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate((x, y)))
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= SIMILARITY * (len(x) + len(y) - common)


def _fits(shared: Column | None, a: Column, b: Column) -> Column:
    # The sizes are counted by 38-bit hashes: two shingles of a line may rarely count as one.
    return (F.least(a, b) + 2) * 100 >= F.greatest(a, b) * SIMILARITY


def _verify(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose lines, by `texts` (node, line), are alike."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.add(*(pc.utf8_length(batch.column(c)).to_numpy() for c in ("x", "y")))
            # A line that stands in many pairs of a slice is taken apart once.
            for at, end in slices(size, CHARACTERS):
                part = batch.slice(at, end - at)
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                line = dict(zip(a + b, part.column("x").to_pylist() + part.column("y").to_pylist(), strict=True))
                own = dict(zip(line, shingle_sets(list(line.values())), strict=True))
                keep = [alike(own[x], own[y]) for x, y in zip(a, b, strict=True)]
                yield pa.record_batch([part.column("a"), part.column("b")], schema=schema).filter(pa.array(keep, pa.bool_()))

    pairs = materialize(pairs, "lines-pairs")
    a, b = (texts.select(F.col("node").alias(n), F.col("line").alias(g)) for n, g in (("a", "x"), ("b", "y")))
    # Dealt anew by pair: a line with many candidates would leave all of them to one task.
    both = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "x", "y").repartition("a", "b")
    return materialize(both.sortWithinPartitions("a").mapInArrow(trimmed(task), "a long, b long"), "lines-verified")


def dealt(held: DataFrame, block: int = BLOCK, lines: int = BLOCK_LINES) -> DataFrame:
    """(key, i, j, block, node, component): the holders of every key that joins several components, in blocks of bounded size, a block once for
    each pair of blocks (i, j) that it belongs to.

    `held` has key, node, meta (distinct shingles) and component. Keys of the same holders are one.
    """
    keys = held.groupBy("key").agg(
        F.count("*").alias("holders"), F.sum("meta").alias("size"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y"), F.min("meta").alias("least"),
        F.max("meta").alias("most"), F.min("component").alias("low"), F.max("component").alias("high"))
    keys = keys.filter((F.col("low") < F.col("high")) & ((F.col("holders") > 2) | _fits(None, F.col("least"), F.col("most"))))
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("holders") / lines)).cast("int")
    keys = keys.groupBy("holders", "size", "x", "y").agg(F.min("key").alias("key")).select("key", blocks.alias("blocks"))
    placed = held.select("key", "node", "component").join(keys, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    return placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component")


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of every two sorted sets, as a product of 0-1 matrices."""
    flat = [np.concatenate(s) for s in (left, right)]
    both = np.intersect1d(*flat)
    places = []
    for sets, x in zip((left, right), flat, strict=True):
        at = np.searchsorted(both, x)
        hit = at < len(both)
        hit[hit] = both[at[hit]] == x[hit]
        places.append((np.repeat(np.arange(len(sets)), list(map(len, sets)))[hit], at[hit]))
    total = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, len(both), COLUMNS):
        end = min(begin + COLUMNS, len(both))
        part = []
        for sets, (owner, at) in zip((left, right), places, strict=True):
            now = (at >= begin) & (at < end)
            m = np.zeros((len(sets), end - begin), np.float32)
            m[owner[now], at[now] - begin] = 1
            part.append(m)
        total += part[0] @ part[1].T
    return total.astype(np.int64)


def links_between(left: list[np.ndarray], right: list[np.ndarray], in_left: np.ndarray, in_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in left, in right) of links of two lists of shingle sets, one for each two components that any joins."""
    a, b = (np.fromiter(map(len, s), np.int64, len(s)) for s in (left, right))
    ok = (in_left[:, None] != in_right) & (100 * np.minimum(a[:, None], b) >= SIMILARITY * np.maximum(a[:, None], b))
    x, y = np.nonzero(ok)
    if len(x) <= FEW:
        good = np.fromiter((alike(left[i], right[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)), bool, len(x))
    else:
        # Sets that fit none are left out.
        rows, columns = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
        shared = np.zeros(ok.shape, np.int64)
        shared[np.ix_(rows, columns)] = common([left[i] for i in rows], [right[j] for j in columns])
        good = (100 * shared >= SIMILARITY * (a[:, None] + b - shared))[x, y]
    x, y = x[good], y[good]
    _, first = np.unique(np.stack((in_left[x], in_right[y])), axis=1, return_index=True)
    return x[first], y[first]


def _linked(texts: DataFrame, held: DataFrame) -> DataFrame:
    """Links (a, b) that join the components of `held` as all links between holders of the same key do.

    Lines travel to pairs of blocks, not to pairs of lines: a key of g holders whose components stay apart costs g rows for each of its blocks.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(rows: pa.Table) -> pa.RecordBatch:
        cut = _starts(rows)
        i, j, block, node, component = (rows.column(c).to_numpy() for c in ("i", "j", "block", "node", "component"))
        line = dict(zip(node.tolist(), rows.column("line").to_pylist(), strict=True))
        size, own = np.fromiter(map(len, line.values()), np.int64, len(line)), []
        for at, end in slices(size, CHARACTERS):
            own += shingle_sets(list(line.values())[at:end])
        own, found = dict(zip(line, own, strict=True)), ([], [])
        for begin, end in zip(cut.tolist(), [*cut[1:].tolist(), len(node)], strict=True):
            of = component[begin:end]
            kinds, which, n = np.unique(of, return_inverse=True, return_counts=True)
            if len(kinds) == 1:
                continue
            # Two lines of the largest component need no link.
            outside, here = which != np.argmax(n), block[begin:end]
            if i[begin] == j[begin]:
                sides = [(outside, np.ones(end - begin, bool))]
            else:
                sides = [(outside & (here == i[begin]), here == j[begin]), (outside & (here == j[begin]), ~outside & (here == i[begin]))]
            for side in sides:
                x, y = (begin + np.flatnonzero(s) for s in side)
                if len(x) and len(y):
                    p, q = links_between([own[v] for v in node[x].tolist()], [own[v] for v in node[y].tolist()], component[x], component[y])
                    found[0].append(node[x[p]])
                    found[1].append(node[y[q]])
        return pa.record_batch([pa.array(np.concatenate([*f, np.zeros(0, np.int64)])) for f in found], schema=schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            rows = pa.Table.from_batches([*(waiting.to_batches() if waiting else []), batch])
            last = int(_starts(rows)[-1]) if rows.num_rows else 0
            # The last pair of blocks may go on.
            if last and pc.sum(pc.utf8_length(rows.column("line"))).as_py() >= CHARACTERS:
                yield links(rows.slice(0, last))
                rows = rows.slice(last)
            waiting = rows
        if waiting and waiting.num_rows:
            yield links(waiting)

    placed = materialize(dealt(held), "lines-blocks")
    met = placed.join(texts.hint("merge"), "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return materialize(met.mapInArrow(trimmed(task), "a long, b long"), "lines-linked")


def _starts(rows: pa.Table) -> np.ndarray:
    """Where pairs of blocks begin among sorted rows."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in ("key", "i", "j"):
        x = rows.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def line_components(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line, component, keep) of every line of `docs` (doc_id, row, text) that isn't blank; lines count from 0, rows are unique."""
    spark = docs.sparkSession
    with few_rows(spark, BATCH):
        held = materialize(_held_lines(docs), "lines-held")
        parts = parts_for(spark, held.count() * (BINS // ROWS) * ENTRY_BYTES)
        star = stars(_posted(docs, parts), parts, "lines-stars")
        # Lines that share a band with any other: only these are compared, and fetched once.
        wanted = materialize(star.select("node").union(star.select("hub")).distinct(), "lines-wanted")
        texts = materialize(_texts(docs, wanted), "lines-texts")
        joined = link(star, _fits, lambda pairs: _verify(texts, pairs), "lines", compare=lambda held: _linked(texts, held))
    # Of each text its first line, then of each component: two sums of small rows, whatever a text's copies.
    first = held.groupBy("node").agg(F.min(F.struct("doc_id", "row", "line")).alias("first"))
    named = first.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    keeper = named.groupBy("component").agg(F.min("first").alias("keeper"))
    ids = named.join(keeper, "component").select("node", "component", "keeper")
    return held.join(ids, "node").select(
        "doc_id", "row", "line", "component", ((F.col("row") == F.col("keeper.row")) & (F.col("line") == F.col("keeper.line"))).alias("keep"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """`docs` with n_lines, n_dropped and a text without the lines that an earlier line stands for; other columns stay as they are.

    Two lines link at a similarity of 0.8 or more. Blank lines stay; a null text stays null with 0 lines. A document that loses all
    its lines stays with what is left of its text. Rows that share a doc_id, or have none, are documents of their own, in an
    order of their own. A null doc_id comes first. Only doc_id and text are read; columns of `docs` named n_lines or n_dropped are replaced. Line ends are
    line feeds. An empty table gives no rows.
    """
    stay = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs, number = numbered(docs.select(stay), "lines-docs")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(number).alias("row"), F.col("text").cast("string").alias("text"))
    lines = line_components(text)
    told = lines.groupBy("row").agg(F.count("*").alias("n_lines"), F.collect_set(F.when(~F.col("keep"), F.col("line"))).alias("dropped"))
    joined = docs.alias("d").join(told.alias("t"), F.col(f"d.{number}") == F.col("t.row"), "left")
    gone, own = F.col("t.dropped"), lambda c: F.col(f"d.`{c}`")
    keep = F.filter(F.split(own("text"), "\n", -1), lambda _, i: ~F.array_contains(gone, i))
    return joined.select(
        *[F.when(F.size(gone) > 0, F.array_join(keep, "\n")).otherwise(own(c)).alias(c) if c == "text" else own(c) for c in stay],
        F.coalesce("t.n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"))
