"""Filter interaction audit: what five document filters remove together, alone, and in each of their 120 orders.

A: fewer than 200 words; B: distinct words are less than half of the words; C: more than 3 % of the code points are A-Z; D: holds one
of # $ % & * |; E: a document of smaller doc_id has the same text. A document's failures are five bits, so once E is known the audit of
any order follows from the counts of at most 32 combinations a part.

E is an existential self-join. Texts are compared only within hashes that more than one id holds; every row of such a hash meets, by hash and
exact text, the one row that carries the smallest doc_id of that text, by a left semi join. A hash is cut into slices of about SLICE
bytes: its rows are dealt out to them in turn and the row with the smallest id is put into each, so a group of copies of any size is spread.
The ids found are then united with the failures of the other filters as signed rows (one more with the bit, one less without it), and a sum
by combination is all that is left; no row is joined back to its text.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import materialize

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 3, "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of equal hash that one slice of the self-join takes, about.
SLICE = 32 << 20


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text that isn't null fails."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = [n < LEAST_WORDS, 100 * distinct.cast("long") < DISTINCT_PERCENT * n.cast("long"),
             100 * capitals > CAPITAL_PERCENT * F.length(text).cast("long"), text.rlike(SYMBOLS)]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def repeats(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text, part) whose text a row of smaller doc_id has."""
    hashed = docs.withColumn("hash", F.xxhash64("text"))
    groups = hashed.groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"),
                                        F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    # A stored table: its size is known when the join with it is planned, so it is broadcast only while it is small.
    groups = materialize(groups.filter("least < most").select("hash", F.greatest(F.ceil(F.col("bytes") / SLICE), F.lit(1)).cast("int").alias("slices")), "audit-hashes")
    held = hashed.join(groups, "hash")
    first = held.groupBy("hash", "text").agg(F.min("doc_id").alias("first"), F.max("slices").alias("slices")).select(
        F.col("hash").alias("its_hash"), F.col("text").alias("its_text"), "first", F.explode(F.expr("sequence(0L, slices - 1L)")).alias("its_slice"))
    rows = held.withColumn("slice", F.pmod(F.monotonically_increasing_id(), F.col("slices")))
    same = (F.col("hash") == F.col("its_hash")) & (F.col("slice") == F.col("its_slice")) & (F.col("text") == F.col("its_text"))
    return rows.join(first, same & (F.col("first") < F.col("doc_id")), "left_semi").select("doc_id", "part", "text")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part and combination of failures (bits): n documents, good and toxic ones among them."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    bits, e = failures(F.col("text")), 1 << FILTERS.index("E")
    found = repeats(docs).select("doc_id", "part", bits.alias("bits"))
    moved = found.select("doc_id", "part", F.inline(F.array(F.struct(F.col("bits"), F.lit(-1).alias("n")),
                                                            F.struct((F.col("bits") + e).alias("bits"), F.lit(1).alias("n")))))
    rows = docs.select("doc_id", "part", bits.alias("bits"), F.lit(1).alias("n")).unionByName(moved)
    rows = rows.groupBy("doc_id", "part", "bits").agg(F.sum("n").alias("n")).filter("n <> 0")
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        *(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(out) for c, out in (("quality", "good"), ("toxic", "toxic"))))
    return rows.join(marks, "doc_id", "left").groupBy("part", "bits").agg(
        F.sum("n").alias("n"), *(F.coalesce(F.sum(F.col(c) * F.col("n")), F.lit(0)).alias(c) for c in ("good", "toxic")))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part (lang), filter_order (all 120) and step (1-5): kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Of `docs` doc_id, text and lang are read, of `labels` doc_id, quality and toxic; other columns are ignored, whatever their names. A null
    text is empty, a null lang the part ''. Every row is a document of its own: rows that share a doc_id don't repeat each other, and
    one without an id neither repeats another nor is repeated. A doc_id with several labels is good (toxic) if one of them says so; rows
    without an id have none. Words of a text are held in memory together, some 40 bytes each besides their letters. An empty
    table has no parts, hence no rows. shapley sums its filter's removals over all orders: a document with k failures is removed by each
    of them in 120 / k orders.
    """
    counts = combinations(docs, labels)
    steps = counts.withColumn("filter_order", F.explode(F.split(F.lit(",".join(ORDERS)), ","))).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = f"shiftleft(1, instr('{FILTERS}', substr(filter_order, {{}}, 1)) - 1)"
    steps = steps.withColumn("own", F.expr(bit.format("step"))).withColumn(
        "earlier", F.expr(f"aggregate(sequence(1, step), 0, (m, i) -> m + IF(i < step, {bit.format('i')}, 0))"))
    fails, gone = F.expr("bits & own <> 0"), F.expr("bits & earlier <> 0")

    def total(when: Column, what: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, what)), F.lit(0)).cast("long")

    n = F.col("n")
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone, n).alias("kept"), total(fails & ~gone, n).alias("removed"), total(fails & gone, n).alias("redundant"),
        total(F.col("bits") == F.col("own"), n).alias("unique_fails"),
        total(fails & ~gone, F.col("good")).alias("good_lost"), total(fails & ~gone, F.col("toxic")).alias("toxic_lost"),
        total(fails, n * (len(ORDERS) / F.bit_count("bits")).cast("long")).alias("shapley"))
