"""Personal data by rules and bootstrapped contextual extraction, in DataFrame functions alone.

The rules (base) find e-mail addresses, IP addresses, card and phone numbers. They are the seeds of the bootstrap: a seed and the word
before or after it make a lexical pattern (side, word, shape of the value). Other tokens with a digit or an at sign are candidates, and
so are numbers written with spaces, brackets and a leading plus. Shapes are loose, so that unseen forms meet the contexts of seeds: a
number is its count of digits (as of a phone, as of a card, or both), four numbers between dots are an address whatever their size, and so
are any two parts around an at sign. A pattern that also stands around candidates links them to the seeds. Patterns and values form a graph
that is scored in rounds: a pattern's confidence for a kind is the share of its distinct values that are of the kind, each by its own
score; a value's score is that of its best trusted pattern, a seed's is 1. Values found in one round support patterns in the next like
seeds do. After the last round candidates of trusted patterns are spans too, of that kind. Base spans always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanewise.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
# The runs are possessive and begin where no earlier character of theirs stands, or at the end of the last match: the same matches as
# without, in linear time and without recursion on long runs.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
_TOKEN = r"(?:(?<!\S)|\G)[^\s0-9@]*+[0-9@]\S*+"
#: A number with the marks of phones and cards between its digits, apart from words and other numbers.
_NUMBER = r"(?<![\p{L}\p{M}0-9@._/%#$€£-])\+?\(?[0-9](?:[\x20().0-9-]*[0-9])?(?![\p{L}\p{M}0-9@_%])"
#: The digits such a number has: as a phone (its parts aren't candidates of their own then), as a card.
PHONE_DIGITS, CARD_DIGITS = (7, 15), (13, 19)
#: Characters around a value within which its neighbouring words are looked for.
CONTEXT = 64
#: Rounds of scoring; the confidence and the distinct seeds or found values that a trusted pattern has at least.
ROUNDS, CONFIDENCE, SUPPORT = 3, 0.8, 3


def _word(text: Column, last: bool) -> Column:
    found = F.regexp_extract(text, r"(\S+)\s*$" if last else r"^\s*(\S+)", 1)
    return F.lower(F.regexp_replace(found, r"[^\p{L}]+", ""))


def _matches(text: Column, pattern: str, hint: str) -> Column:
    """Array of (start, end, value, before, after) of the matches of a pattern, in code points; before and after are words."""
    between, value = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(between.alias("between"), value.alias("value"))
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["between"])
        end = start + F.coalesce(F.length(x["value"]), F.lit(0))
        own = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), F.substring(x["between"], -CONTEXT, CONTEXT).alias("before"))
        return F.struct(end.alias("at"), F.concat(done["found"], F.array(own)).alias("found"), F.concat(
            done["heads"], F.array(F.substring(x["between"], 1, CONTEXT))).alias("heads"))

    def finish(done: Column) -> Column:
        # The piece after a match is the one before the next.
        full = F.filter(done["found"], lambda x: x["value"].isNotNull())
        return F.transform(full, lambda x, i: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), _word(x["before"], True).alias("before"),
            _word(F.get(done["heads"], i + 1), False).alias("after")))

    empty = F.struct(F.lit(0).alias("at"), none.alias("found"), F.array().cast("array<string>").alias("heads"))
    kind = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
    return F.when(text.rlike(hint), F.aggregate(parts, empty, step, finish)).otherwise(F.array().cast(kind))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _tagged(number: int, kind: str) -> Column:
    """The valid matches of a kind, with its number."""
    return F.transform(F.filter(kind, lambda x: _valid(kind, x["value"])), lambda x: F.struct(F.lit(number).alias("kind"), *[
        x[c].alias(c) for c in ("start", "end", "value", "before", "after")]))


def _count(number: int, kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == number)).cast("long").alias(f"n_{kind}")


def _shapes(value: Column) -> Column:
    """Array of the shapes of a value: one, or two for a number that a phone or a card may be."""
    letters = F.regexp_replace(value, r"\p{L}+", "a")
    exact = F.when(value.rlike("^[0-9]+$"), F.regexp_replace(value, "[0-9]", "9")).otherwise(F.regexp_replace(letters, "[0-9]+", "9"))
    n = F.length(_digits(value))
    counted = F.array_compact(F.array(F.when(n.between(*PHONE_DIGITS), "phone"), F.when(n.between(*CARD_DIGITS), "card")))
    return F.when(value.rlike(r"^[0-9]+(\.[0-9]+){3}$"), F.array(F.lit("9.9.9.9"))).when(
        value.rlike("^[^@]+@[^@]+$"), F.array(F.lit("a@a"))).when(
        value.rlike(r"^[\x20()+.0-9-]+$") & n.between(PHONE_DIGITS[0], CARD_DIGITS[1]), counted).otherwise(F.array(exact))


def _scan(docs: DataFrame) -> DataFrame:
    """Per row: row, doc_id, base and candidate spans; whole texts are read once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("any", F.col("text").rlike("[0-9@]"))
    found = rows.select("doc_id", "any", *[
        F.when(F.col("any"), _matches(F.col("text"), p, h)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")).alias(k)
        for k, p, h in [*((k, PATTERNS[k], _HINT[k]) for k in KINDS), ("token", _TOKEN, "[0-9@]"), ("number", _NUMBER, "[0-9]")]])
    rows = found.select("doc_id", "token", "number", F.concat(*[_tagged(i, k) for i, k in enumerate(KINDS)]).alias("base"))
    # A candidate lies apart from all base spans; marks around it don't count.
    lead = lambda v: F.length(F.regexp_extract(v, r"^[^\p{L}0-9@]*", 0))
    core = lambda v: F.regexp_extract(v, r"[\p{L}0-9@](?:.*[\p{L}0-9@])?", 0)
    token = F.transform("token", lambda x: F.struct(
        F.lit(None).cast("int").alias("kind"), (x["start"] + lead(x["value"])).alias("start"), (x["start"] + lead(x["value"]) + F.length(core(x["value"]))).alias("end"),
        core(x["value"]).alias("value"), x["before"].alias("before"), x["after"].alias("after")))
    digits = lambda x: F.length(_digits(x["value"]))
    number = F.transform(F.filter("number", lambda x: digits(x).between(PHONE_DIGITS[0], CARD_DIGITS[1])), lambda x: F.struct(
        F.lit(None).cast("int").alias("kind"), *[x[c].alias(c) for c in ("start", "end", "value", "before", "after")]))
    away = lambda x, y: (y["end"] <= x["start"]) | (x["end"] <= y["start"])
    rows = rows.select("doc_id", "base", token.alias("token"), F.filter(number, lambda x: F.forall("base", lambda b: away(x, b))).alias("number"))
    # A token within a number is that number or a part of it. Beyond the digits of a phone the parts may be numbers of their own.
    own = F.filter("token", lambda x: F.forall("base", lambda b: away(x, b)) & ~F.exists("number", lambda n: (
        n["start"] <= x["start"]) & (x["end"] <= n["end"]) & ((digits(n) <= PHONE_DIGITS[1]) | (n["value"] == x["value"]))))
    apart = F.concat(own, "number")
    return rows.select("doc_id", "base", apart.alias("candidates")).withColumn("row", F.monotonically_increasing_id())


def bootstrap(occurrences: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(value, kind, score) of candidates that trusted patterns discover. `occurrences`: kind (null: candidate), value, before, after.

    Edges are distinct (pattern, value) pairs, so a value or a context that holds much of the corpus adds partial sums, no pairs.
    """
    sides = F.flatten(F.transform(_shapes(F.col("value")), lambda x: F.array(
        F.concat(F.lit("L:"), "before", F.lit("|"), x), F.concat(F.lit("R:"), "after", F.lit("|"), x))))
    edges = materialize(occurrences.select("value", "kind", F.explode(sides).alias("pattern")).groupBy("value", "pattern").agg(
        F.max("kind").alias("seed")), "pii-edges")
    size = edges.groupBy("pattern").agg(F.count("*").alias("values")).filter(F.col("values") >= support)
    seeds = edges.filter("seed IS NOT NULL").select("pattern", "value", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
    free = edges.filter("seed IS NULL").select("pattern", "value").join(size.select("pattern"), "pattern", "left_semi")
    found = None
    for _ in range(rounds):
        scored = seeds if found is None else seeds.union(free.join(found, "value").select("pattern", "value", "kind", "score"))
        trusted = scored.groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count("*").alias("own")).join(
            size, "pattern").filter(F.col("own") >= support).withColumn("score", F.col("sum") / F.col("values")).filter(F.col("score") >= confidence)
        found = materialize(free.join(trusted.select("pattern", "kind", "score"), "pattern").groupBy("value").agg(
            F.max(F.struct("score", -F.col("kind"))).alias("best")).select("value", (-F.col("best.col2")).alias("kind"), F.col("best.score").alias("score")), "pii-found")
    return found


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans, n_discovered.

    Only doc_id and text are read. Spans are kind:start:end by kind as listed, then start, joined by commas; base_sha256 is the hash of the
    base ones alone. A null text counts as empty; a text without finds has empty spans. Rows that share a doc_id have a row each. An empty
    table gives no rows.
    """
    rows = materialize(_scan(docs), "pii-rows")
    base = rows.select("row", F.explode("base").alias("x")).select("row", "x.*")
    candidates = rows.select("row", F.explode("candidates").alias("x")).select("row", "x.*")
    found = bootstrap(base.union(candidates).select("kind", "value", "before", "after"))
    # Of finds within one another the longest counts.
    order = W.partitionBy("row").orderBy("start", F.desc("end"), "kind").rowsBetween(W.unboundedPreceding, -1)
    inner = F.coalesce(F.max("end").over(order) >= F.col("end"), F.lit(False))
    more = candidates.drop("kind").join(found.select("value", "kind"), "value").withColumn("inner", inner).filter("not inner").groupBy("row").agg(
        F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    short = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    names = F.array(*map(F.lit, KINDS))
    listed = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    both = F.when(F.col("more").isNull(), short).otherwise(F.array_distinct(F.concat(short, F.col("more"))))
    return rows.join(more, "row", "left").select(
        "doc_id", *[_count(i, k) for i, k in enumerate(KINDS)],
        F.sha2(listed(short), 256).alias("base_sha256"), listed(both).alias("spans"),
        F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_discovered"))
