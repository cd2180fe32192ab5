"""Near-duplicate operators against all pairs, compared one by one."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.llm.components import components
from lanewise.llm.embedding_join import near_duplicates
from lanewise.llm.line_dedup import alike, dedup_lines, plain, shingle_sets
from lanewise.llm.ngram_join import choose, jaccard_components
from tests.llm.data import LOWER, Union, clashing, documents, jaccard, near_copies


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(texts):
    sets, union = [shingles(t) for t in texts], Union(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        common, both = jaccard(sets[a], sets[b])
        if common and 100 * common >= 80 * both:
            union.join(a, b)
    return {(i, len(s), union.root(i)) for i, s in enumerate(sets)}


def test_components_of_paths_stars_and_self_links(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(200, 200), (7, 7), (149, 300), (None, 4)]
    random.Random(3).shuffle(links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}, 300: 100, 200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_match_all_pairs(spark, seed):
    texts = near_copies(seed)
    got = jaccard_components(clashing(documents(spark, texts), "node", "n_shingles", "component"))
    assert {tuple(r) for r in got.collect()} == brute_components(texts)


def test_jaccard_components_of_one_large_group(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(300):
        own = list(base)
        for _ in range(i % 9):
            own[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    got = jaccard_components(documents(spark, texts))
    assert {tuple(r) for r in got.collect()} == brute_components(texts)


def test_jaccard_components_of_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words stand in this one"), (None, "a b c d e f"), (2, None)]
    got = sorted((tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (1, 2, 1), (None, 2, 1), (2, 0, 2)], key=str)
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_longer_match_where_prefixes_are_crowded():
    assert choose(100, np.zeros(40)) == 1
    assert choose(100, np.full(40, 1e6)) > choose(100, np.full(40, 0.05)) > 1
    assert choose(1, np.ones(1)) == 1


def brute_lines(texts):
    first, lines = {}, []
    for i, t in enumerate(texts):
        for n, x in enumerate([] if t is None else t.split("\n")):
            if plain(x):
                lines.append((i, n, plain(x)))
                first.setdefault(plain(x), (i, n))
    sets = {x: {x[i:i + 8] for i in range(max(1, len(x) - 7))} for x in first}
    union = Union(first.values())
    for a, b in itertools.combinations(first, 2):
        common, both = jaccard(sets[a], sets[b])
        if 100 * common >= 80 * both:
            union.join(first[a], first[b])
    gone = {(i, n) for i, n, x in lines if union.root(first[x]) != (i, n)}
    out = set()
    for i, t in enumerate(texts):
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)
        out.add((i, kept, sum(1 for x in lines if x[0] == i), sum(1 for x in gone if x[0] == i)))
    return out


def test_lines_match_all_pairs(spark):
    rng, lines = random.Random(5), []
    for _ in range(30):
        base = " ".join(f"word{rng.randrange(10**5)}" for _ in range(rng.randrange(3, 40)))
        lines += [base, base.upper() + " ", base[:-1] + "#", base, "x" + base]
    lines += ["", "  ", "a", "A", "ab", "ü", "Ü", "短い行", "短い行"]
    rng.shuffle(lines)
    texts = ["\n".join(lines[i:i + 4]) for i in range(0, len(lines), 4)] + ["", None, "\n\n", texts_end(lines)]
    got = dedup_lines(clashing(documents(spark, texts), "n_lines", "line", "node", "dropped"))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "line", "node", "dropped", "n_lines", "n_dropped"]
    assert {tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()} == brute_lines(texts)


def texts_end(lines):
    return lines[0] + "\n" + lines[0]


def test_line_recall_at_the_threshold(spark):
    """Pairs of similarity just above 0.8 are found all but always."""
    rng, texts, pairs = random.Random(11), [], 0
    for _ in range(150):
        base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200)).strip()
        cut = list(base)
        cut[60] = cut[130] = "0"
        other = "".join(cut)
        assert alike(*shingle_sets([base, other]))
        pairs += 1
        texts += [base, other]
    dropped = dedup_lines(documents(spark, texts)).agg(F.sum("n_dropped")).collect()[0][0]
    assert dropped >= 0.97 * pairs


def test_lines_of_an_empty_table(spark):
    assert dedup_lines(documents(spark, [])).count() == 0


def brute_vectors(rows):
    def usable(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if usable(v)]
    links, union = {i: 0 for i, _ in rows}, Union([i for i, _ in rows])
    for (i, a), (j, b) in itertools.combinations(good, 2):
        if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95:
            links[i] += 1
            links[j] += 1
            union.join(i, j)
    return {(i, links[i], union.root(i), union.root(i) == i) for i, _ in rows}


def test_vectors_match_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for centre in rng.normal(size=(12, 16)):
        for _ in range(25):
            rows.append((centre + rng.normal(scale=rng.choice([0.1, 0.25]), size=16)).astype(np.float32).tolist())
    rows += [rows[0]] * 40 + [[2 * x for x in rows[1]], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [], None, [1.0, 0.0], [2.0, 0.0]]
    rows = list(enumerate(rows))
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "node", "vector", "n")
    assert {tuple(r) for r in near_duplicates(df).collect()} == brute_vectors(rows)


def test_vectors_of_empty_and_unusable_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert near_duplicates(spark.createDataFrame([], kind)).count() == 0
    assert [tuple(r) for r in near_duplicates(spark.createDataFrame([(5, None)], kind)).collect()] == [(5, 0, 5, True)]
