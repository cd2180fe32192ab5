"""Candidate lines are compared in blocks: a key that many hold makes no row per pair, and no link between blocks is lost."""

import itertools
import random

import numpy as np

from lanewise.llm import line_dedup as L
from tests.llm.data import Union, documents
from tests.llm.test_links import brute_lines


def copies(seed, n, most):
    """Lines of about 400 characters made from one by up to `most` changed words."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**4):04d}" for _ in range(70)]
    lines = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(most)):
            own[rng.randrange(70)] = f"x{rng.randrange(40):03d}"
        lines.append(" ".join(own))
    return lines


def test_a_key_of_many_components_makes_rows_for_blocks_not_for_pairs(spark):
    rows = [(k, n, 100, n) for k in (5, 6) for n in range(600)] + [(9, n, 100, 1) for n in range(1000, 1400)] + [(11, 7000, 100, 1), (11, 7001, 400, 2)]
    held = spark.createDataFrame(rows, "key long, node long, meta long, component long")
    # Keys of the same holders are one, a key of one component and one whose two lines differ too much in size make none.
    assert L.dealt(held).count() == 600 * 2
    few = L.dealt(held, lines=100).collect()
    assert len(few) == 600 * 6 and {r["key"] for r in few} == {5}
    at = {}
    for r in few:
        at.setdefault((r["i"], r["j"]), set()).add(r["node"])
    met = {p for nodes in at.values() for p in itertools.combinations(sorted(nodes), 2)}
    assert len(met) == 600 * 599 // 2


def test_lines_of_one_large_group_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(L.dealt, "__defaults__", (1 << 13, 16))
    lines = copies(3, 260, 9) + copies(4, 30, 3)
    texts = ["\n".join(lines[i:i + 2]) for i in range(0, len(lines), 2)]
    got = L.dedup_lines(documents(spark, texts)).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert {tuple(r) for r in got} == brute_lines(texts)


def test_links_between_blocks_join_what_all_pairs_join():
    rng = np.random.default_rng(1)
    sets = L.shingle_sets(copies(5, 90, 8) + copies(6, 40, 8) + ["a", "b", "short line", "short lines"])
    every = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if L.alike(sets[i], sets[j])]
    counts = L.common(sets, sets)
    assert all(counts[i, j] == len(np.intersect1d(sets[i], sets[j])) for i, j in itertools.product(range(0, len(sets), 7), repeat=2))
    of = rng.integers(0, 60, len(sets))
    x, y = L.links_between(sets, sets, of, of)
    assert len({*zip(of[x].tolist(), of[y].tolist(), strict=True)}) == len(x)
    want, got = Union(range(60)), Union(range(60))
    for i, j in every:
        want.join(of[i], of[j])
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        assert L.alike(sets[i], sets[j])
        got.join(of[i], of[j])
    assert [want.root(i) for i in range(60)] == [got.root(i) for i in range(60)]
