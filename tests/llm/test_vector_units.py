"""Units of vectors: met without a shuffle, and with the links of all pairs wherever they are cut."""

import numpy as np
import pytest

from lanewise.llm import embedding_join
from tests.llm.data import Union

KIND = "vec_id long, embedding array<double>"


def brute(rows):
    """Of rows with ids of their own, by vectors divided by their largest component."""
    usable = [(i, len(v), np.array(v) / np.abs(v).max()) for i, v in rows]
    links, union = {i: 0 for i, _ in rows}, Union([i for i, _ in rows])
    for k, (i, n, a) in enumerate(usable):
        for j, m, b in usable[:k]:
            if n == m and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95:
                links[i] += 1
                links[j] += 1
                union.join(i, j)
    return {(i, links[i], union.root(i), union.root(i) == i) for i, _ in rows}


def stored_plans(monkeypatch):
    plans, store = {}, embedding_join.materialize

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return store(df, name)

    monkeypatch.setattr(embedding_join, "materialize", noted)
    return plans


def test_pairs_of_units_shuffle_and_broadcast_nothing(spark, monkeypatch):
    plans = stored_plans(monkeypatch)
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 8)))]
    embedding_join.near_duplicates(spark.createDataFrame(rows, KIND)).count()
    assert "Exchange" not in plans["grid-links"], plans["grid-links"]


@pytest.mark.parametrize("most", [7, 64])
def test_links_across_small_units_match_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(embedding_join, "UNIT_BYTES", most * 8 * 12)
    rng = np.random.default_rng(most)
    rows = []
    for centre in rng.normal(size=(9, 12)):
        rows += [(centre + rng.normal(scale=rng.choice([0.05, 0.2, 0.3]), size=12)).tolist() for _ in range(20)]
    rows += [rows[3]] * 30 + [[-2.0 * x for x in rows[3]], [4.0 * x for x in rows[3]]] + rng.normal(size=(40, 5)).tolist() + [[3.0], [-1.0], [0.5]]
    order = rng.permutation(len(rows))
    rows = [(int(i), rows[k]) for i, k in enumerate(order)]
    assert {tuple(r) for r in embedding_join.near_duplicates(spark.createDataFrame(rows, KIND)).collect()} == brute(rows)


def test_blocks_of_a_unit_match_all_pairs():
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(60, 1, 24)) + rng.normal(scale=0.22, size=(60, 40, 24))).reshape(-1, 24)
    counts = rng.integers(1, 4, len(x))
    u = x / np.sqrt((x * x).sum(1))[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    basis = np.eye(24)[:, :6]
    for order in (np.arange(len(x)), np.lexsort(np.floor(u[:, 5::-1] / 0.3).T)):
        side = embedding_join._Side(x[order], counts[order], basis)
        index, links, root = embedding_join.unit_links(side, side)
        here = near[np.ix_(order, order)]
        total = here @ counts[order]
        assert np.array_equal(index, np.flatnonzero(total)) and np.array_equal(links, total[index])
        assert np.array_equal(root, embedding_join.local_roots(*np.nonzero(here), len(x))[index])
        a, b = (embedding_join._Side(x[order][s], counts[order][s], basis) for s in (slice(0, 1100), slice(1100, None)))
        index, links, _ = embedding_join.unit_links(a, b)
        between = np.concatenate((here[:1100, 1100:] @ counts[order][1100:], here[1100:, :1100] @ counts[order][:1100]))
        assert np.array_equal(index, np.flatnonzero(between)) and np.array_equal(links, between[index])


def test_components_too_large_to_square(spark):
    rows = [(1, [3e200, 4e200]), (2, [3e200, 4e200]), (3, [3e-200, 4.1e-200]), (4, [4e200, -3e200])]
    assert {tuple(r) for r in embedding_join.near_duplicates(spark.createDataFrame(rows, KIND)).collect()} == brute(rows)
