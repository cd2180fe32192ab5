"""Heap-ordered k-means against full assignments in plain integers."""

import hashlib

import numpy as np
import pytest

from lanewise.llm.heap_kmeans import Clustering, cluster_vectors, nearest, squared
from tests.llm.data import clashing

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, clusters=40, rounds=5):
    """{row: (cluster, distance)}, inertia and centroids by comparing every vector with every centroid in every round."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(y is not None and np.isfinite(y) for y in v):
            kept.append((i, [int(np.floor(256 * y)) for y in v]))
    marks = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "~", x) for i, x in kept)
    centroids = [x for _, x in marks[:clusters]]

    def assign():
        out = []
        for _, x in kept:
            d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        own = assign()
        for c in range(len(centroids)):
            members = [x for (_, x), (k, _) in zip(kept, own) if k == c]
            if members:
                centroids[c] = [sum(col) // len(members) for col in zip(*members)]
    own = assign()
    total = sum(d for _, d in own)
    inertia = {c: sum(d for k, d in own if k == c) for c in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], total, sha[c]) for (i, _), (c, d) in zip(kept, own)), key=repr)


def found(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect()), key=repr)


def clustered(seed, n, groups, spread=0.05, scale=1.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, 64)) * scale / 8
    return [(i, (middle[rng.integers(groups)] + rng.normal(size=64) * spread * scale / 8).tolist()) for i in range(n)]


@pytest.mark.parametrize("rows", [clustered(1, 300, 12, 0.5), clustered(2, 150, 60, 0.3), clustered(3, 120, 5, 1.0, 1e5)], ids=["blurred", "many", "large"])
def test_equals_full_assignments(spark, rows):
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(3), "x", "cluster", "key", "old", "label")
    assert found(cluster_vectors(df)) == plain(rows)


def test_unfit_equal_and_nameless_vectors(spark):
    base = clustered(4, 30, 4)
    odd = [(100, None), (101, []), (102, [0.1] * 63), (103, [0.1] * 63 + [None]), (104, [float("nan")] * 64), (105, [float("inf")] + [0.0] * 63),
           (106, [0.1] * 65), (None, base[0][1]), (None, base[1][1]), (3, base[3][1]), (3, base[5][1]), *((200 + i, base[7][1]) for i in range(40)), (300, [0.0] * 64)]
    rows = base + odd
    assert found(cluster_vectors(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    assert found(cluster_vectors(spark.createDataFrame(rows, SCHEMA), clusters=1, rounds=2)) == plain(rows, 1, 2)
    assert found(cluster_vectors(spark.createDataFrame(base[:5], SCHEMA))) == plain(base[:5])
    assert cluster_vectors(spark.createDataFrame(odd[:7], SCHEMA)).count() == 0 == cluster_vectors(spark.createDataFrame([], SCHEMA)).count()


def test_only_expired_vectors_are_scanned_again(spark):
    rows = clustered(5, 2000, 40, 0.1)
    heaps = Clustering(spark.createDataFrame(rows, SCHEMA))
    scans = [run.count() for run in heaps.runs]
    assert scans[0] == 2000 == heaps.entries().count() and sum(scans[3:]) < 3000 and scans[-1] < 500
    # A vector stays out of the scans only while its cluster is still its nearest centroid.
    for r in heaps.entries().select("x", "cluster").collect():
        assert nearest(np.array([r["x"]]), heaps.centroids)[0][0] == r["cluster"]


def test_exact_distances_of_large_components():
    rng = np.random.default_rng(6)
    x, c = (rng.integers(-(1 << 27), 1 << 27, (5, 64)) for _ in range(2))
    assert squared(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]
    x, c = (rng.integers(-(1 << 22), 1 << 22, (5, 64)) for _ in range(2))
    assert squared(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]


def test_a_component_beyond_a_long_is_an_error(spark):
    with pytest.raises(Exception, match="exceed a long"):
        cluster_vectors(spark.createDataFrame([(1, [1e9] * 64)], SCHEMA)).collect()
