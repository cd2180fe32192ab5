import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.operators import pairs as P
from lanewise.schema import PairStatus, PairType
from tests.helpers import agents, by, points, scenarios
from tests.test_individual import random_tracks

EPS = 1e-6


def segments_meet(a, b, c, d):
    def orient(p, q, s):
        return np.sign((q[0] - p[0]) * (s[1] - p[1]) - (q[1] - p[1]) * (s[0] - p[0]))

    def inside(p, q, s):
        return min(p[0], q[0]) <= s[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= s[1] <= max(p[1], q[1])

    o = orient(a, b, c), orient(a, b, d), orient(c, d, a), orient(c, d, b)
    return bool((o[0] != o[1] and o[2] != o[3]) or (o[0] == 0 and inside(a, b, c)) or (o[1] == 0 and inside(a, b, d))
                or (o[2] == 0 and inside(c, d, a)) or (o[3] == 0 and inside(c, d, b)))


def brute(ri, rj, criterion="critical", radius=10.0, length=1.0):
    shared = [(p, q) for p in ri for q in rj if p[0] == q[0] and p[6] and q[6]]
    a, b = np.array([s[0][1:3] for s in shared]), np.array([s[1][1:3] for s in shared])
    va = np.array([math.hypot(s[0][3], s[0][4]) + EPS for s in shared])
    vb = np.array([math.hypot(s[1][3], s[1][4]) + EPS for s in shared])
    ha, hb = np.array([s[0][5] for s in shared]), np.array([s[1][5] for s in shared])
    sep = np.hypot(*(a - b).T)
    meet = [segments_meet(a[k], a[k + 1], b[k], b[k + 1]) for k in range(len(a) - 1)]
    hit = np.array([meet[0], *meet], float)
    crash = ((sep <= 0.5) | (hit > 0)).astype(float)
    times = []
    for ti in range(len(a)):
        d = np.hypot(*(b - a[ti]).T)
        if d.min() > radius:
            continue
        k = min(ti, int(d.argmin())) + 1
        times.append(np.abs(np.hypot(*(a[:k] - a[ti]).T) / va[:k] - np.hypot(*(b[:k] - a[ti]).T) / vb[:k]).min())
    aligned = np.abs((hb - ha + 540) % 360 - 180) <= 45
    out = dict(n=len(a), stationary=va.mean() < 2 and vb.mean() < 2, aligned=int(aligned.sum()))
    thw, ttc, drac = [], [], []
    for k in np.flatnonzero(aligned):
        bearing = math.degrees(math.atan2(b[k][1] - a[k][1], b[k][0] - a[k][0]))
        i_first = abs((bearing - ha[k] + 180) % 360 - 180) > 90
        gap = sep[k] - length
        follow, dv = (vb[k], vb[k] - va[k]) if i_first else (va[k], va[k] - vb[k])
        thw.append(abs(gap / (follow + EPS)))
        ttc.append(abs(gap / (dv + EPS)) if dv > 0 else math.inf)
        drac.append(min(dv * dv / (2 * abs(gap) + EPS), 20) if dv > 0 else 0.0)
    if out["aligned"] < 2:
        thw, ttc, drac = [math.inf], [math.inf], [0.0]
    crit = criterion == "critical"
    out |= dict(
        separation=sep.min() if crit else sep.mean(), intersection=hit.sum() if crit else hit.mean(),
        collision=crash.sum() if crit else crash.mean(),
        mttcp=(min(times) if crit else np.mean(times)) if times else math.inf,
        thw=min(thw) if crit else np.mean(thw), ttc=min(ttc) if crit else np.mean(ttc),
        drac=max(drac) if crit else np.mean(drac))
    return out


@pytest.mark.parametrize("criterion", ["critical", "average"])
def test_against_numpy(spark, criterion):
    tracks = random_tracks(5, 24, seed=11)
    pts = points(spark, tracks)
    got = by(P.pair_features(pts, scenarios(spark, n=24), scope="all", criterion=criterion), "i", "j")
    assert len(got) == 10
    for (i, j), r in got.items():
        want = brute(tracks[i], tracks[j], criterion)
        assert r.n_shared == want["n"]
        assert r.status == (PairStatus.STATIONARY if want["stationary"] else
                            PairStatus.PARTIAL_HEADING if want["aligned"] < 2 else PairStatus.OK)
        for m in ("separation", "intersection", "collision", "mttcp", "thw", "ttc", "drac"):
            assert getattr(r, m) == pytest.approx(want[m], rel=1e-6), m
        for m in ("mttcp", "thw", "ttc"):
            assert getattr(r, f"inv_{m}") == pytest.approx(min(1 / (want[m] + EPS), 10), rel=1e-6)


def test_ego_scope_is_a_filter_of_all(spark):
    tracks = random_tracks(4, 12, seed=5)
    pts, s = points(spark, tracks), scenarios(spark, ego=2, n=12)
    every = by(P.pair_features(pts, s, scope="all"), "i", "j")
    ego = by(P.pair_features(pts, s, scope="ego"), "i", "j")
    assert set(ego) == {k for k in every if 2 in k}
    for k, r in ego.items():
        assert r.mttcp == pytest.approx(every[k].mttcp) and r.status == every[k].status


def test_explicit_pairs_match(spark):
    tracks = random_tracks(4, 12, seed=6)
    pts, s = points(spark, tracks), scenarios(spark, n=12)
    wanted = spark.createDataFrame([(1, 0, 3), (1, 1, 2)], "scenario_id long, i long, j long")
    got = by(P.features_for_pairs(pts, s, wanted), "i", "j")
    every = by(P.pair_features(pts, s, scope="all"), "i", "j")
    assert set(got) == {(0, 3), (1, 2)}
    assert all(got[k].ttc == pytest.approx(every[k].ttc) for k in got)


def still(x, y, n=4, valid=None):
    return [(t, x, y, 0, 0, 0, valid is None or t in valid) for t in range(n)]


def test_statuses(spark):
    move = [(t, t * 1.0, 0, 10, 0, 0, True) for t in range(4)]
    tracks = {0: move, 1: still(1e4, 0), 2: [(t, t, 3, 10, 0, 0, t == 1) for t in range(4)],
              3: still(5, 5), 4: still(6, 6), 5: [(t, t, 9, -10, 0, 180, True) for t in range(4)],
              6: still(7, 7), 7: still(8, 8), 8: [(t, 0, 0, 1, 0, 0, False) for t in range(4)]}
    kinds = {0: 5, 1: 1, 2: 1, 3: 2, 4: 3, 5: 1, 6: 4, 7: 4, 8: 1}
    pts, s = points(spark, tracks, kinds), scenarios(spark, n=4)
    got = by(P.pair_features(pts, s, scope="all", far_pairs=True), "i", "j")
    assert len(got) == 36
    want = {(0, 1): PairStatus.TOO_FAR, (0, 2): PairStatus.MASK_NOT_VALID, (3, 4): PairStatus.STATIONARY,
            (0, 5): PairStatus.PARTIAL_HEADING, (0, 3): PairStatus.OK, (6, 7): PairStatus.TOO_FAR,
            (0, 8): PairStatus.TOO_FAR}
    for k, v in want.items():
        assert got[k].status == v, k
    listed = spark.createDataFrame([(1, 0, 8)], "scenario_id long, i long, j long")
    assert P.features_for_pairs(pts, s, listed).collect()[0].status == PairStatus.MASK_NOT_VALID
    no_vehicle = by(P.pair_features(pts, s, scope="all", include_vehicle_free=False, far_pairs=True), "i", "j")
    assert no_vehicle[(3, 4)].status == PairStatus.OUT_OF_SCOPE and no_vehicle[(6, 7)].status == PairStatus.OUT_OF_SCOPE
    assert no_vehicle[(0, 1)].status == PairStatus.TOO_FAR


def test_grid_loses_no_pair_in_range(spark):
    rng = np.random.default_rng(1)
    tracks = {a: [(t, x + t, y, 1, 0, 0, True) for t in range(3)] for a, (x, y) in enumerate(rng.uniform(-300, 300, (30, 2)))}
    pts, s = points(spark, tracks), scenarios(spark, n=3)
    near = {(r.i, r.j) for r in P.nearby_pairs(P.pack_tracks(pts), s).collect()}
    for i in tracks:
        for j in tracks:
            if i < j and min(math.dist(p[1:3], q[1:3]) for p, q in zip(tracks[i], tracks[j])) <= 100:
                assert (i, j) in near


def test_crossing_touching_disjoint(spark):
    cases = {
        (0, 1): ([(0, 0), (2, 2), (4, 0)], [(0, 2), (2, 0), (4, 2)]),
        (2, 3): ([(0, 0), (1, 0), (2, 0)], [(1, 0), (2, 0), (3, 0)]),
        (4, 5): ([(0, 0), (1, 0), (2, 0)], [(0, 2), (1, 2), (2, 2)]),
    }
    tracks = {}
    for (i, j), (a, b) in cases.items():
        for k, p in ((i, a), (j, b)):
            tracks[k] = [(t, *xy, 10, 0, 0, True) for t, xy in enumerate(p)]
    got = by(P.pair_features(points(spark, tracks), scenarios(spark, n=3), scope="all"), "i", "j")
    assert got[(0, 1)].intersection == 3 and got[(2, 3)].intersection == 3 and got[(4, 5)].intersection == 0


def test_head_on_conflict_time(spark):
    a = [(t, t, 0, 2, 0, 0, True) for t in range(7)]
    b = [(t, 6 - t, 0.25, 1.5, 0, 0, True) for t in range(7)]
    s = scenarios(spark, n=7, agent_to_conflict_point_max_distance=0.5)
    r = P.pair_features(points(spark, {0: a, 1: b}), s, scope="ego").collect()[0]
    assert r.mttcp == pytest.approx(brute(a, b, radius=0.5)["mttcp"])


def test_distances(spark):
    xy = {0: [(0, 0), (1, 0), (2, 0)], 1: [(3, 0), (3, 1), (3, 2)], 2: [(10, 0), (10, 1), (10, 2)]}
    tracks = {a: [(t, *p, 1, 0, 0, True) for t, p in enumerate(v)] for a, v in xy.items()}
    pts, s = points(spark, tracks), scenarios(spark, ego=1, n=3)
    full = by(P.closest_agent_distances(pts, s, to="all", targets=agents(spark, {0: 1, 1: 1, 2: 1})), "agent_idx", "target_idx")
    ego = by(P.closest_agent_distances(pts, s), "agent_idx")
    for a in xy:
        for b in xy:
            want = min(math.dist(p, q) for p, q in zip(xy[a], xy[b]))
            assert full[(a, b)].distance == pytest.approx(want)
        assert ego[(a,)].distance == pytest.approx(full[(a, 1)].distance)


def test_padded_steps_sit_at_the_origin(spark):
    tracks = {0: [(0, 50, 0, 1, 0, 0, True)], 1: [(0, 90, 0, 1, 0, 0, True)]}
    pts, s = points(spark, tracks), scenarios(spark, n=3)
    dense = by(P.closest_agent_distances(pts, s), "agent_idx")
    valid = by(P.closest_agent_distances(pts, s, valid_only=True), "agent_idx")
    assert dense[(1,)].distance == 0 and valid[(1,)].distance == 40


def test_pair_totals_count_what_enumeration_lists(spark):
    a = agents(spark, {0: 5, 1: 1, 2: 1, 3: 2, 4: 3, 5: 4, 6: 2})
    from lanewise.functions.expr import pair_type
    listed = P.all_pairs(a).groupBy(pair_type(F.col("type_i"), F.col("type_j")).alias("pair_type")).count()
    assert {r.pair_type: r.pairs for r in P.pair_totals(a).collect()} == {r.pair_type: r["count"] for r in listed.collect()}
    assert max(r.pair_type for r in listed.collect()) == PairType.OTHER


def test_bad_scope_and_missing_ego(spark):
    a = agents(spark, {0: 1, 1: 1})
    with pytest.raises(ValueError):
        P.enumerate_pairs(a, scope="some")
    assert P.missing_ego(a, scenarios(spark, ego=7)).count() == 1
    assert P.missing_ego(a, scenarios(spark, ego=1)).count() == 0


def test_repeated_steps_count_once(spark):
    from lanewise.operators import pairs as P
    n = 6
    p = points(spark, {0: [(t, t, 0, 10, 0, 0, True) for t in range(n)], 1: [(t, t, 1, 10, 0, 0, True) for t in range(n)]}, {0: 5, 1: 1})
    s = scenarios(spark, n=n)
    twice = p.union(p.filter("agent_idx = 1 AND t = 2"))
    once, again = (P.pair_features(x, s).collect()[0] for x in (p, twice))
    assert once.separation == again.separation == 1.0 and once.n_shared == again.n_shared


def test_ego_pairs_are_dealt_by_pair(spark):
    from lanewise.operators import pairs as P
    p, s = points(spark, {0: [(0, 0, 0, 1, 0, 0, True)], 1: [(0, 1, 0, 1, 0, 0, True)]}, {0: 5, 1: 1}), scenarios(spark, n=1)
    plan = P.pair_features(p, s)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(scenario_id" in plan and any("i#" in x and "j#" in x for x in plan.split("\n") if "hashpartitioning(" in x)


def test_packed_tracks_are_not_broadcast(spark, tmp_path):
    """Tracks of equal steps shuffle as few bytes, so Spark would send all of them through the driver."""
    points(spark, {a: [(t, 5.0 * a, t, 0, 1, 90, True) for t in range(4)] for a in range(3)}).write.parquet(f"{tmp_path}/points")
    tracks = P.pack_tracks(spark.read.parquet(f"{tmp_path}/points"))
    ego, near = P.ego_pair_tracks(tracks, scenarios(spark)), P.nearby_pairs(tracks)
    assert (ego.count(), near.count()) == (2, 3)
    for df in (ego, near):
        df.collect()
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
