"""Ring joins against every query compared with every target."""

import io
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.functions import nearest
from lanewise.functions.nearest import nearest_distance
from lanewise.operators import individual as I
from lanewise.operators import maps as M
from tests.helpers import by, points

QUERY, TARGET = "scenario_id long, agent_idx long, t int, x double, y double, z double", "scenario_id long, x double, y double, z double"


def plan(df):
    with redirect_stdout(out := io.StringIO()):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("pairs", [1 << 21, 50])
def test_nearest_distance(spark, monkeypatch, pairs):
    monkeypatch.setattr(nearest, "PAIRS", pairs)
    rng = np.random.default_rng(1)
    spread = {1: 30.0, 2: 3000.0, 3: 10.0, 4: 1.0}
    q = [(s, a, t, *map(float, rng.normal(0, spread[s], 3))) for s in spread for a in range(6) for t in range(5)] + [
        (1, 9, 0, float("nan"), 0.0, 0.0), (1, 9, 1, 1e6, -1e6, 0.0), (2, 9, 0, 25.0, 50.0, 0.0)]
    t = [(s, *map(float, rng.normal(0, w, 3))) for s, w in spread.items() if s != 4 for _ in range(15)] + [
        (1, None, 0.0, 0.0), (2, float("nan"), 0.0, 0.0), (7, 0.0, 0.0, 0.0)]
    got = by(nearest_distance(spark.createDataFrame(q, QUERY), spark.createDataFrame(t, TARGET)), "scenario_id", "agent_idx", "t")
    want = {}
    for s, a, i, *p in q:
        d = [np.sqrt(sum((u - v) ** 2 for u, v in zip(p, r))) for k, *r in t if k == s and None not in r and not np.isnan(r).any()]
        if d:
            want[s, a, i] = min(d)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k]["distance"] == pytest.approx(v, rel=1e-12, nan_ok=True)
    within = nearest_distance(spark.createDataFrame(q, QUERY), spark.createDataFrame(t, TARGET), within=20.0)
    assert set(by(within.filter("distance <= 20"), "scenario_id", "agent_idx", "t")) == {k for k, v in want.items() if v <= 20}


def plain_lanes(steps, lanes, k, threshold):
    """{(agent, t): [(lane, distance, place)]} by every step against every lane, segment by segment."""
    def dist(p, q):
        return np.sqrt(((p - q) ** 2).sum(-1))

    near = {(a, t, n): dist(p, pts).min() for (a, t), p in steps.items() for n, pts in lanes.items()}
    out = {}
    for (a, t), p in steps.items():
        rows = []
        for n, pts in lanes.items():
            d = dist(p, pts)
            i = int(d.argmin())
            best = (d[i], float(i))
            if len(pts) > 1 and min(v for (b, _, m), v in near.items() if (b, m) == (a, n)) <= threshold:
                s = 0 if i == 0 else i - 1 if i == len(pts) - 1 or d[i - 1] < d[i + 1] else i
                seg = pts[s + 1] - pts[s]
                u = ((p - pts[s]) @ seg) / (seg @ seg) if seg @ seg >= 1e-6 else -1
                if 0 <= u <= 1 and (r := dist(p, pts[s] + u * seg)) < d[i]:
                    best = (r, s + u)
            rows.append((n, *best))
        out[a, t] = sorted(rows, key=lambda r: (r[1], r[0]))[:k]
    return out


@pytest.mark.parametrize("k,threshold,step", [(3, 10.0, 4.0), (16, 5.0, 2.0), (1, 40.0, 30.0)])
def test_closest_lanes(spark, k, threshold, step):
    rng = np.random.default_rng(7)
    lanes, rows = {}, []
    for n in range(12):
        angle, start = rng.uniform(0, 6), rng.uniform(-150, 150, 2)
        pts = np.stack([start + i * step * np.array([np.cos(angle + i / 30), np.sin(angle + i / 30)]) for i in range(20 if n else 1)])
        lanes[n] = np.column_stack([pts, np.zeros(len(pts))])
        rows += [(1, "lane", n, 2 * i, float(x), float(y), 0.0, 2) for i, (x, y) in enumerate(pts)]
        rows += [(1, "lane", n, 2 * i + 1, 0.0, 0.0, 0.0, 2) for i in range(len(pts))]
    df = spark.createDataFrame(rows, "scenario_id long, feature_class string, feature_idx long, point_idx long, x double, y double, z double, polyline_type int")
    tracks = {a: [(t, *(rng.uniform(-160, 160, 2) if a < 3 else (900.0 + t, -900.0)), 1, 0, 0, a != 2 or t > 3) for t in range(6)] for a in range(4)}
    steps = {(a, t): np.array([x, y, 0.0]) for a, own in tracks.items() for t, x, y, *_, ok in own if ok}
    got = {}
    near = M.closest_lanes(points(spark, tracks), df, k=k, threshold=threshold, subsample=2)
    for r in near.orderBy("agent_idx", "t", "rank").collect():
        got.setdefault((r["agent_idx"], r["t"]), []).append((r["lane_idx"], r["distance"], r["point_idx"]))
    want = plain_lanes(steps, lanes, k, threshold)
    assert set(got) == set(want)
    for key, own in want.items():
        assert [n for n, *_ in got[key]] == [n for n, *_ in own]
        assert np.allclose([r[1:] for r in got[key]], [r[1:] for r in own], rtol=1e-9, atol=1e-9)


def test_few_lanes_of_a_large_map_are_rows(spark):
    """A map of 400 lanes along a road: what the rings hand on is a small share of steps x lanes."""
    rows = [(1, "lane", n, i, 30.0 * n + 3.0 * i, 0.0, 0.0, 2) for n in range(400) for i in range(10)]
    df = spark.createDataFrame(rows, "scenario_id long, feature_class string, feature_idx long, point_idx long, x double, y double, z double, polyline_type int")
    tracks = {a: [(t, 600.0 * a + 8.0 * t, 1.0, 80, 0, 0, True) for t in range(20)] for a in range(18)}
    lanes = M._lane_targets(df, 1, 3)
    width = nearest.cell_width(lanes, F.first("lanes"), 4)
    near = nearest.ring_join(M._steps(points(spark, tracks)), lanes, width, M._lane_kernel(4, 10.0), M._LANE_COLUMNS)
    n = near.count()
    assert 18 * 20 * 4 <= n <= 18 * 20 * 12
    assert M.closest_lanes(points(spark, tracks), df, k=4).groupBy("agent_idx", "t").count().filter("count = 4").count() == 360


def test_no_plan_joins_steps_with_points_by_scene_alone(spark):
    pts = points(spark, {0: [(0, 0, 0, 1, 0, 0, True), (1, 1, 0, 1, 0, 0, True)]})
    conflicts = spark.createDataFrame([(1, 5.0, 0.0, 0.0)], TARGET)
    assert "Join" not in plan(M.nearest_conflict(pts, conflicts))


def test_no_side_that_grows_with_the_scenes_is_broadcast(spark, tmp_path):
    """Maps compress to next to nothing, so Spark's estimate from a file lets tables of any number of rows through the driver."""
    def kept(name, df):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    maps = kept("maps", spark.range(3).selectExpr(
        "1L AS scenario_id", "'lane' AS feature_class", "id AS feature_idx", "0L AS point_idx", "id * 0.1D AS x", "0D AS y", "0D AS z"))
    lanes = kept("lanes", spark.sql("SELECT 1L AS scenario_id, 0L AS lane_idx, 30D AS speed_limit_mph"))
    near = kept("near", spark.sql("SELECT 1L AS scenario_id, 0L AS agent_idx, 0 AS t, 0L AS lane_idx"))
    profile = kept("profile", spark.sql("SELECT 1L AS scenario_id, 0L AS agent_idx, 0 AS t, 5D AS speed"))
    found = M.lane_intersections(maps, threshold=0.15)
    assert found.count() == 4
    for df in (found, I.speed_limit_gap(profile, near, lanes)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_signals_are_not_broadcast(spark, tmp_path):
    spark.range(3).selectExpr("1L AS scenario_id", "CAST(id AS INT) AS t", "0D AS x", "0D AS y", "0D AS z").write.parquet(f"{tmp_path}/signals")
    first = M.dynamic_conflict_points(spark.read.parquet(f"{tmp_path}/signals"))
    assert first.count() == 1
    first.collect()
    assert "BroadcastHashJoin" not in first._jdf.queryExecution().executedPlan().toString()
