import math

import numpy as np
import pytest

from lanewise.operators import individual as I
from lanewise.schema import TrackShape
from tests.helpers import by, points, scenarios


def random_tracks(n_agents=4, n=30, seed=3):
    rng = np.random.default_rng(seed)
    out = {}
    for a in range(n_agents):
        pos = np.cumsum(rng.normal(1.0, 0.4, (n, 2)), axis=0)
        vel = rng.normal(2.5, 1.5, (n, 2))
        head = rng.uniform(-60, 60, n)
        ok = rng.random(n) > 0.25
        out[a] = [(t, *pos[t], *vel[t], head[t], ok[t]) for t in range(n)]
    return out


def smoothed(v):
    p = np.concatenate([[v[0]] * 2, v, [v[-1]] * 2])
    return np.array([p[i:i + 5].mean() for i in range(len(v))])


def slope(f, x):
    return np.gradient(f, x)


def forecast_error(rows, now):
    hist = [(r[1], r[2]) for r in rows if r[6] and r[0] <= now]
    fut = [(r[0], r[1], r[2]) for r in rows if r[6] and r[0] > now]
    if len(hist) < 2 or not fut:
        return -1.0
    hist = np.array(hist)
    v = (hist[-1] - hist[0]) / (len(hist) - 1)
    x, p, w = hist[0].copy(), 1.0, 1.0
    for o in hist[1:]:
        p, w = p + w + 1e-5, w + 1e-5
        x = x + v
        g = p / (p + 1e-4)
        x, p, w = x + g * (o - x), p * (1 - g), w * (1 - w / (w + 1e-4))
    ahead = fut[-1][0] - now
    return float(np.hypot(*(x + v * ahead - np.array(fut[-1][1:])))) * ahead / 100


@pytest.mark.parametrize("criterion", ["critical", "average"])
def test_against_numpy(spark, criterion):
    tracks = random_tracks()
    got = by(I.agent_summary(points(spark, tracks), scenarios(spark, now=12, n=30), criterion=criterion), "agent_idx")
    pick = np.max if criterion == "critical" else np.mean
    for a, rows in tracks.items():
        ok = [r for r in rows if r[6]]
        ts = np.array([r[0] / 10 for r in ok])
        speed = smoothed(np.hypot([r[3] for r in ok], [r[4] for r in ok]))
        acc = slope(speed, ts)
        r = got[(a,)]
        assert r.speed == pytest.approx(pick(speed))
        assert r.acceleration == pytest.approx(pick(acc[acc >= 0]))
        assert r.deceleration == pytest.approx(pick(-acc[acc < 0]))
        assert r.jerk == pytest.approx(pick(np.abs(slope(acc, ts))))
        assert r.kalman_difficulty == pytest.approx(forecast_error(rows, 12))
        assert math.isnan(r.speed_limit_diff)


def test_edges(spark):
    line = [(t, t, 0, 10, 0, 0, True) for t in range(6)]
    one = [(0, 0, 0, 1, 0, 0, True), (1, 0, 0, 1, 0, 0, False)]
    nan = [(t, t, 0, math.nan if t == 2 else 1.0, 0, 0, True) for t in range(6)]
    late = [(t, t, 0, 5, 0, 0, t > 3) for t in range(6)]
    got = by(I.agent_summary(points(spark, {0: line, 1: one, 2: nan, 3: late}), scenarios(spark, now=3, n=6)), "agent_idx")
    assert set(got) == {(0,), (3,)}
    assert got[(0,)].acceleration == pytest.approx(0, abs=1e-9) and got[(0,)].deceleration == pytest.approx(0, abs=1e-9)
    assert got[(3,)].kalman_difficulty == -1.0


def test_rounding_of_a_constant_speed_is_no_deceleration(spark):
    """The means of the constant speed differ by roundings of either sign; only the steps that brake count."""
    speed = [7.1] * 8 + [6.0] * 4
    track = [(t, t, 0, v, 0, 0, True) for t, v in enumerate(speed)]
    r = I.agent_summary(points(spark, {0: track}), scenarios(spark, now=3, n=12), criterion="average").collect()[0]
    acc = slope(smoothed(np.array(speed)), np.arange(12) / 10)
    assert r.deceleration == pytest.approx(-acc[acc < -1e-9].mean())
    assert r.acceleration == pytest.approx(0, abs=1e-9)


def test_repeated_timestamp_has_no_jerk(spark):
    p = points(spark, {0: [(t, t, 0, 5 + t % 2, 0, 0, True) for t in range(6)]})
    p = p.withColumn("ts_s", p.ts_s - p.t % 2 * 0.1)
    # Steps 0,1 and 2,3 share a timestamp: the slope there is undefined or infinite.
    rows = I.agent_summary(p, scenarios(spark, now=2, n=6)).collect()
    assert not rows or rows[0].jerk is None


def shape_of(spark, rows):
    return I.agent_summary(points(spark, {0: rows}), scenarios(spark, now=1, n=len(rows))).collect()[0].trajectory_type


@pytest.mark.parametrize("end,turn,speed,want", [
    ((1, 0), 0, 0.5, TrackShape.STATIONARY),
    ((40, 1), 5, 8, TrackShape.STRAIGHT),
    ((40, -9), 5, 8, TrackShape.STRAIGHT_RIGHT),
    ((40, 9), 5, 8, TrackShape.STRAIGHT_LEFT),
    ((20, -20), -80, 8, TrackShape.RIGHT_TURN),
    ((-20, -20), -170, 8, TrackShape.RIGHT_U_TURN),
    ((20, 20), 80, 8, TrackShape.LEFT_TURN),
    ((-20, 20), 170, 8, TrackShape.LEFT_U_TURN),
    ((20, 20), -80, 8, TrackShape.LEFT_TURN),
])
def test_shapes(spark, end, turn, speed, want):
    rows = [(t, end[0] * t / 5, end[1] * t / 5, speed, 0, turn * t / 5, True) for t in range(6)]
    assert shape_of(spark, rows) == int(want)


def test_waiting(spark):
    # Moving, standing 4 steps, moving, standing until the end. Windows of 5 blur the edges, so use long phases.
    speed = [10] * 10 + [0] * 10 + [10] * 10 + [0] * 10
    x = np.cumsum([s / 10 for s in speed])
    rows = [(t, x[t], 0, speed[t], 0, 0, True) for t in range(40)]
    cps = spark.createDataFrame([(1, 20.0, 3.0, 0.0), (1, 500.0, 0.0, 0.0)], "scenario_id long, x double, y double, z double")
    s = smoothed(np.array(speed, float))
    want = []
    t = 0
    while t < 40:
        if s[t] <= 2:
            e = t
            while e + 1 < 40 and s[e + 1] <= 2:
                e += 1
            dur = (min(e + 1, 39) - t) / 10
            want.append(dur / (math.hypot(x[t] - 20, 3) + 1e-6))
            t = e
        t += 1
    base = I.agent_summary(points(spark, {0: rows}), scenarios(spark, now=5, n=40))
    for c, f in (("critical", max), ("average", lambda v: sum(v) / len(v))):
        got = I.waiting_period(base, cps, criterion=c).collect()[0].waiting_period
        assert got == pytest.approx(f(want))
    assert I.individual_features(points(spark, {0: rows}), scenarios(spark, now=5, n=40)).collect()[0].waiting_period == 0


def test_categories(spark):
    th = spark.createDataFrame(
        [("VEHICLE", "speed", i, str(i), v) for i, v in enumerate((1.0, 5.0, 9.0))],
        "type string, feature string, ord int, label string, value double")
    rows = [(1, a, k, s, math.nan, 0.0, 0.0, None, 0.0, 1, -1.0) for a, k, s in
            ((0, 5, 1.0), (1, 1, 5.1), (2, 1, 99.0), (3, 4, 3.0), (4, 2, 3.0))]
    df = spark.createDataFrame(rows, "scenario_id long, agent_idx long, agent_type int, speed double, speed_limit_diff double,"
                               "acceleration double, deceleration double, jerk double, waiting_period double,"
                               "trajectory_type int, kalman_difficulty double")
    got = by(I.categorize_individual(df, th), "agent_idx")
    assert [got[(a,)].speed for a in range(4)] == [1.0, 3.0, 4.0, -1.0]
    assert math.isnan(got[(4,)].speed) and math.isnan(got[(0,)].acceleration)
    assert got[(0,)].jerk == 0.0 and got[(0,)].kalman_difficulty == 0.0 and math.isnan(got[(0,)].speed_limit_diff)


def test_per_scenario_limit_overrides_default(spark):
    rows = [(t, t * 0.1, 0, 3, 0, 0, True) for t in range(6)]
    p = points(spark, {0: rows})
    assert I.agent_summary(p, scenarios(spark, now=1, n=6)).collect()[0].trajectory_type == int(TrackShape.STRAIGHT)
    s = scenarios(spark, now=1, n=6, max_stationary_speed=4.0)
    assert I.agent_summary(p, s).collect()[0].trajectory_type == int(TrackShape.STATIONARY)


def test_unknown_criterion(spark):
    with pytest.raises(ValueError):
        I.agent_summary(points(spark, {0: [(0, 0, 0, 0, 0, 0, True)]}), scenarios(spark), criterion="median")
