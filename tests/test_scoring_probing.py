import math

import pytest
from pyspark.sql import functions as F

from lanewise.operators import individual as I
from lanewise.operators import pairs as P
from lanewise.operators import probing as C
from lanewise.operators import scoring as S
from lanewise.schema import PRESETS, Caps, ScoreConfig, Weights
from tests.helpers import agents, by, points, scenarios

IND = ("scenario_id long, agent_idx long, agent_type int, n_valid long, speed double, speed_limit_diff double,"
       "acceleration double, deceleration double, jerk double, waiting_period double, trajectory_type int,"
       "kalman_difficulty double")


def test_individual_score_rules(spark):
    cfg = PRESETS["pipeline_default"].with_(weighting="uniform", clip=(0.0, 40.0))
    rows = [(1, 0, 1, 9, 30.0, math.nan, 1.0, 2.0, 10.0, 0.5, 1, -1.0), (1, 1, 1, 9, 3.0, 2.0, 0.0, 0.0, None, 9.0, 7, 4.0)]
    f = spark.createDataFrame(rows, IND)
    a = agents(spark, {0: 1, 1: 1, 2: 1})
    w = S.agent_weights(a, scenarios(spark), cfg)
    got = by(S.individual_scores(f, w, cfg), "agent_idx")
    assert got[(0,)].score == pytest.approx(18 + 0 + 1 + 2 + 1.0 + 0.5 + 0.5 + 0)
    assert got[(1,)].score == pytest.approx(3 + 2 + 0 + 0 + 6.0 + 5 + 0.8 + 4)  # a missing jerk counts as the cap
    assert got[(2,)].score == 0 and not got[(2,)].valid
    scene = S.scene_scores(S.individual_scores(f, w, cfg), cfg).collect()[0].scene_score
    assert scene == pytest.approx((got[(0,)].score + got[(1,)].score) / 2)


def interaction(spark):
    rows = [(1, 0, 1, 1, 1, 0, 1.0, 1.0, 0.4, 0.3, 2.0), (1, 1, 2, 1, 1, 0, 0.0, 0.2, 0.1, 0.05, 0.5), (1, 0, 2, 1, 1, 3, 0.0, 9.0, 9.0, 9.0, 9.0)]
    return spark.createDataFrame(rows, "scenario_id long, i long, j long, type_i int, type_j int, status int,"
                                 "collision double, inv_mttcp double, inv_thw double, inv_ttc double, drac double")


def test_ego_weighting_and_pair_scores(spark):
    xy = {0: [(0, 0), (1, 0), (2, 0)], 1: [(3, 0), (3, 1), (3, 2)], 2: [(10, 0), (10, 1), (10, 2)]}
    pts = points(spark, {a: [(t, *p, 1, 0, 0, True) for t, p in enumerate(v)] for a, v in xy.items()})
    s, a = scenarios(spark, ego=1, n=3), agents(spark, {0: 1, 1: 1, 2: 1})
    cfg = ScoreConfig(weighting="ego_distance")
    w = S.agent_weights(a, s, cfg, points=pts)
    got = {k[0]: r.weight for k, r in by(w, "agent_idx").items()}
    d0 = min(math.dist(p, q) for p, q in zip(xy[0], xy[1]))
    assert got[1] == 1.0 and got[0] == pytest.approx(1 / (d0 + 1e-6)) and got[2] == pytest.approx(1 / (7 + 1e-6))
    cap = 1 / (4 + 1e-6)
    p01 = 1 + min(cap, 1.0) + min(1 / (2 + 1e-6), 0.4) + min(1 / (2 + 1e-6), 0.3) + 2.0
    p12 = 0 + 0.2 + 0.1 + 0.05 + 0.5
    scores = by(S.interaction_scores(interaction(spark), w, cfg, s), "agent_idx")
    assert scores[(0,)].score == pytest.approx(got[0] * p01)
    assert scores[(1,)].score == pytest.approx(p01 + p12)
    assert scores[(2,)].score == pytest.approx(got[2] * p12)
    total = sum(r.score for r in scores.values())
    scene = S.scene_scores(S.interaction_scores(interaction(spark), w, cfg, s), cfg).collect()[0].scene_score
    assert scene == pytest.approx(total / 3)
    cached = S.scene_score_from_pairs(S.pair_scores(interaction(spark), cfg), w, cfg).collect()[0].scene_score
    assert cached == pytest.approx(scene)


def test_vru_root_distance_and_relevance(spark):
    pts = points(spark, {0: [(0, 0, 0, 1, 0, 0, True)], 1: [(0, 16, 0, 1, 0, 0, True)], 2: [(0, 4, 0, 1, 0, 0, True)]})
    s = scenarios(spark, n=1)
    a = agents(spark, {0: 5, 1: 2, 2: 1}, relevance={0: 0.0, 1: 0.0, 2: 0.9})
    cfg = PRESETS["pipeline_default"]
    w = {k[0]: r.weight for k, r in by(S.agent_weights(a, s, cfg, points=pts), "agent_idx").items()}
    assert w[0] == 1 and w[1] == pytest.approx(2 / 4, rel=1e-5) and w[2] == pytest.approx(0.5, rel=1e-5)
    rel = cfg.with_(weighting="relevant_distance")
    w = {k[0]: r.weight for k, r in by(S.agent_weights(a, s, rel, points=pts), "agent_idx").items()}
    assert w[0] == 1 and w[1] == pytest.approx(0.9 * 2 / math.sqrt(12), rel=1e-5) and w[2] == pytest.approx(0.9 * 2)
    none = agents(spark, {0: 5, 1: 2, 2: 1}, relevance={0: 0.0, 1: 0.0, 2: 0.0})
    assert {r.weight for r in S.agent_weights(none, s, rel, points=pts).collect()} == {1.0}
    alone = agents(spark, {0: 5}, relevance={0: 0.25})
    assert S.agent_weights(alone, s, cfg, points=pts).collect()[0].weight == 0.25


def test_categorized_interaction_scores_cover_unscored_agents(spark):
    a = agents(spark, {0: 1, 1: 1, 2: 1, 3: 1})
    cfg = ScoreConfig()
    w = S.agent_weights(a, scenarios(spark), cfg)
    got = by(S.interaction_scores(interaction(spark), w, cfg, scenarios(spark), thresholds=[1.0, 3.0]), "agent_idx")
    assert got[(3,)].score == 1.0 and not got[(3,)].valid and got[(0,)].score == 3.0


def test_presets_and_from_dict():
    assert Caps.from_dict({"speed": 3, "nonsense": 1}).speed == 3 and Weights.from_dict(None) == Weights()
    assert PRESETS["probe_collision"].weights.ttc == 0 and PRESETS["combined_categorical"].clip == (0.0, 16.0)


def test_constant_velocity(spark):
    rows = [(0, 0, 0, 1, 2, 5, True), (1, 1, 1, 3, 4, 9, True), (2, 7, 7, 9, 9, 9, False), (3, 8, 8, 9, 9, 9, True)]
    parked = [(t, 5, 5, 0, 0, 0, True) for t in range(4)]
    unseen = [(t, 5, 5, 1, 0, 0, t == 3) for t in range(4)]
    got = by(C.constant_velocity(points(spark, {0: rows, 1: parked, 2: unseen}), scenarios(spark, now=2, n=5)), "agent_idx", "t")
    assert {k[0] for k in got} == {0} and {k[1] for k in got} == {0, 1, 2, 3, 4}
    r = got[(0, 4)]
    assert (r.x, r.y) == (pytest.approx(1 + 0.3 * 3), pytest.approx(1 + 0.3 * 4)) and r.valid and r.length == 0.0
    assert math.degrees(got[(0, 3)].heading) == pytest.approx(9) and got[(0, 3)].length == 1.0
    assert not got[(0, 2)].valid and got[(0, 1)].x == 1


def test_probe_finds_the_braking_follower(spark):
    """The ego brakes behind a parked car; at constant velocity it would have hit it."""
    n = 30
    ego, x, v = [], 0.0, 10.0
    for t in range(n):
        ego.append((t, x, 0, v, 0, 0, True))
        v = max(v - (1.2 if t > 8 else 0), 0.0)
        x += v / 10
    car = [(t, 20, 0, 0, 0, 0, True) for t in range(n)]
    far = [(t, 20, 60, 5, 0, 0, True) for t in range(n)]
    pts = points(spark, {0: ego, 1: car, 2: far}, {0: 5, 1: 1, 2: 1}, length=4.0)
    s, a = scenarios(spark, now=8, n=n), agents(spark, {0: 5, 1: 1, 2: 1})
    found = C.find_probes(pts, a, s, PRESETS["probe"], min_delta=1.0)
    got = found.collect()
    assert len(got) == 1
    r = got[0]
    assert r.probed_agent == 0 and r.is_ego and r.score_after > r.score_before
    assert [x.other for x in r.affected] == [1] and r.affected[0].metric == "TTC" and r.affected[0].t >= 8
    text = C.probe_summary(found, s, a).collect()[0]
    assert text.probe_found == "yes" and (text.probed_agent_id, text.affected_agent_ids) == ("100", "101")
    assert float(text.score_delta) == pytest.approx(r.score_after - r.score_before, abs=1e-6)
    none = C.find_probes(pts, a, s, PRESETS["probe"], min_delta=1e6)
    assert none.count() == 0 and C.probe_summary(none, s, a).collect()[0].probe_type == "N/A"


def test_later_agent_wins_ties(spark):
    c = spark.createDataFrame([(1, 3, 2.0), (1, 5, 2.0), (1, 4, 1.0)], "scenario_id long, probed long, delta double")
    assert C.max_delta(c).collect()[0].probed == 5


def test_rounding_decides_no_probe(spark):
    c = spark.createDataFrame([(1, 3, 5.0 + 2e-15), (1, 5, 5.0), (1, 4, 1.0)], "scenario_id long, probed long, delta double")
    assert C.max_delta(c).collect()[0].probed == 5
    d = spark.createDataFrame([(1, 3, 0.1 + 0.2 + 0.7 - 2e-16), (1, 4, 0.999)], "scenario_id long, probed long, delta double")
    assert [r.probed for r in C.candidates(d, 1.0).collect()] == [3]


def test_affected_needs_a_critical_frame(spark):
    pts = points(spark, {0: [(t, 0, 0, 1, 0, 0, True) for t in range(3)], 1: [(t, 500, 0, 1, 0, 0, True) for t in range(3)]})
    df = P.pack_tracks(pts)
    a = df.filter("agent_idx = 0").selectExpr("scenario_id", "steps as probe_steps", "0 as current_time_index")
    row = a.join(df.filter("agent_idx = 1").selectExpr("scenario_id", "steps as other_steps"), "scenario_id")
    lim = {k: F.lit(v) for k, v in dict(heading_threshold=45.0, agent_max_deceleration=20.0, agent_to_agent_max_distance=100.0).items()}
    assert C.critical_frames(row, lim).collect()[0].crit is None


def test_scenes_without_a_half_keep_their_rows(spark):
    """A lone agent has no interaction half; two agents without usable tracks have a score of 0 in both."""
    from lanewise.operators import pairs as P
    from lanewise.operators import profiling as A
    from lanewise.plans import jobs

    def scene(i, tracks):
        return points(spark, tracks, {0: 5, 1: 1}, scenario=i), scenarios(spark, n=12, now=4, ids=(i,)), agents(spark, {a: 5 - 4 * a for a in tracks}, scenario=i)

    drive = [(t, t, 0, 10, 0, 0, True) for t in range(12)]
    parts = [scene(1, {0: drive}), scene(2, {0: drive, 1: [(t, t + 5, 1, 10, 0, 0, True) for t in range(12)]}), scene(3, {0: drive[:1], 1: drive[:1]})]
    p, s, a = (x[0].union(x[1]).union(x[2]) for x in zip(*parts, strict=True))
    t = jobs.Tables(p, s, a)
    cfg = PRESETS["pipeline_default"]
    agent, scene_rows = jobs.scores(t, jobs.individual(t), P.pair_features(p, s), cfg)
    got = {(r.scenario_id, r.agent_idx, r.scorer): r for r in agent.collect()}
    alone = got[1, 0, "combined"]
    assert alone.valid is None and alone.score == got[1, 0, "individual"].score > 0 and got[1, 0, "interaction"].score is None
    assert got[2, 0, "combined"].valid and got[3, 1, "individual"].valid is False and got[3, 0, "combined"].score == 0
    scores = scene_rows.withColumnRenamed("scorer", "key")
    kept = {r.scenario_id for r in A.complete_only(scores, ("individual", "interaction", "combined")).collect()}
    assert kept == {2, 3} and scores.count() == 9
    some = jobs.scores(t, jobs.individual(t), P.pair_features(p, s), cfg, featured=s.filter("scenario_id = 3"))[1]
    assert {r.scenario_id for r in some.collect()} == {3}


def test_no_row_per_scene_or_agent_is_broadcast(spark, tmp_path):
    """Scores, weights and distances are a few bytes per agent, so Spark would send those of all scenes through the driver."""
    from lanewise.operators import profiling as A

    def kept(name, df):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    pts = kept("points", points(spark, {a: [(t, 5.0 * a, t, 0, 1, 90, True) for t in range(4)] for a in range(3)}))
    scenes = kept("scenes", scenarios(spark, n=4))
    own = kept("agents", agents(spark, {0: 5, 1: 1, 2: 2}))
    pairs = kept("pairs", P.pair_features(pts, scenes))
    ind = kept("individual", I.individual_features(pts, scenes))
    cfg = PRESETS["pipeline_default"]
    scores = kept("scores", S.agent_scores(S.agent_weights(own, scenes, cfg, points=pts), ind, pairs, cfg, scenes))
    whole = kept("whole", S.all_scene_scores(scores, cfg).withColumnRenamed("scorer", "key"))
    combined = whole.filter("key = 'combined'")
    found = {
        "agent scores": (S.agent_scores(S.agent_weights(own, scenes, cfg, points=pts), ind, pairs, cfg, scenes), 9),
        "motion": (I.agent_summary(pts, scenes), 3), "complete": (A.complete_only(whole, ("individual", "interaction", "combined")), 3),
        "thresholds": (A.exact_percentiles(scores, ["scorer"], "score", [50.0, 90.0]), 6), "totals": (P.pair_totals(own), 2),
        "counts": (A.scenario_counts(scenes, own, ind, pairs), 1), "normalized": (A.normalized_scores(scores.filter("scorer = 'combined'"), scenes), 3),
        "datasets": (A.per_dataset(combined, scenes), 2),
        "folders": (A.percentile_folders(combined, scenes), 1)}
    for name, (df, rows) in found.items():
        assert len(df.collect()) == rows, name
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString(), name
