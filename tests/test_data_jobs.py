import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.functions.distributed import balanced_row_number, exact_percentiles, quantile_cuts
from lanewise.operators import maps as M
from lanewise.operators import profiling as A
from lanewise.plans import jobs
from lanewise.schema import PRESETS, AgentType
from lanewise.session import is_complete
from lanewise.sources import ingest as N
from lanewise.sources import storage as K
from lanewise.streaming import incremental as R
from tests.helpers import agents, by, points, scenarios
from tests.test_individual import random_tracks


def test_hot_keys_are_cut_and_still_numbered_right(spark):
    rng = np.random.default_rng(0)
    rows = [(0, int(v), i) for i, v in enumerate(rng.integers(0, 200, 400))] + [(k, k, 1000 + k) for k in range(1, 9)]
    df = spark.createDataFrame(rows, "k long, v long, id long")
    got = balanced_row_number(df, ["k"], "v", ["id"], cuts=12)
    assert got.columns == ["k", "v", "id", "rn"]
    seen = {r.id: r.rn for r in got.collect()}
    hot = sorted((v, i) for k, v, i in rows if k == 0)
    assert [seen[i] for _, i in hot] == list(range(1, 401)) and all(seen[1000 + k] == 1 for k in range(1, 9))


def test_slices_follow_the_rows_not_the_range(spark):
    """One outlier, ties and a second large key: every slice stays near its share of the rows."""
    rng = np.random.default_rng(1)
    rows = [(0, int(v), i) for i, v in enumerate(rng.exponential(1000, 6000))] + [(0, 10**15, 6000), (0, None, 6001)]
    rows += [(1, 7, 10_000 + i) for i in range(3000)] + [(k, k, 20_000 + k) for k in range(2, 1000)]
    df = spark.createDataFrame(rows, "k long, v long, id long")
    cuts = quantile_cuts(df, ["k"], ["v", "id"], 20, per_cut=100)
    bounds = {r.k: [(-1 if o.v is None else o.v, o.id) for o in r._cuts] for r in cuts.collect()}
    for k, own in bounds.items():
        at = np.searchsorted([v * 10**6 + i for v, i in own], [(-1 if v is None else v) * 10**6 + i for kk, v, i in rows if kk == k], "right")
        assert np.bincount(at).max() <= 1200
    assert len(bounds[0]) > 8 and len(bounds[1]) > 3
    seen = {r.id: r.rn for r in balanced_row_number(df, ["k"], "v", ["id"]).collect()}
    for k in (0, 1):
        order = sorted((-1 if v is None else v, i) for kk, v, i in rows if kk == k)
        assert [seen[i] for _, i in order] == list(range(1, len(order) + 1))
    assert all(seen[20_000 + k] == 1 for k in range(2, 1000))


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(2)
    groups = {1: rng.normal(0, 50, 301), 2: np.repeat([3.0, 3.0, 7.0], 40), 3: np.array([5.0]),
              4: np.concatenate([rng.exponential(1e4, 99), [-0.0, 0.0, 1e300]])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [(1, math.nan)], "k long, v double")
    ps = [0.0, 12.5, 25.0, 50.0, 90.0, 100.0]
    got = by(exact_percentiles(df, ["k"], "v", ps), "k", "p")
    assert len(got) == len(groups) * len(ps)
    for k, vs in groups.items():
        for p in ps:
            assert got[(k, p)].percentile == pytest.approx(np.percentile(vs, p), rel=1e-12, abs=1e-12)


def test_category_thresholds_skip_duplicates(spark):
    vals = [0.0] * 80 + [float(v) for v in range(1, 21)]
    df = spark.createDataFrame([("a", v) for v in vals], "k string, value double")
    got = {r.ord: r.value for r in A.category_thresholds(df, ["k"]).collect()}
    scan = [round(float(np.percentile(vals, p)), 2) for p in np.arange(75.5, 83.0, 0.5)]
    assert got[0] == 0.0 and got[1] == next(v for v in scan if v > 0.0)
    assert got[2] == round(float(np.percentile(vals, 90)), 2)
    nan = df.unionByName(spark.createDataFrame([("a", math.nan)], df.schema))
    assert all(math.isnan(r.value) for r in A.category_thresholds(nan, ["k"]).collect())


@pytest.mark.parametrize("chunk_gaps,super_chunks", [(64, 512), (2, 3), (1, 2)])
def test_thinning_equals_the_walk(spark, chunk_gaps, super_chunks):
    rng = np.random.default_rng(4)
    rows, want = [], set()
    for log, span in ((0, 400), (1, 4000), (2, 60)):
        ts = sorted(int(t) * 250_000 for t in rng.integers(0, span, 200))
        frames = [(log, log * 1000 + i, t) for i, t in enumerate(ts)]
        rows += frames
        last = None
        for _, f, t in frames:
            if last is None or t - last >= 3_000_000:
                want.add(f)
                last = t
    df = spark.createDataFrame(rows, "log_id long, frame_id long, ts_us long")
    got = {r.frame_id for r in N.thin_frames(df, 3.0, chunk_gaps=chunk_gaps, super_chunks=super_chunks).collect()}
    assert got == want


def test_overlap_audit_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    tracks, rows = {}, []
    for sid in range(24):
        base = 0 if sid % 5 else sid * 7
        xs = [base + sid % 3 * 4 + t for t in range(9)] if sid % 4 else list(rng.integers(0, 40, 9))
        tracks[sid] = {(float(x), 0.0) for x in xs}
        rows += [(sid, x) for x in xs]
    for sid in (24, 25):  # exact copies of nobody else
        tracks[sid] = {(1000.0 + t, 0.0) for t in range(6)}
        rows += [(sid, 1000 + t) for t in range(6)]
    df = None
    for sid in tracks:
        mine = [(t, x, 0, 1, 0, 0, True) for t, x in enumerate(x for s, x in rows if s == sid)]
        part = points(spark, {0: mine}, scenario=sid)
        df = part if df is None else df.unionByName(part)
    df = df.coalesce(2)
    got = {r.scenario_id: r.overlaps for r in N.overlapping_scenarios(df, scenarios(spark, ids=tuple(tracks))).collect()}
    for a, pa in tracks.items():
        assert got[a] == any(len(pa & pb) >= 5 for b, pb in tracks.items() if b != a), a


def test_resample_and_velocity(spark):
    keys = points(spark, {0: [(t, 10.0 * t, t * t, 0, 0, 0, t != 3) for t in range(6)]}, hz=2.0)
    got = by(N.recompute_velocity(N.resample(keys, hz=10.0, steps=60), dt=0.1), "t")
    assert {k[0] for k in got} == set(range(0, 10)) | set(range(20, 26))
    assert got[(7,)].x == pytest.approx(14.0) and got[(7,)].y == pytest.approx(1 + 0.4 * 3)
    assert got[(7,)].vx == pytest.approx(20.0) and got[(9,)].vx == pytest.approx(20.0)


def test_padding_densify_and_ids(spark):
    p = points(spark, {0: [(0, 1, 1, 1, 0, 0, True), (1, 2, 1, 1, 0, 0, True)], 1: [(1, 9, 9, 1, 0, 0, True)]})
    pad = by(N.pad_tracks(p, 4), "agent_idx", "t")
    assert len(pad) == 7 and pad[(0, 3)].ts_s == pytest.approx(0.3) and not pad[(0, 3)].valid and pad[(0, 3)].x == 0
    grid = by(N.densify(p, scenarios(spark, n=3)), "agent_idx", "t")
    assert len(grid) == 6 and grid[(1, 0)].x == 0 and not grid[(1, 0)].valid
    obs = spark.createDataFrame([("s", "b", 0, False), ("s", "a", 2, False), ("s", "e", 5, True), ("s", "c", 2, False)],
                                "scene string, track string, t int, ego boolean")
    ids = {r.track: r.agent_idx for r in N.dense_ids(obs, scene="scene", track="track", t="t", is_ego=F.col("ego")).collect()}
    assert ids == {"e": 0, "b": 1, "a": 2, "c": 3}


def test_violations_and_schema(spark):
    p = points(spark, {0: [(0, 0, 0, 0, 0, 0, True), (1, 0, 0, 0, 0, 0, True)], 1: [(0, 0, 0, 0, 0, 0, True)]}, {1: 42})
    bad = p.unionByName(p.filter("agent_idx = 0 AND t = 0")).withColumn("t", F.when(F.col("agent_idx") == 1, -1).otherwise(F.col("t")))
    assert {r.rule: r.rows for r in N.violations(bad).collect()} == {
        "negative_key": 1, "unknown_type": 1, "duplicate_key": 1, "unequal_length": 1}
    assert N.schema_violations(p, "track_points") == []
    assert N.schema_violations(p.drop("x").withColumn("t", F.col("t").cast("long")), "track_points") == [
        "t: bigint is not int", "x: missing"]


def test_sampling_is_repeatable(spark):
    ids = spark.range(50).withColumnRenamed("id", "scenario_id")
    one = {r[0] for r in N.sample_scenarios(ids, 7, 3).collect()}
    assert one == {r[0] for r in N.sample_scenarios(ids.repartition(5), 7, 3).collect()} and len(one) == 7
    assert one != {r[0] for r in N.sample_scenarios(ids, 7, 4).collect()}
    assert N.sample_scenarios(ids, None).count() == N.sample_scenarios(ids, -1).count() == N.sample_scenarios(ids, 99).count() == 50


def test_upsert_and_threshold_files(spark, tmp_path):
    old = spark.createDataFrame([(1, 1.0, None), (2, None, 5.0)], "scenario_id long, a double, b double")
    new = spark.createDataFrame([(1, 9.0, 8.0), (3, 3.0, None)], "scenario_id long, a double, b double")
    def rows(mode):
        return {r.scenario_id: (r.a, r.b) for r in K.upsert(old, new, ["scenario_id"], mode).collect()}

    assert rows("add") == {1: (1.0, 8.0), 2: (None, 5.0), 3: (3.0, None)}
    assert rows("update") == {1: (9.0, 8.0), 2: (None, 5.0), 3: (3.0, None)}
    assert set(rows("overwrite")) == {1, 3}
    with pytest.raises(ValueError):
        K.upsert(old, new, ["scenario_id"], "replace")
    f = tmp_path / "v.json"
    f.write_text(json.dumps({"speed": {"LOW/MEDIUM": 1.5, "MEDIUM/HIGH": 0.5}}))
    got = K.load_thresholds(spark, {"VEHICLE": str(f)})
    assert [(r.ord, r.value) for r in got.orderBy("ord").collect()] == [(0, 1.5), (1, 0.5)]
    assert json.loads(K.thresholds_json(got).collect()[0].json) == {"speed": {"LOW/MEDIUM": 1.5, "MEDIUM/HIGH": 0.5}}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        K.load_thresholds(spark, {"VEHICLE": str(tmp_path / "none.json")})


def test_counts_by_type(spark):
    s = scenarios(spark)
    a = agents(spark, {0: 5, 1: 1, 2: 2, 3: 3})
    status = {(0, 1): 0, (0, 2): 1, (0, 3): 3, (1, 2): 2, (1, 3): 0, (2, 3): 0}
    kinds = {0: 5, 1: 1, 2: 2, 3: 3}
    pairs = spark.createDataFrame([(1, i, j, kinds[i], kinds[j], st) for (i, j), st in status.items()],
                                  "scenario_id long, i long, j long, type_i int, type_j int, status int")
    ind = a.filter("agent_idx <> 2")
    r = A.scenario_counts(s, a, ind, pairs).collect()[0].asDict()
    got = {k: v for k, v in r.items() if k not in ("scenario_id", "dataset") and v}
    assert got == {
        "agents_total_EGO_AGENT": 1, "agents_total_VEHICLE": 1, "agents_total_PEDESTRIAN": 1, "agents_total_CYCLIST": 1,
        "agents_valid_EGO_AGENT": 1, "agents_valid_VEHICLE": 1, "agents_valid_CYCLIST": 1,
        "pairs_total_VEHICLE_VEHICLE": 1, "pairs_total_VEHICLE_PEDESTRIAN": 2, "pairs_total_VEHICLE_CYCLIST": 2,
        "pairs_total_PEDESTRIAN_CYCLIST": 1, "pairs_valid_VEHICLE_VEHICLE": 1, "pairs_valid_VEHICLE_PEDESTRIAN": 1,
        "pairs_valid_VEHICLE_CYCLIST": 1, "pairs_valid_PEDESTRIAN_CYCLIST": 1, "pairs_with_ego_total": 3,
        "pairs_with_ego_valid": 2}
    half = A.scenario_counts(s, a, ind).collect()[0].asDict()
    assert half["agents_total_VEHICLE"] == 1 and all(v == 0 for k, v in half.items() if k.startswith("pairs_"))
    assert len(A.count_columns()) == 2 + 2 * len(AgentType) + 16


def test_resampled_outline_passes_through_its_points(spark):
    pts = [(0, 0), (4, 0), (4, 3), (1, 5), (-1, 2)]
    df = spark.createDataFrame([(1, "crosswalk", 0, k, float(x), float(y), 0.0, 18) for k, (x, y) in enumerate(pts)],
                               "scenario_id long, feature_class string, feature_idx long, point_idx long, x double, y double, z double, polyline_type int")
    got = [(r.x, r.y) for r in M.static_conflict_points(df, resample_factor=3).collect()]
    assert len(got) == 15
    spec = np.fft.fft(np.array([x + 1j * y for x, y in pts]))
    wide = np.zeros(15, complex)
    wide[:3], wide[-2:] = spec[:3], spec[-2:]
    want = np.fft.ifft(wide) * 3
    for w in want:
        assert any(math.dist(g, (w.real, w.imag)) < 1e-9 for g in got)


def test_streams(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    schema = "scenario_id long, v double"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = R.process_new_scenarios(spark.readStream.schema(schema).parquet(src),
                                    lambda df: df.groupBy("scenario_id").agg(F.sum("v").alias("v")), out, ck)
        q.awaitTermination(120)

    arrive([(1, 1.0), (1, 2.0)])
    arrive([(2, 5.0), (1, 100.0)])
    assert {r.scenario_id: r.v for r in spark.read.parquet(out).collect()} == {1: 3.0, 2: 5.0}

    fsrc = str(tmp_path / "frames")
    fschema = "log_id long, frame_id long, ts_us long"
    outp, fck = str(tmp_path / "kept"), str(tmp_path / "fck")
    for batch in ([(0, 1, 0), (0, 2, 1_000_000), (0, 3, 3_000_000)], [(0, 4, 4_000_000), (0, 5, 6_500_000), (1, 9, 0)]):
        spark.createDataFrame(batch, fschema).coalesce(1).write.mode("append").parquet(fsrc)
        q = (R.thin_frames_stream(spark.readStream.schema(fschema).parquet(fsrc), 3.0).writeStream.format("parquet")
             .option("path", outp).option("checkpointLocation", fck).trigger(availableNow=True).start())
        q.awaitTermination(120)
    assert {r.frame_id for r in spark.read.parquet(outp).collect()} == {1, 3, 5, 9}


def drained(spark, df, path):
    """Run a stream over what has arrived so far, adding to what came out of it before."""
    q = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.read.parquet(f"{path}/out")


def test_shuffled_frames_are_thinned_as_in_order(spark, tmp_path):
    rng = np.random.default_rng(3)
    schema, src = "log_id long, frame_id long, ts_us long", str(tmp_path / "in")
    frames = [(log, 1000 * log + i, int(t) * 250_000) for log in range(3) for i, t in enumerate(np.sort(rng.integers(0, 400, 150)))]
    want = {r.frame_id for r in N.thin_frames(spark.createDataFrame(frames, schema), 3.0).collect()}
    # Arrival: by time with up to five seconds of jitter, in four files; a last frame of each log releases the held ones.
    jitter = dict(zip([f[1] for f in frames], rng.uniform(0, 5e6, len(frames))))
    arrival = sorted(frames, key=lambda f: f[2] + jitter[f[1]])
    files = [arrival[i * 113:(i + 1) * 113] for i in range(3)] + [arrival[339:] + [(log, -1 - log, 10**9) for log in range(3)]]
    for part in files:
        rng.shuffle(part)
        spark.createDataFrame([tuple(map(int, f)) for f in part], schema).coalesce(1).write.mode("append").parquet(src)
        got = drained(spark, R.thin_frames_stream(spark.readStream.schema(schema).parquet(src), 3.0, delay_s=5.0), str(tmp_path))
    assert {r.frame_id for r in got.filter("status = 'kept'").collect()} == want
    assert got.filter("status = 'late'").count() == 0
    spark.createDataFrame([(1, 77, 1_000_000), (1, 78, 2 * 10**9)], schema).coalesce(1).write.mode("append").parquet(src)
    got = drained(spark, R.thin_frames_stream(spark.readStream.schema(schema).parquet(src), 3.0, delay_s=5.0), str(tmp_path))
    assert [r.frame_id for r in got.filter("status = 'late'").collect()] == [77]


def test_scenarios_in_parts_are_assembled(spark, tmp_path):
    """One scenario in three batches and a late fourth, one whole at once, and one that expires with what it has."""
    schema, src = "scenario_id long, v double, n_rows int", str(tmp_path / "in")
    out, late, ck = (str(tmp_path / n) for n in ("out", "late", "ck"))

    def arrive(rows, ck=ck, **options):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        return R.process_assembled_scenarios(
            spark.readStream.schema(schema).parquet(src), lambda df: df.groupBy("scenario_id").agg(F.sum("v").alias("v"), F.count("*").alias("n")),
            out, late, ck, expected="n_rows", **options)

    def stored():
        return {r.scenario_id: (r.v, r.n) for r in spark.read.parquet(out).collect()}

    for rows, want in (([(1, 1.0, 4), (2, 5.0, 1)], {2: (5.0, 1)}), ([(1, 2.0, 4), (1, None, 4), (3, 7.0, 2)], {2: (5.0, 1)}),
                       ([(1, 4.0, 4)], {1: (7.0, 4), 2: (5.0, 1)}), ([(1, 100.0, 4), (4, 1.0, 1)], {1: (7.0, 4), 2: (5.0, 1), 4: (1.0, 1)})):
        assert arrive(rows).awaitTermination(100)
        assert stored() == want
    assert [(r.scenario_id, r.v) for r in spark.read.parquet(late).collect()] == [(1, 100.0)]
    with pytest.raises(ValueError):
        arrive([(5, 1.0, 2)], idle_s=1.0)
    running = arrive([(5, 2.0, 3)], ck=str(tmp_path / "other"), once=False, idle_s=0.1)
    try:
        until = time.time() + 60
        while time.time() < until and 5 not in stored():
            time.sleep(0.5)
    finally:
        running.stop()
    assert stored()[3] == (7.0, 1) and stored()[5] == (3.0, 2)


def test_profile_resumes(spark, tmp_path):
    tracks = random_tracks(4, 14, seed=9)
    t = jobs.Tables(points(spark, tracks, {0: 5, 1: 1, 2: 2, 3: 3}), scenarios(spark, now=5, n=14),
                    agents(spark, {0: 5, 1: 1, 2: 2, 3: 3}))
    prof = jobs.Profile(spark, str(tmp_path / "p"), t)
    first = {(r.agent_idx, r.scorer): r.score for r in prof.score_categories().collect()}
    assert len(first) == 12 and {v for (_, s), v in first.items() if s != "combined"} <= {0.0, 1.0, 2.0, 3.0, 4.0}
    assert all(first[a, "combined"] == first[a, "individual"] + first[a, "interaction"] for a in range(4))
    assert {r.scorer: r.scene_score for r in prof.scene_categories().collect()}.keys() == {"individual", "interaction", "combined"}
    other = jobs.Profile(spark, str(tmp_path / "p"), t, criterion="average")
    assert other.root != prof.root
    broken = jobs.Profile(spark, str(tmp_path / "p"), jobs.Tables(None, None, None))
    assert {(r.agent_idx, r.scorer): r.score for r in broken.score_categories().collect()} == first


def test_plans_stay_distributed(spark):
    p, s = points(spark, random_tracks(3, 8)), scenarios(spark, now=3, n=8)
    from lanewise.operators import individual as I
    from lanewise.operators import pairs as P
    for df in (I.individual_features(p, s), P.pair_features(p, s), P.pair_features(p, s, scope="all")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval", "SinglePartition"):
            assert word not in plan, word
    assert PRESETS["pipeline_default"].weighting == "ego_distance"


def test_thinning_without_a_gap_keeps_every_frame(spark):
    from lanewise.sources import ingest
    frames = spark.createDataFrame([(0, 1, 0), (0, 2, 0), (0, 3, 5)], "log_id long, frame_id long, ts_us long")
    assert {r.frame_id for r in ingest.thin_frames(frames, 0.0).collect()} == {1, 2, 3}
    dense = spark.createDataFrame([(0, i, i * 100_000) for i in range(3000)], "log_id long, frame_id long, ts_us long")
    assert sorted(r.ts_us for r in ingest.thin_frames(dense, 30.0).collect()) == list(range(0, 300_000_000, 30_000_000))


def test_a_write_that_breaks_a_rule_raises_without_another_job(spark, tmp_path):
    rows = points(spark, {0: [(t, t, 0, 1, 0, 0, True) for t in range(5)], 1: [(t, t, 1, 1, 0, 0, True) for t in range(5)]}, {0: 5})
    short = points(spark, {0: [(t, t, 0, 1, 0, 0, True) for t in range(3)]}, {0: 5}, scenario=2)
    rules = {**N.row_rules(), **N.horizon_rule(5)}
    good = K.write_checked(rows, str(tmp_path / "good"), rules)
    assert good.count() == 10 and is_complete(spark, str(tmp_path / "good"))
    with pytest.raises(ValueError, match="'too_short': 1"):
        K.write_checked(rows.unionByName(short), str(tmp_path / "short"), rules)
    assert not is_complete(spark, str(tmp_path / "short"))
    bad = rows.withColumn("agent_idx", F.when(F.col("t") == 2, -1).otherwise(F.col("agent_idx"))).withColumn("agent_type", F.when(F.col("t") == 3, 77).otherwise(F.col("agent_type")))
    with pytest.raises(ValueError, match="'negative_key': 2, 'unknown_type': 2"):
        K.write_checked(bad, str(tmp_path / "bad"), rules)
    tracker, group = spark.sparkContext.statusTracker(), "checked-write"
    spark.sparkContext.setJobGroup(group, group)
    rows.cache().count()
    before = len(tracker.getJobIdsForGroup(group))
    rows.write.parquet(str(tmp_path / "plain"))
    plain = len(tracker.getJobIdsForGroup(group)) - before
    K.write_checked(rows, str(tmp_path / "counted"), rules)
    assert len(tracker.getJobIdsForGroup(group)) - before - plain == plain
    rows.unpersist()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_merging_a_scene_that_is_not_stored_raises(spark):
    old = spark.createDataFrame([(1, 1.0)], "scenario_id long, a double")
    new = spark.createDataFrame([(1, 2.0), (9, 3.0)], "scenario_id long, a double")
    assert K.upsert(old, new.filter("scenario_id = 1"), ["scenario_id"], "update", same_scenes=True).collect()[0].a == 2.0
    with pytest.raises(Exception, match="not stored: 9"):
        K.upsert(old, new, ["scenario_id"], "add", same_scenes=True).collect()
