"""Every registered query: one per operator, over the whole of the tables derived from the provided data.

Canonical tables are written once per application to the shared folder, as an ingest job would, and so are the feature,
score and probe tables that score and profile jobs read. Queries about those steps themselves compute them directly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.functions import expr as X
from lanewise.operators import individual as I
from lanewise.operators import maps as M
from lanewise.operators import pairs as P
from lanewise.operators import probing as C
from lanewise.operators import profiling as A
from lanewise.operators import scoring as S
from lanewise.plans import jobs
from lanewise.schema import (
    INDIVIDUAL_FEATURES, MPH_TO_MS, PAIR_FEATURES, PRESETS, PairType,
)
from lanewise.session import materialize, shared_dir, stage_path, stored
from lanewise.sources import derived as D
from lanewise.sources import ingest as N
from lanewise.sources import storage as K

KEY = ["scenario_id", "agent_idx"]
PAIR = ["scenario_id", "i", "j"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SCORERS = ("individual", "interaction", "combined")
PIPE, PROBE = PRESETS["pipeline_default"], PRESETS["probe"]
UNIFORM = PIPE.with_(weighting="uniform")
RELEVANT = PIPE.with_(weighting="relevant_distance")


def query(name: str):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: plain(fn(Data(spark, sf_dir)))
        return fn
    return add


def tidy(c: str, digits: int = 6):
    """Comparable doubles: rounded, NaN as null, infinity as 1e9, no negative zero."""
    r = F.round(F.col(c), digits)
    return F.when(F.isnan(c), None).when(F.abs(c) == X.INF, 1e9 * F.signum(c)).when(r == 0, 0.0).otherwise(r).alias(c)


COARSE = {"mttcp", "thw", "ttc", "value", "waiting_period", "density", "inv_separation",
          "delta_mean", "delta_median", "low", "q1", "median", "q3", "high"}


def plain(df: DataFrame) -> DataFrame:
    """Round every double column; booleans and strings stay as they are."""
    return df.select(*[
        tidy(f.name, 4 if f.name in COARSE else 6) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields])


class Data:
    """Tables of one scale factor; each is built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf = spark, sf_dir
        tag = "".join(ch if ch.isalnum() else "_" for ch in sf_dir)
        self.root = stage_path(spark, f"stage{tag}")

    def keep(self, name: str, build) -> DataFrame:
        return stored(self.spark, f"{self.root}/{name}", build)

    def raw(self, name: str) -> DataFrame:
        return D.table(self.spark, self.sf, name)

    @property
    def frames(self):
        return self.keep("frames", lambda: D.frames(self.spark, self.sf))

    @property
    def points(self):
        return self.keep("track_points", lambda: D.track_points(self.spark, self.sf))

    @property
    def scenarios(self):
        return self.keep("scenarios", lambda: D.scenarios(self.points))

    @property
    def agents(self):
        return self.keep("agents", lambda: N.relevance(D.agents(self.points), "difficulty"))

    @property
    def map_points(self):
        return self.keep("map_points", lambda: D.map_points(self.scenarios))

    @property
    def lanes(self):
        return self.keep("lanes", lambda: D.lanes(self.scenarios))

    @property
    def signals(self):
        return self.keep("signals", lambda: D.signals(self.scenarios))

    @property
    def tables(self):
        return jobs.Tables(self.points, self.scenarios, self.agents, self.map_points, self.lanes, self.signals)

    @property
    def conflicts(self):
        return M.conflict_points(self.map_points, self.signals, threshold=0.5)

    @property
    def individual(self):
        return self.keep("individual", lambda: jobs.individual(
            self.tables, threshold=0.5, k_lanes=3, stage=materialize))

    @property
    def pairs(self):
        return self.keep("pairs_ego", lambda: P.pair_features(self.points, self.scenarios))

    @property
    def pairs_all(self):
        return self.keep("pairs_all", lambda: P.pair_features(self.points, self.scenarios, scope="all"))

    @property
    def thresholds(self):
        return self.keep("thresholds", lambda: A.category_thresholds(
            A.individual_long(self.individual).unionByName(A.pair_long(self.pairs)), ["type", "feature"]))

    @property
    def weights(self):
        return self.keep("weights", lambda: S.agent_weights(self.agents, self.scenarios, PIPE, points=self.points))

    @property
    def agent_scores(self):
        return self.keep("agent_scores", lambda: jobs.scores(self.tables, self.individual, self.pairs, PIPE)[0])

    @property
    def scene_scores(self):
        return self.keep("scene_scores", lambda: S.all_scene_scores(self.agent_scores, PIPE)) \
            .withColumnRenamed("scorer", "key")

    @property
    def complete_scores(self):
        return A.complete_only(self.scene_scores, SCORERS)

    @property
    def altered(self):
        return self.keep("altered", lambda: C.constant_velocity(self.points, self.scenarios))

    @property
    def probes(self):
        return self.keep("probes", lambda: C.find_probes(
            self.points, self.agents, self.scenarios, PROBE, stage=materialize))

    @property
    def summary(self):
        return self.keep("summary", lambda: C.probe_summary(self.probes, self.scenarios, self.agents))

    @property
    def counts(self):
        return self.keep("counts", lambda: A.scenario_counts(
            self.scenarios, self.agents, self.individual, self.pairs))


# --- sources and ingest -------------------------------------------------------------------------------------------

@query("S01_scan_track_points")
def _(d):
    return D.track_points(d.spark, d.sf).drop("ego_idx")


@query("S02_sample_scenarios")
def _(d):
    return N.sample_scenarios(d.scenarios, 12, seed=7)


@query("S03_truncate_horizon")
def _(d):
    gt = N.truncate_horizon(d.points, 30).select(F.lit("gt").alias("horizon"), *KEY, "t")
    ho = N.truncate_horizon(d.points, 11).select(F.lit("ho").alias("horizon"), *KEY, "t")
    return gt.unionByName(ho).groupBy("horizon", *KEY).agg(F.count(F.lit(1)).alias("steps"))


@query("S03_too_short")
def _(d):
    return N.too_short(d.points, 40)


@query("S04_pad_tracks")
def _(d):
    return N.pad_tracks(d.points, 45).select(*KEY, "t", "ts_s", "x", "y", "vx", "valid")


def _category():
    return F.when(F.col("event_type") == "click", "vehicle.car").when(
        F.col("event_type") == "view", "human.pedestrian.adult").when(
        F.col("event_type") == "purchase", "vehicle.bicycle").when(
        F.col("event_type") == "signup", "bus").otherwise("movable.barrier")


@query("S05_category_to_agent_type")
def _(d):
    return d.raw("events").select("event_id", N.agent_type_of(_category()).alias("agent_type"))


@query("S06_default_box")
def _(d):
    kind = F.when(F.col("event_type") == "click", "vehicle").when(F.col("event_type") == "view", "pedestrian").when(
        F.col("event_type") == "purchase", "cyclist").when(F.col("event_type") == "signup", "bus").otherwise("other")
    return d.raw("events").select("event_id", N.default_box(kind).alias("b")).select("event_id", "b.*")


@query("S07_resample")
def _(d):
    keys = d.points.withColumn("ts_s", F.col("t").cast("double") * 0.5 + (F.col("ts_s") - F.col("t") * 0.1))
    return N.resample(keys, hz=10.0, steps=200).select(*KEY, "t", "x", "y", "heading", "length")


@query("S08_stride")
def _(d):
    return N.stride(d.points, N.stride_for(0.05)).select(*KEY, "t", "x", "y", "valid")


@query("S09_velocity")
def _(d):
    return N.recompute_velocity(d.points, dt=0.1).select(*KEY, "t", "vx", "vy")


@query("S10_densify")
def _(d):
    seen = I.valid_points(d.points)
    return N.densify(seen, d.scenarios).select(*KEY, "t", "agent_type", "x", "y", "length", "valid")


@query("S11_dense_ids")
def _(d):
    obs = d.points.select("scenario_id", "agent_id", "t", (F.col("agent_idx") == F.col("ego_idx")).alias("ego"), "valid")
    obs = obs.filter("valid OR ego")
    return N.dense_ids(obs, scene="scenario_id", track="agent_id", t="t", is_ego=F.col("ego"))


@query("S12_mark_ego")
def _(d):
    plain_type = d.agents.withColumn("agent_type", F.when(F.col("agent_type") == 5, 1).otherwise(F.col("agent_type")))
    return N.mark_ego(plain_type, d.scenarios).select(*KEY, "agent_type")


@query("S13_relevance")
def _(d):
    base = D.agents(d.points)
    out = None
    for rule in ("difficulty", "all", "targets"):
        part = N.relevance(base, rule).select(*KEY, F.lit(rule).alias("rule"), "relevance")
        out = part if out is None else out.unionByName(part)
    return out


@query("S14_select_targets")
def _(d):
    cat = F.when(F.col("agent_type") == 4, "UNSCORED_TRACK").when(F.col("agent_type") == 2, "TRACK_FRAGMENT").when(
        F.col("agent_type") == 5, "FOCAL_TRACK").otherwise("SCORED_TRACK")
    return N.select_targets(d.agents.select(*KEY, cat.alias("category"))).select(*KEY, "difficulty")


@query("S15_targets_by_scene")
def _(d):
    pred = d.raw("events").filter("event_type = 'purchase'").select(
        F.col("event_id").alias("sample"), F.col("user_id").alias("instance"))
    samples = d.raw("events").select(F.col("event_id").alias("sample"), (F.col("user_id") % 10).alias("scene"))
    return N.targets_by_scene(pred, samples)


@query("S16_frequency")
def _(d):
    return N.frequency(d.points).join(N.duration(d.points), "scenario_id")


@query("S17_first_keyframes")
def _(d):
    f = d.frames.select(F.col("user_id").alias("scene"), F.col("event_id").alias("frame_id"), "ts_us")
    return N.scene_seconds(N.first_keyframes(f, scene="scene", n=13, tie="frame_id"), scene="scene").select(
        "scene", "frame_id", "keyframe", "ts_s")


def _log_frames(d):
    return d.frames.select((F.col("user_id") % 4).alias("log_id"), F.col("user_id").alias("scene"),
                           F.col("event_id").alias("frame_id"), "ts_us")


@query("S18_candidate_frames")
def _(d):
    tags = d.frames.filter("event_type <> 'error'").select(F.col("event_id").alias("frame_id"))
    return N.candidate_frames(_log_frames(d), tags)


@query("S19_thin_frames")
def _(d):
    return N.thin_frames(_log_frames(d), 1800.0)


@query("S20_crop_to_ego")
def _(d):
    out = None
    for shape in ("box", "circle"):
        part = N_crop(d, shape)
        out = part if out is None else out.unionByName(part)
    return out


def N_crop(d, shape):
    return M.crop_to_ego(d.points, d.scenarios, d.map_points, margin=20.0, shape=shape).groupBy(
        "scenario_id", "feature_class").agg(F.count(F.lit(1)).alias("points")).withColumn("shape", F.lit(shape))


@query("S21_feature_ranges")
def _(d):
    return M.feature_ranges(d.map_points)


@query("S22_polyline_directions")
def _(d):
    return M.polyline_directions(d.map_points).select(
        "scenario_id", "feature_class", "feature_idx", "point_idx", "dx", "dy", "dz")


@query("S23_yaw_and_direction")
def _(d):
    half = F.col("heading") / 2
    yaw = X.yaw_from_quaternion(F.cos(half), F.lit(0.0), F.lit(0.0), F.sin(half))
    return M.heading_directions(d.points).select(*KEY, "t", yaw.alias("yaw"), "dir_x", "dir_y")


@query("S24_lane_boundaries")
def _(d):
    f = F.col("feature_idx")
    mark = F.when(f == 0, "solid_white").when(f == 1, "double_dash_yellow").when(f == 2, "none").when(
        f == 3, "dash_solid_white").otherwise("unknown")
    lanes = d.map_points.filter("feature_class = 'lane'").withColumn("mark", mark)
    return N.lane_boundaries(lanes).select("scenario_id", "feature_idx", "point_idx", "polyline_type")


@query("S24_close_crosswalk")
def _(d):
    e = d.map_points.filter("feature_class = 'crosswalk'").select(
        "scenario_id", "feature_idx", (F.col("point_idx") % 2 + 1).alias("edge"),
        F.expr("point_idx div 2").alias("point_idx"), "x", "y", "z")
    return N.close_crosswalk(e).select("scenario_id", "feature_idx", "point_idx", "x", "y")


@query("S25_speed_limit_mph")
def _(d):
    gap = D.lanes(d.scenarios, with_gap=True)
    return gap.select("scenario_id", "lane_idx", N.speed_limit_mph(F.col("speed_limit_mph") * MPH_TO_MS).alias("mph"))


@query("S26_violations")
def _(d):
    return N.violations(d.points)


@query("S27_upsert")
def _(d):
    # Agents without usable motion lack a row on one side, agents of lone scenes a value on the other.
    old = d.individual.select(*KEY, "speed", "jerk")
    new = d.agent_scores.filter("scorer = 'interaction'").select(*KEY, F.col("score").alias("speed"))
    out = None
    for mode in ("add", "update", "overwrite"):
        got = K.upsert(old, new, KEY, mode)
        got = got if "jerk" in got.columns else got.withColumn("jerk", F.lit(None).cast("double"))
        part = got.select(F.lit(mode).alias("mode"), *KEY, "speed", "jerk")
        out = part if out is None else out.unionByName(part)
    return out


@query("S28_pending")
def _(d):
    return K.pending(d.scenarios, d.pairs)


@query("S29_common_ids")
def _(d):
    return N.common_ids([d.individual, d.pairs, d.summary.withColumn("scenario_id", F.col("scenario_id").cast("long"))])


@query("S30_thresholds_file")
def _(d):
    files = {}
    docs = K.thresholds_json(d.thresholds)
    root = f"{shared_dir(d.spark)}/lanewise/{d.spark.sparkContext.applicationId}/threshold_files"
    docs.select("type", F.col("json").alias("value")).write.mode("overwrite").partitionBy("type").text(root)
    for kind in ("VEHICLE", "CYCLIST", "PEDESTRIAN"):
        files[kind] = f"{root}/type={kind}"
    return K.load_thresholds(d.spark, files)


@query("S32_score_mapping")
def _(d):
    return K.score_mapping(d.scene_scores, SCORERS)


@query("S33_signal_steps")
def _(d):
    return M.signal_steps(d.signals).select("scenario_id", "t", "lane_id", "step")


@query("S34_overlapping_scenarios")
def _(d):
    return N.overlapping_scenarios(d.points, d.scenarios)


@query("S36_filter_ids")
def _(d):
    return N.filter_ids(d.individual, d.scenarios.filter("dataset = 'beta'")).select(*KEY, "speed")


@query("S37_read_branches")
def _(d):
    root = f"{d.root}/branches"
    ind = d.individual.select(*KEY, "speed")
    K.write_branch(ind, root, scenario_type="gt", criterion="critical", mode="overwrite")
    K.write_branch(ind.withColumn("speed", F.col("speed") / 2), root, scenario_type="ho", criterion="critical")
    got = K.read_branches(d.spark, root, scenario_types=["ho"], ids=d.scenarios.filter("dataset = 'alpha'"))
    return got.select(*KEY, "speed")


@query("S38_entity_counts")
def _(d):
    return M.entity_counts(d.agents, d.map_points, d.conflicts, d.signals)


# --- per-agent features -------------------------------------------------------------------------------------------

@query("F04_smoothed_speed")
def _(d):
    return I.usable(I.motion_profile(d.points)).select(*KEY, "t", "raw_speed", "speed")


@query("F07_acceleration_and_jerk")
def _(d):
    return I.usable(I.motion_profile(d.points)).select(*KEY, "t", "accel", "jerk")


@query("F06_speed_limit_gap")
def _(d):
    near = M.closest_lanes(d.points, d.map_points, k=3)
    prof = I.usable(I.motion_profile(d.points))
    return I.speed_limit_gap(prof, near, d.lanes).select(*KEY, "t", "limit_gap")


@query("F08_acceleration_split")
def _(d):
    out = None
    for c in ("critical", "average"):
        part = I.agent_summary(d.points, d.scenarios, criterion=c).select(
            F.lit(c).alias("criterion"), *KEY, "n_valid", "speed", "acceleration", "deceleration", "jerk")
        out = part if out is None else out.unionByName(part)
    return out


@query("F10_waiting_period")
def _(d):
    base = materialize(I.agent_summary(d.points, d.scenarios).select(*KEY, "waits"), "waits-summary")
    conflicts = materialize(d.conflicts, "conflicts")
    out = None
    for c in ("critical", "average"):
        part = I.waiting_period(base, conflicts, criterion=c).withColumn("criterion", F.lit(c))
        out = part if out is None else out.unionByName(part)
    return out


@query("F11_trajectory_type")
def _(d):
    return I.agent_summary(d.points, d.scenarios).select(*KEY, "trajectory_type")


@query("F12_kalman_difficulty")
def _(d):
    return I.agent_summary(d.points, d.scenarios).select(*KEY, "kalman_difficulty")


@query("F15_categorize_individual")
def _(d):
    return I.categorize_individual(d.individual, d.thresholds).select(*KEY, *INDIVIDUAL_FEATURES)


@query("F16_individual_features")
def _(d):
    return jobs.individual(d.tables, threshold=0.5, k_lanes=3, stage=materialize)


# --- map and distances --------------------------------------------------------------------------------------------

@query("M01_static_conflict_points")
def _(d):
    return M.static_conflict_points(d.map_points, resample_factor=3).select("scenario_id", "x", "y", "z")


@query("M02_lane_intersections")
def _(d):
    return M.lane_intersections(d.map_points, threshold=0.5).select("scenario_id", "x", "y")


@query("M03_dynamic_conflict_points")
def _(d):
    five = M.dynamic_conflict_points(d.signals).withColumn("rule", F.lit("all"))
    strict = M.dynamic_conflict_points(d.signals, only_full_sets=True).withColumn("rule", F.lit("strict_five"))
    three = M.dynamic_conflict_points(D.signals(d.scenarios, 3), only_full_sets=True).withColumn("rule", F.lit("strict_three"))
    return five.unionByName(strict).unionByName(three).select("rule", "scenario_id", "x", "y")


@query("M04_conflict_points")
def _(d):
    return M.conflict_points(d.map_points, D.signals(d.scenarios, 3), threshold=0.5).select("scenario_id", "kind", "x", "y")


@query("M05_nearest_conflict")
def _(d):
    return M.nearest_conflict(d.points, d.conflicts)


@query("M06_closest_lanes")
def _(d):
    return M.closest_lanes(d.points, d.map_points).select(
        *KEY, "t", "rank", "lane_idx", "distance", "point_idx", "proj_x", "proj_y")


@query("M07_closest_lanes_of_every_second_point")
def _(d):
    return M.closest_lanes(d.points, d.map_points, k=3, subsample=2).select(
        *KEY, "t", "rank", "lane_idx", "distance", "point_idx", "proj_x", "proj_y")


@query("M09_target_distances")
def _(d):
    return P.closest_agent_distances(d.points, d.scenarios, to="targets", targets=d.agents.filter("relevance = 1.0"))


@query("M10_ego_distances")
def _(d):
    a = P.closest_agent_distances(d.points, d.scenarios).select(*KEY, "distance")
    b = P.closest_agent_distances(d.points, d.scenarios, valid_only=True).select(
        *KEY, F.col("distance").alias("valid_distance"))
    return a.join(b, KEY, "left")


@query("M12_reaches_conflict")
def _(d):
    return M.reaches_conflict(d.points, d.conflicts, within=2.0)


# --- pairs --------------------------------------------------------------------------------------------------------

@query("P01_ego_pairs")
def _(d):
    e = P.enumerate_pairs(d.agents.drop("ego_idx"), scope="ego", scenarios=d.scenarios)
    return e.select(*PAIR, "type_i", "type_j", X.pair_type(F.col("type_i"), F.col("type_j")).alias("pair_type"))


@query("P02_pair_totals")
def _(d):
    return P.pair_totals(d.agents)


def _pair_out(df):
    return df.select(*PAIR, "status", "n_shared", *PAIR_FEATURES)


@query("P20_pair_features_ego")
def _(d):
    return _pair_out(P.pair_features(d.points, d.scenarios, scope="ego"))


@query("P20_pair_features_all")
def _(d):
    near = P.pair_features(d.points, d.scenarios, scope="all")
    return _pair_out(near)


@query("P06_status_all")
def _(d):
    near = P.pair_features(d.points, d.scenarios, scope="all", include_vehicle_free=False)
    return P.status_counts(near, P.pair_totals(d.agents), include_vehicle_free=False)


@query("P16_pair_features_average")
def _(d):
    return _pair_out(P.pair_features(d.points, d.scenarios, scope="ego", criterion="average"))


@query("P18_categorize_pairs")
def _(d):
    return P.categorize_pairs(d.pairs, d.thresholds).select(*PAIR, "status", *PAIR_FEATURES)


@query("P19_explicit_pairs")
def _(d):
    wanted = d.agents.filter("agent_idx < 9").select(
        "scenario_id", F.col("agent_idx").alias("i"), (F.col("agent_idx") + 1).alias("j"))
    return _pair_out(P.features_for_pairs(d.points, d.scenarios, wanted))


# --- scores -------------------------------------------------------------------------------------------------------

@query("W02_ego_weights")
def _(d):
    return S.agent_weights(d.agents, d.scenarios, PIPE, points=d.points)


@query("W03_relevant_weights")
def _(d):
    return S.agent_weights(d.agents, d.scenarios, RELEVANT, points=d.points)


@query("W01_uniform_weights")
def _(d):
    return S.agent_weights(d.agents, d.scenarios, UNIFORM)


@query("W06_individual_scores")
def _(d):
    return S.individual_scores(d.individual, d.weights, PIPE)


@query("W08_interaction_scores")
def _(d):
    return S.interaction_scores(d.pairs, d.weights, PIPE, d.scenarios)


@query("W08_interaction_scores_uniform")
def _(d):
    w = S.agent_weights(d.agents, d.scenarios, UNIFORM)
    return S.interaction_scores(d.pairs_all, w, UNIFORM, d.scenarios)


@query("W09_combined_scores")
def _(d):
    a = S.individual_scores(d.individual, d.weights, PIPE)
    b = S.interaction_scores(d.pairs, d.weights, PIPE, d.scenarios)
    return S.combined_scores(a, b)


@query("W09_single_agent_scenes")
def _(d):
    whole = d.complete_scores.select("scenario_id").distinct().hint("merge")
    return d.agent_scores.join(whole, "scenario_id", "left_anti").select(*KEY, "scorer", "score", "valid")


@query("W09_scene_scores")
def _(d):
    return jobs.scores(d.tables, d.individual, d.pairs, PIPE)[1]


@query("W10_score_category")
def _(d):
    return S.score_category(d.agent_scores, [2.0, 5.0, 9.0]).select(*KEY, "scorer", "category")


@query("W11_scene_score_from_pairs")
def _(d):
    return S.scene_score_from_pairs(S.pair_scores(d.pairs_all, PROBE, finite=True).select(*PAIR, "pair_score"),
                                    d.weights, PROBE)


@query("W12_missing_features")
def _(d):
    return S.missing_features(d.scenarios, d.individual)


# --- probes -------------------------------------------------------------------------------------------------------

@query("C01_constant_velocity")
def _(d):
    return C.constant_velocity(d.points, d.scenarios).select(*KEY, "t", "x", "y", "vx", "vy", "length", "valid")


@query("C02_baseline_pair_scores")
def _(d):
    return C.baseline_pair_scores(d.pairs, PROBE, skip_types=(4,))


@query("C03_probe_pairs")
def _(d):
    return C.probe_pairs(d.agents, d.altered, d.scenarios)


def _deltas(d):
    rows = C.probe_pair_rows(C.probe_tracks(d.points, d.scenarios), original=False)
    after = S.pair_scores(C.measured_pairs(rows, d.scenarios), PROBE).select("scenario_id", "probed", "other", "i", "j", "pair_score")
    return C.probe_deltas(after, C.baseline_pair_scores(d.pairs, PROBE))


@query("C05_probe_deltas")
def _(d):
    return _deltas(d).select("scenario_id", "probed", "other", "pair_score", "before", "delta")


@query("C06_winning_probe")
def _(d):
    return C.max_delta(C.candidates(_deltas(d), 1.0))


@query("C08_probes")
def _(d):
    p = C.find_probes(d.points, d.agents, d.scenarios, PROBE, stage=materialize)
    a = F.get("affected", F.lit(0))
    return p.select("scenario_id", "probed_agent", "is_ego", "score_before", "score_after",
                    a["other"].alias("affected_agent"), a["metric"].alias("metric"), a["t"].alias("frame"))


@query("C11_probe_summary")
def _(d):
    return C.probe_summary(d.probes, d.scenarios, d.agents)


@query("S31_probe_records")
def _(d):
    """Written as JSON and read back, maps taken apart."""
    root = f"{d.root}/probe_records"
    K.write_json(C.probe_records(d.probes, d.agents), root)
    kinds = ("scenario_id long, probed_agent_id long, is_ego_agent boolean, probe_type string, affected_agent_ids array<long>, criticality_results "
             "map<string, struct<timestamp: int, metric: string>>, score_before double, score_after double, "
             "affected_pair_scores_before map<string, double>, affected_pair_scores_after map<string, double>")
    got = d.spark.read.schema(kinds).json(root)
    first = F.map_values("criticality_results")[0]
    return got.select(
        "scenario_id", "probed_agent_id", "is_ego_agent", "probe_type", F.get("affected_agent_ids", F.lit(0)).alias("affected_agent_id"),
        first["timestamp"].alias("frame"), first["metric"].alias("metric"), "score_before", "score_after",
        F.map_keys("affected_pair_scores_before")[0].alias("pair"), F.size("affected_pair_scores_after").alias("n_pairs"))


@query("S31_altered_points")
def _(d):
    return C.altered_points(d.probes, d.points, d.scenarios).select(*KEY, "t", "x", "y", "vx", "vy", "length", "valid")


@query("P21_features")
def _(d):
    ind, pairs, near = jobs.features(d.tables, PIPE)
    met = pairs.select("scenario_id", F.explode(F.array("i", "j")).alias("agent_idx"), "status").groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("pairs"), F.count(F.when(F.col("status") < 2, 1)).alias("valid_pairs"))
    return ind.join(near, KEY).join(met, KEY, "left").select(
        *KEY, "speed", "acceleration", "deceleration", "jerk", "trajectory_type", "kalman_difficulty", "distance", "pairs", "valid_pairs")


# --- profiles -----------------------------------------------------------------------------------------------------

@query("A01_individual_by_type")
def _(d):
    return A.individual_long(d.individual).groupBy("type", "feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"))


@query("A02_pairs_by_type")
def _(d):
    return A.pair_long(d.pairs_all).groupBy("type", "feature").agg(
        F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("A03_category_thresholds")
def _(d):
    return A.category_thresholds(A.individual_long(d.individual).unionByName(A.pair_long(d.pairs)), ["type", "feature"])


@query("A04_histogram")
def _(d):
    return A.histogram(A.individual_long(d.individual), ["type", "feature"]).select("type", "feature", "bin", "count", "density")


@query("A05_score_thresholds")
def _(d):
    return A.score_thresholds(d.agent_scores.join(d.complete_scores.select("scenario_id").distinct().hint("merge"), "scenario_id", "left_semi"))


@query("A06_complete_scenes")
def _(d):
    return A.complete_scenes(d.scene_scores, SCORERS)


@query("A07_scene_splits")
def _(d):
    return A.scene_splits(d.complete_scores)


@query("A07_split_sizes")
def _(d):
    return A.split_sizes(A.scene_splits(d.complete_scores))


@query("A08_jaccard")
def _(d):
    return A.jaccard(A.scene_splits(d.complete_scores), SCORERS)


@query("S35_splits_per_dataset")
def _(d):
    return A.scene_splits(A.per_dataset(d.complete_scores, d.scenarios), by=("dataset",))


@query("S35_jaccard_per_dataset")
def _(d):
    return A.jaccard(A.scene_splits(A.per_dataset(d.complete_scores, d.scenarios), by=("dataset",)), SCORERS, by=("dataset",))


@query("S35_score_thresholds_per_dataset")
def _(d):
    scores = d.agent_scores.join(d.complete_scores.select("scenario_id").distinct().hint("merge"), "scenario_id", "left_semi")
    return A.score_thresholds(A.per_dataset(scores, d.scenarios), ("dataset", "scorer"))


@query("S35_score_grid_per_dataset")
def _(d):
    wide = A.per_dataset(A.wide_agent_scores(d.agent_scores), d.scenarios)
    return A.score_grid(wide, ("individual", "interaction"), by=("dataset",))


def _summary_per_dataset(d):
    own = d.scenarios.withColumn("scenario_id", F.col("scenario_id").cast("string"))
    return A.per_dataset(d.summary, own)


@query("S35_probe_statistics_per_dataset")
def _(d):
    return A.probe_statistics(_summary_per_dataset(d), by=("dataset",))


@query("S35_delta_quartiles_per_dataset")
def _(d):
    return A.delta_quartiles(_summary_per_dataset(d), by=("dataset",))


@query("S35_affected_counts_per_dataset")
def _(d):
    return A.affected_counts(_summary_per_dataset(d), by=("dataset",))


@query("S35_score_bound_per_dataset")
def _(d):
    return A.score_bound(_summary_per_dataset(d), by=("dataset",))


@query("S35_folders_per_dataset")
def _(d):
    scored = A.per_dataset(d.scene_scores.filter("key = 'combined'"), d.scenarios)
    return A.percentile_folders(scored, A.per_dataset(d.scenarios, d.scenarios), by=("dataset",))


@query("S35_feature_thresholds_per_dataset")
def _(d):
    long = A.individual_long(d.individual, ["scenario_id"]).unionByName(A.pair_long(d.pairs, ["scenario_id"]))
    return A.category_thresholds(A.per_dataset(long, d.scenarios), ["dataset", "type", "feature"])


@query("A09_score_grid")
def _(d):
    return A.score_grid(A.wide_agent_scores(d.agent_scores), ("individual", "interaction"))


@query("A10_score_grid_by_type")
def _(d):
    wide = A.wide_agent_scores(d.agent_scores).join(d.agents.select(*KEY, "agent_type").hint("merge"), KEY)
    return A.score_grid(wide, SCORERS, by=("agent_type",))


@query("A11_scenario_counts")
def _(d):
    return A.scenario_counts(d.scenarios, d.agents, d.individual, d.pairs_all, totals=P.pair_totals(d.agents))


@query("A12_dataset_counts")
def _(d):
    return A.dataset_counts(d.counts)


@query("A13_coverage")
def _(d):
    counted = d.individual.join(d.scenarios.select("scenario_id", "dataset").hint("merge"), "scenario_id")
    return A.coverage(d.scenarios, counted)


@query("A14_interquartile_mean")
def _(d):
    return A.interquartile_mean(A.counts_long(d.counts, A.count_columns()))


@query("A15_ego_scoped")
def _(d):
    return A.ego_scoped(A.dataset_counts(d.counts))


@query("A16_composition")
def _(d):
    names = [p.name for p in PairType if p not in (PairType.UNSET, PairType.OTHER)]
    return A.composition(A.dataset_counts(d.counts).filter("dataset IS NOT NULL"), "pairs_valid_", names)


@query("A17_count_quartiles")
def _(d):
    return A.count_quartiles(A.counts_long(d.counts, A.count_columns()))


@query("A18_probed_rows")
def _(d):
    return A.probed_rows(d.summary)


@query("A19_probe_outcomes")
def _(d):
    ds = d.scenarios.select(F.col("scenario_id").cast("string").alias("scenario_id"), "dataset")
    return A.probe_outcomes(d.summary.join(ds, "scenario_id"), by=("dataset",))


@query("A20_probe_statistics")
def _(d):
    return A.probe_statistics(d.summary)


@query("A21_top_probes")
def _(d):
    return A.top_probes(d.summary, 5)


@query("A22_delta_quartiles")
def _(d):
    return A.delta_quartiles(d.summary)


@query("A22_affected_counts")
def _(d):
    return A.affected_counts(d.summary)


@query("A23_percentile_folders")
def _(d):
    return A.percentile_folders(d.scene_scores.filter("key = 'combined'"), d.scenarios)


@query("A24_normalized_scores")
def _(d):
    return A.normalized_scores(d.agent_scores.filter("scorer = 'combined'"), d.scenarios)


@query("A26_profile_chain")
def _(d):
    prof = jobs.Profile(d.spark, f"{d.root}/profile", d.tables, threshold=0.5, k_lanes=3)
    return prof.score_categories().select(*KEY, "scorer", "score", "valid")


@query("A26_scene_categories")
def _(d):
    prof = jobs.Profile(d.spark, f"{d.root}/profile", d.tables, threshold=0.5, k_lanes=3)
    return prof.scene_categories().select("scenario_id", "scorer", "scene_score")


@query("A27_ego_path_ends")
def _(d):
    return A.ego_path_ends(d.points, d.scenarios)


@query("A28_score_bound")
def _(d):
    return A.score_bound(d.summary)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene criticality: motion features, ego pairs, weights and the three scene scores."""
    d = Data(spark, sf_dir)
    ind = jobs.individual(d.tables, threshold=0.5, k_lanes=3, stage=materialize)
    return plain(jobs.scores(d.tables, ind, P.pair_features(d.points, d.scenarios), PIPE)[1])
