"""Per-agent motion features.

One exchange on (scenario_id, agent_idx) carries every window and the final aggregate. A track is bounded by the scene
horizon, so no window partition grows with the number of agents, scenes or the size of the dataset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions import expr as X
from lanewise.functions.nearest import nearest_distance
from lanewise.operators.limits import attach
from lanewise.schema import EPS, INDIVIDUAL_FEATURES, MIN_VALID, MPH_TO_MS, Limits

KEY = ["scenario_id", "agent_idx"]
#: Least deceleration. Sums of equal speeds in another order leave some 1e-14, whose sign says nothing.
STEADY = 1e-9


def valid_points(points: DataFrame) -> DataFrame:
    return points.filter(X.is_valid(F.col("valid")))


def motion_profile(points: DataFrame, *, smooth: bool = True) -> DataFrame:
    """Valid points with position in the track (`at`), smoothed speed, acceleration and jerk per step."""
    w = Window.partitionBy(*KEY).orderBy("t")
    every = Window.partitionBy(*KEY)
    df = valid_points(points).withColumns({
        "at": F.row_number().over(w) - 1,
        "n_valid": F.count(F.lit(1)).over(every),
        "dt_prev": F.col("ts_s") - F.lag("ts_s").over(w),
        "raw_speed": X.norm2(F.col("vx"), F.col("vy")),
    })
    df = X.moving_average(df, "raw_speed", "speed", w) if smooth else df.withColumn("speed", F.col("raw_speed"))
    df = X.gradient(df, "speed", "ts_s", "accel", w)
    df = X.gradient(df, "accel", "ts_s", "jerk", w)
    return df.withColumn("jerk", F.abs("jerk"))


def usable(profile: DataFrame) -> DataFrame:
    """Agents with two or more valid points and neither a NaN speed nor a NaN acceleration."""
    every = Window.partitionBy(*KEY)
    bad = F.max(F.isnan("speed") | F.isnan("accel") | F.col("speed").isNull()).over(every)
    return profile.filter(F.col("n_valid") >= MIN_VALID).withColumn("_bad", bad).filter(~F.col("_bad")).drop("_bad")


def speed_limit_gap(profile: DataFrame, closest_lanes: DataFrame, lanes: DataFrame) -> DataFrame:
    """Adds `limit_gap`: mean absolute difference to the limits of the closest lanes of each step.

    A missing limit among the closest lanes makes the step NaN; scenes without any known limit get no value. Limits and steps grow with
    the scenes, so the joins ask for sort-merge instead of a broadcast.
    """
    known = lanes.filter(F.col("speed_limit_mph").isNotNull()).select("scenario_id").distinct()
    limits = lanes.join(known.hint("merge"), "scenario_id", "left_semi").select(
        "scenario_id", "lane_idx", F.coalesce(F.col("speed_limit_mph"), X.lit_d(X.NAN)).alias("_mph"))
    near = (
        closest_lanes.select(*KEY, "t", "lane_idx")
        .join(limits.hint("merge"), ["scenario_id", "lane_idx"])
        .groupBy(*KEY, "t")
        .agg(F.collect_list(F.col("_mph") * MPH_TO_MS).alias("_limits"))
    )
    total = F.aggregate("_limits", X.lit_d(0.0), lambda acc, v: acc + F.abs(F.col("speed") - v))
    return profile.join(near.hint("merge"), [*KEY, "t"], "left").withColumn(
        "limit_gap", F.when(F.size("_limits") > 0, total / F.size("_limits"))).drop("_limits")


def _signed_part(accel: Column, positive: bool, critical: bool) -> Column:
    side = F.when(accel >= -STEADY, F.greatest(accel, F.lit(0.0))) if positive else F.when(accel < -STEADY, -accel)
    return F.coalesce(F.max(side) if critical else F.avg(side), F.lit(0.0))


def kalman_error(df: DataFrame, track: str, now: str, out: str) -> DataFrame:
    """Adds the error of a constant-mean-velocity filter forecast at the last known future point, times the horizon.

    `track` is an array of struct(t, x, y) in time order, `now` the last observed step. Every array is its own column,
    so that no step of the fold evaluates another array expression.
    """
    q, r = 1e-5, 1e-4
    last = F.element_at(track, -1)
    df = df.withColumns({
        "_hist": F.filter(track, lambda p: p["t"] <= F.col(now)), "_goal": F.when(last["t"] > F.col(now), last)})
    n = F.size("_hist")
    head, tail = F.get("_hist", F.lit(0)), F.get("_hist", n - 1)
    df = df.withColumns({
        "_n": n, "_x": head["x"], "_y": head["y"],
        "_vx": X.ieee_div(tail["x"] - head["x"], (n - 1).cast("double")),
        "_vy": X.ieee_div(tail["y"] - head["y"], (n - 1).cast("double"))})
    start = F.struct(F.col("_x").alias("x"), F.col("_y").alias("y"), F.lit(1.0).alias("p"), F.lit(1.0).alias("v"))

    def step(s, o):
        p = s["p"] + s["v"] + q
        v = s["v"] + q
        g = p / (p + r)
        px, py = s["x"] + F.col("_vx"), s["y"] + F.col("_vy")
        return F.struct(
            (px + g * (o["x"] - px)).alias("x"), (py + g * (o["y"] - py)).alias("y"),
            (p * (1.0 - g)).alias("p"), (v * (1.0 - v / (v + r))).alias("v"))

    df = df.withColumn("_state", F.aggregate(F.slice("_hist", 2, F.greatest(F.col("_n") - 1, F.lit(0))), start, step))
    ahead = (F.col("_goal.t") - F.col(now)).cast("double")
    miss = X.norm2(F.col("_state.x") + F.col("_vx") * ahead - F.col("_goal.x"),
                   F.col("_state.y") + F.col("_vy") * ahead - F.col("_goal.y"))
    return df.withColumn(out, F.when((F.col("_n") < MIN_VALID) | F.col("_goal").isNull(), F.lit(-1.0)).otherwise(
        miss * ahead / 100.0)).drop("_hist", "_goal", "_n", "_x", "_y", "_vx", "_vy", "_state")


def waiting_period(runs: DataFrame, conflict_points: DataFrame, *, criterion: str) -> DataFrame:
    """Waiting time over distance to the nearest conflict point, per agent.

    `runs` has one row per agent with `waits`: array of struct(x, y, z, seconds), one per standstill.
    """
    each = runs.select(*KEY, F.posexplode("waits").alias("run", "w")).select(
        *KEY, "run", *[F.coalesce(F.col(f"w.{c}").cast("double"), X.lit_d(X.NAN)).alias(c) for c in "xyz"], F.col("w.seconds").alias("seconds"))
    nearest = nearest_distance(each, conflict_points, name="waits").withColumn("score", F.col("seconds") / (F.col("distance") + EPS))
    agg = F.max if criterion == "critical" else F.avg
    return nearest.groupBy(*KEY).agg(agg("score").alias("waiting_period"))


def agent_summary(
    points: DataFrame, scenarios: DataFrame, *, criterion: str = "critical", limits: Limits | None = None,
    closest_lanes: DataFrame | None = None, lanes: DataFrame | None = None,
) -> DataFrame:
    """One row per usable agent: aggregated motion features, manoeuvre class, forecast error and standstill runs.

    An acceleration is a deceleration only if it is below -STEADY; between that and zero it counts as an acceleration of zero.
    """
    if criterion not in ("critical", "average"):
        raise ValueError(f"unknown criterion {criterion!r}")
    critical = criterion == "critical"
    profile = motion_profile(points)
    profile, lim = attach(profile, scenarios.hint("merge"), limits=limits)
    profile = usable(profile)
    profile = (
        speed_limit_gap(profile, closest_lanes, lanes)
        if closest_lanes is not None and lanes is not None
        else profile.withColumn("limit_gap", F.lit(None).cast("double"))
    )
    w = Window.partitionBy(*KEY).orderBy("t")
    still = F.col("speed") <= lim["max_stationary_speed"]
    profile = (
        profile.withColumn("still", still)
        .withColumn("run_start", F.col("still") & ~F.coalesce(F.lag("still").over(w), F.lit(False)))
        .withColumn("run_end", F.col("still") & ~F.coalesce(F.lead("still").over(w), F.lit(False)))
        .withColumn("next_ts", F.coalesce(F.lead("ts_s").over(w), F.col("ts_s")))
        .withColumn("first_step", F.col("at") == 0)
        .withColumn("last_step", F.col("at") == F.col("n_valid") - 1)
    )
    agg = F.max if critical else F.avg

    def at(flag: str, col: str) -> Column:
        return F.max(F.when(F.col(flag), F.col(col)))

    heading = F.degrees("heading")
    out = profile.groupBy(*KEY).agg(
        F.first("agent_type").alias("agent_type"),
        F.count(F.lit(1)).alias("n_valid"),
        agg("speed").alias("speed"),
        agg("limit_gap").alias("speed_limit_diff"),
        _signed_part(F.col("accel"), True, critical).alias("acceleration"),
        _signed_part(F.col("accel"), False, critical).alias("deceleration"),
        F.when(F.coalesce(F.min("dt_prev"), F.lit(1.0)) > 0, agg("jerk")).alias("jerk"),
        at("first_step", "x").alias("x0"), at("first_step", "y").alias("y0"),
        at("last_step", "x").alias("x1"), at("last_step", "y").alias("y1"),
        at("first_step", "speed").alias("v0"), at("last_step", "speed").alias("v1"),
        F.max(F.when(F.col("first_step"), heading)).alias("h0"),
        F.max(F.when(F.col("last_step"), heading)).alias("h1"),
        F.sort_array(F.collect_list(F.when(F.col("run_start"), F.struct("t", "ts_s", "x", "y", "z")))).alias("starts"),
        F.sort_array(F.collect_list(F.when(F.col("run_end"), F.struct("t", "next_ts")))).alias("ends"),
        F.sort_array(F.collect_list(F.struct("t", "x", "y"))).alias("track"),
    )
    out, lim = attach(out, scenarios.hint("merge"), ("current_time_index",), limits)
    out = kalman_error(out, "track", "current_time_index", "kalman_difficulty")
    shape = X.track_shape(
        F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("h0"), F.col("h1"), F.col("v0"), F.col("v1"), lim)
    waits = F.zip_with("starts", "ends", lambda s, e: F.struct(
        s["x"].alias("x"), s["y"].alias("y"), s["z"].alias("z"), (e["next_ts"] - s["ts_s"]).alias("seconds")))
    return out.select(
        *KEY, "agent_type", F.col("n_valid").cast("long").alias("n_valid"), "speed",
        F.coalesce("speed_limit_diff", X.lit_d(X.NAN)).alias("speed_limit_diff"), "acceleration", "deceleration",
        F.when(~F.isnan("jerk"), F.col("jerk")).alias("jerk"), shape.alias("trajectory_type"),
        "kalman_difficulty",
        waits.alias("waits"),
    )


def individual_features(
    points: DataFrame, scenarios: DataFrame, *, criterion: str = "critical", limits: Limits | None = None,
    conflict_points: DataFrame | None = None, closest_lanes: DataFrame | None = None, lanes: DataFrame | None = None,
    stage=None,
) -> DataFrame:
    """The per-agent feature table. Jerk is null where timestamps do not increase, the limit gap NaN where unknown.

    `stage(df, name)` may write the motion summary, which the waiting period reads a second time.
    """
    base = agent_summary(
        points, scenarios, criterion=criterion, limits=limits, closest_lanes=closest_lanes, lanes=lanes)
    if conflict_points is None:
        base = base.withColumn("waiting_period", F.lit(0.0))
    else:
        base = stage(base, "summary") if stage else base
        wait = waiting_period(base.select(*KEY, "waits"), conflict_points, criterion=criterion)
        base = base.join(wait.hint("merge"), KEY, "left").withColumn("waiting_period", F.coalesce("waiting_period", F.lit(0.0)))
    return base.select(
        *KEY, "agent_type", "n_valid", "speed", "speed_limit_diff", "acceleration", "deceleration", "jerk",
        "waiting_period", "trajectory_type", "kalman_difficulty")


def threshold_arrays(thresholds: DataFrame) -> DataFrame:
    """(type, feature) -> ascending array; a handful of rows per type, so it is always small."""
    ordered = F.sort_array(F.collect_list(F.struct("ord", "value")))
    return thresholds.groupBy("type", "feature").agg(F.transform(ordered, lambda s: s["value"]).alias("cuts"))


def threshold_maps(thresholds: DataFrame) -> DataFrame:
    """type -> map(feature -> cuts): at most one row per agent or pair type, hence safe to broadcast."""
    return threshold_arrays(thresholds).groupBy("type").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "cuts"))).alias("cuts"))


def categorize_individual(features: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Replace each feature by its category.

    Types without a threshold set give -1, a feature without thresholds NaN, a missing jerk or an uncomputable
    forecast error 0, and an unknown speed-limit difference stays NaN.
    """
    maps = threshold_maps(thresholds).select(F.col("type").alias("_type"), "cuts")
    df = features.withColumn("_type", X.threshold_group(F.col("agent_type"))).join(F.broadcast(maps), "_type", "left")

    def cat(name: str) -> Column:
        cuts = F.try_element_at("cuts", F.lit(name))
        out = F.when(F.col("_type").isNull(), -1.0).when(cuts.isNull(), X.lit_d(X.NAN)).otherwise(
            X.category(F.col(name), cuts))
        if name == "speed_limit_diff":
            return F.when(F.isnan(name), X.lit_d(X.NAN)).otherwise(out)
        if name == "jerk":
            return F.when(F.col(name).isNull(), 0.0).otherwise(out)
        if name == "kalman_difficulty":
            return F.when(F.col(name) < 0, 0.0).otherwise(out)
        return out

    keep = [c for c in features.columns if c not in INDIVIDUAL_FEATURES]
    return df.select(*keep, *[cat(f).alias(f) for f in INDIVIDUAL_FEATURES])
