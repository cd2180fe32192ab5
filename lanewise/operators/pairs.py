"""Pairwise interaction features.

Tracks are packed once into one array row per agent, indexed by step and bounded by the scene horizon. Pairs are built
by joining those rows, so a join moves one row per pair instead of one per pair and step, and everything that follows
(alignment, headings, gaps, conflict times) happens in a kernel over batches of such rows, without another shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.functions import expr as X
from lanewise.operators.individual import threshold_maps, valid_points
from lanewise.operators.limits import attach
from lanewise.operators.pair_kernel import COUNTS, METRICS, metrics_task
from lanewise.schema import EPS, MIN_VALID, PAIR_FEATURES, SCORED_STATUSES, AgentType, Limits, PairStatus

KEY = ["scenario_id", "agent_idx"]
PAIR = ["scenario_id", "i", "j"]


def pair_speed(vx: Column, vy: Column) -> Column:
    return X.norm2(vx, vy) + EPS


def packed_step() -> Column:
    return F.struct(
        "t", "x", "y", "z", pair_speed(F.col("vx"), F.col("vy")).alias("v"), F.degrees("heading").alias("h"), F.col("length").alias("len"))


def pack_tracks(points: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """One row per agent: `steps[t]` is struct(t, x, y, z, v, h, len), null where the agent is not valid.

    Agents that are never valid keep a row with no steps. Of repeated rows of a step the smallest by (x, y, z, ...) counts.
    """
    step = packed_step()
    seen = points.groupBy(*keys).agg(
        F.first("agent_type").alias("agent_type"),
        F.sort_array(F.collect_list(F.when(X.is_valid(F.col("valid")), step))).alias("_seen"))
    hole = F.lit(None).cast(seen.schema["_seen"].dataType.elementType.simpleString())
    return seen.select(*keys, "agent_type", by_step("_seen", hole).alias("steps"))


def by_step(seen: str, hole: Column) -> Column:
    """Place time-ordered structs at their step index, filling skipped steps with `hole`. Of a repeated step the first stays."""
    before = lambda i: F.coalesce(F.get(F.col(seen), i - 1)["t"], F.lit(-1))
    return F.flatten(F.transform(seen, lambda s, i: F.when(s["t"] == before(i), F.array_repeat(hole, 0)).otherwise(
        F.concat(F.array_repeat(hole, s["t"] - before(i) - 1), F.array(s)))))


def agent_table(points: DataFrame) -> DataFrame:
    return points.groupBy(*KEY).agg(F.first("agent_type").alias("agent_type"))


def all_pairs(agents: DataFrame) -> DataFrame:
    """Every unordered pair i < j with both types. The result itself is quadratic in the agents of a scene;
    :func:`nearby_pairs` is the form the feature jobs use."""
    a = agents.select("scenario_id", F.col("agent_idx").alias("i"), F.col("agent_type").alias("type_i"))
    b = agents.select("scenario_id", F.col("agent_idx").alias("j"), F.col("agent_type").alias("type_j"))
    return a.join(b, "scenario_id").filter(F.col("i") < F.col("j"))


def ego_pairs(agents: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Pairs of the ego with every other agent: linear in the number of agents."""
    mine = agents.join(scenarios.select("scenario_id", "ego_idx"), "scenario_id")
    ego = mine.filter(F.col("agent_idx") == F.col("ego_idx")).select("scenario_id", F.col("agent_type").alias("ego_type"))
    rest = mine.filter(F.col("agent_idx") != F.col("ego_idx")).join(ego, "scenario_id")
    first = F.col("ego_idx") < F.col("agent_idx")
    return rest.select(
        "scenario_id", F.least("ego_idx", "agent_idx").alias("i"), F.greatest("ego_idx", "agent_idx").alias("j"),
        F.when(first, F.col("ego_type")).otherwise(F.col("agent_type")).alias("type_i"),
        F.when(first, F.col("agent_type")).otherwise(F.col("ego_type")).alias("type_j"))


def enumerate_pairs(agents: DataFrame, *, scope: str, scenarios: DataFrame | None = None) -> DataFrame:
    if scope == "all":
        return all_pairs(agents)
    if scope != "ego":
        raise ValueError(f"unsupported pair scope {scope!r}; expected 'all' or 'ego'")
    if scenarios is None:
        raise ValueError("ego scope needs the scenarios table")
    return ego_pairs(agents, scenarios)


def missing_ego(agents: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Scenarios whose ego index names no agent: invalid for the ego scope."""
    have = agents.select("scenario_id", F.col("agent_idx").alias("ego_idx"))
    return scenarios.select("scenario_id", "ego_idx").join(have, ["scenario_id", "ego_idx"], "left_anti")


def pair_totals(agents: DataFrame) -> DataFrame:
    """Number of unordered pairs per scene and pair type, by counting instead of enumerating."""
    n = agents.groupBy("scenario_id", "agent_type").agg(F.count(F.lit(1)).alias("n"))
    a = n.select("scenario_id", F.col("agent_type").alias("ta"), F.col("n").alias("na"))
    b = n.select("scenario_id", F.col("agent_type").alias("tb"), F.col("n").alias("nb"))
    joined = a.join(b.hint("merge"), "scenario_id").filter(F.col("ta") <= F.col("tb"))
    same = F.expr("na * (na - 1) div 2")
    count = F.when(F.col("ta") == F.col("tb"), same).otherwise(F.col("na") * F.col("nb"))
    ego = (F.col("ta") == int(AgentType.EGO_AGENT)) | (F.col("tb") == int(AgentType.EGO_AGENT))
    veh = (X.fold_ego(F.col("ta")) == 1) | (X.fold_ego(F.col("tb")) == 1)
    return (
        joined.withColumn("pair_type", X.pair_type(F.col("ta"), F.col("tb")))
        .groupBy("scenario_id", "pair_type")
        .agg(F.sum(count).alias("pairs"), F.sum(F.when(ego, count).otherwise(0)).alias("with_ego"),
             F.sum(F.when(veh, count).otherwise(0)).alias("with_vehicle"))
        .filter(F.col("pairs") > 0)
    )


def status_counts(near: DataFrame, totals: DataFrame, *, include_vehicle_free: bool = True) -> DataFrame:
    """(scenario_id, status, pairs) over all enumerated pairs, from near pairs and :func:`pair_totals` alone."""
    far, out = int(PairStatus.TOO_FAR), int(PairStatus.OUT_OF_SCOPE)
    seen = near.filter(~F.col("status").isin(far, out)).select("scenario_id", "status", F.lit(1).cast("long").alias("n"))
    whole = F.sum("pairs") if include_vehicle_free else F.sum("with_vehicle")
    per = totals.groupBy("scenario_id").agg(whole.alias("whole"), (F.sum("pairs") - whole).alias("free"))
    base = per.select("scenario_id", F.explode(F.array(
        F.struct(F.lit(far).alias("status"), F.col("whole").alias("n")),
        F.struct(F.lit(out).alias("status"), F.col("free").alias("n")))).alias("c")).select("scenario_id", "c.*")
    minus = seen.select("scenario_id", F.lit(far).alias("status"), (-F.col("n")).alias("n"))
    rows = seen.unionByName(base).unionByName(minus)
    return rows.groupBy("scenario_id", "status").agg(F.sum("n").alias("pairs")).filter(F.col("pairs") > 0)


def nearby_pairs(tracks: DataFrame, scenarios: DataFrame | None = None, limits: Limits | None = None) -> DataFrame:
    """Pairs whose tracks share or touch a grid cell of the maximum distance at any time.

    A superset of the pairs that ever come within that distance: agents further apart than one cell in every shared
    step cannot qualify. The join key is (scene, cell), so a crowded scene spreads over its area.
    """
    df, lim = attach(tracks, scenarios, limits=limits)
    d = lim["agent_to_agent_max_distance"]
    cell = F.transform(F.filter("steps", lambda s: s.isNotNull()), lambda s: F.struct(
        F.floor(s["x"] / d).alias("cx"), F.floor(s["y"] / d).alias("cy")))
    cells = df.select(*KEY, "agent_type", F.explode(F.array_distinct(cell)).alias("c")).select(
        *KEY, "agent_type", F.col("c.cx").alias("cx"), F.col("c.cy").alias("cy"))
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    a = cells.select(
        "scenario_id", F.col("agent_idx").alias("i"), F.col("agent_type").alias("type_i"), "cx", "cy",
        F.explode(around).alias("o")).select(
        "scenario_id", "i", "type_i", (F.col("cx") + F.col("o.a")).alias("cx"), (F.col("cy") + F.col("o.b")).alias("cy")
    ).distinct()
    b = cells.select("scenario_id", F.col("agent_idx").alias("j"), F.col("agent_type").alias("type_j"), "cx", "cy")
    return (
        a.join(b.hint("merge"), ["scenario_id", "cx", "cy"])
        .filter((F.col("i") < F.col("j"))
                & ~((F.col("type_i") == int(AgentType.OTHER)) & (F.col("type_j") == int(AgentType.OTHER))))
        .select(*PAIR, "type_i", "type_j")
        .distinct()
    )


def with_tracks(pairs: DataFrame, tracks: DataFrame) -> DataFrame:
    """Attach both packed tracks to each pair.

    Sort-merge is asked for because the work per joined row is large: a broadcast would leave the few bytes of pairs,
    and with them all that work, in a handful of tasks. Skewed keys are split at run time.
    """
    ti = tracks.select("scenario_id", F.col("agent_idx").alias("i"), F.col("steps").alias("steps_i"))
    tj = tracks.select("scenario_id", F.col("agent_idx").alias("j"), F.col("steps").alias("steps_j"))
    return pairs.join(ti.hint("merge"), ["scenario_id", "i"], "left").join(
        tj.hint("merge"), ["scenario_id", "j"], "left")


def ego_pair_tracks(tracks: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Ego pairs with both tracks. The partner side is the track table itself.

    Sort-merge is asked for: packed tracks compress so well that Spark would send all of them through the driver.
    """
    ego = tracks.join(scenarios.select("scenario_id", F.col("ego_idx").alias("agent_idx")).hint("merge"), KEY).select(
        "scenario_id", F.col("agent_idx").alias("ego_idx"), F.col("agent_type").alias("ego_type"),
        F.col("steps").alias("ego_steps"))
    df = tracks.join(ego.hint("merge"), "scenario_id").filter(F.col("agent_idx") != F.col("ego_idx"))
    first = F.col("ego_idx") < F.col("agent_idx")

    def pick(ego_col, other_col, ego_first):
        return F.when(first, F.col(ego_col if ego_first else other_col)).otherwise(
            F.col(other_col if ego_first else ego_col))

    return df.select(
        "scenario_id", F.least("ego_idx", "agent_idx").alias("i"), F.greatest("ego_idx", "agent_idx").alias("j"),
        pick("ego_type", "agent_type", True).alias("type_i"), pick("ego_type", "agent_type", False).alias("type_j"),
        pick("ego_steps", "steps", True).alias("steps_i"), pick("ego_steps", "steps", False).alias("steps_j"))


def shared_steps(steps_i: Column, steps_j: Column) -> Column:
    """Steps where both agents are valid, in time order: array of struct(a, b)."""
    zipped = F.zip_with(steps_i, steps_j, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    both = F.filter(zipped, lambda z: z["a"].isNotNull() & z["b"].isNotNull())
    return F.coalesce(both, F.filter(zipped, lambda z: F.lit(False)))


def pair_metrics(
    pairs: DataFrame, keys: Sequence[str], lim: dict[str, Column], *, criterion: str = "critical",
    prefilter: bool | Column = True, include_vehicle_free: bool = True, inv_cap: float = 10.0, carry: Sequence[str] = (),
) -> DataFrame:
    """Status and metrics of each pair row.

    `pairs` has `keys`, type_i, type_j, steps_i, steps_j and, where thresholds are columns, those columns. A row is measured by itself, in
    an Arrow kernel over many rows at once (:mod:`lanewise.operators.pair_kernel`), so nothing is shuffled. With `prefilter` pairs beyond
    the XY range and other-other pairs are too far; without it (an explicit pair list) only the XYZ range counts; a column decides row
    by row.
    """
    if criterion not in ("critical", "average"):
        raise ValueError(f"unknown criterion {criterion!r}")
    critical = criterion == "critical"
    lim_cols = {n: f"_{n}" for n in (
        "max_stationary_speed", "agent_to_agent_max_distance", "agent_to_conflict_point_max_distance",
        "agent_to_agent_distance_breach", "heading_threshold", "agent_max_deceleration")}
    kept = [*keys, *carry, "type_i", "type_j", *lim_cols.values()]
    base = pairs.select(*keys, *carry, "type_i", "type_j", *[lim[n].cast("double").alias(c) for n, c in lim_cols.items()], "steps_i", "steps_j")
    schema = T.StructType([*(base.schema[c] for c in kept), *(T.StructField(c, T.LongType()) for c in COUNTS),
                           *(T.StructField(c, T.DoubleType()) for c in METRICS)])
    agg = base.mapInArrow(metrics_task(kept, lim_cols, critical), schema)
    # Without any such step there is no value: a null, not a NaN.
    agg = agg.withColumns({
        **{c: F.when(F.col("n_shared") > 0, F.col(c)) for c in ("_min_xy", "_min_sep", "_vi", "_vj", "separation", "intersection", "collision")},
        **{c: F.when(F.col("n_aligned") > 0, F.col(c)) for c in ("thw", "ttc", "drac")}})
    far = F.col("_agent_to_agent_max_distance")
    both_other = (F.col("type_i") == int(AgentType.OTHER)) & (F.col("type_j") == int(AgentType.OTHER))
    status = F.when(F.lit(False), int(PairStatus.UNKNOWN))
    if not include_vehicle_free:
        no_vehicle = ~X.fold_ego(F.col("type_i")).isin(1) & ~X.fold_ego(F.col("type_j")).isin(1)
        status = status.when(no_vehicle, int(PairStatus.OUT_OF_SCOPE))
    if prefilter is not False:
        ranged = F.lit(True) if prefilter is True else prefilter
        status = status.when(ranged & (both_other | F.col("_min_xy").isNull() | (F.col("_min_xy") > far)), int(PairStatus.TOO_FAR))
    still = F.col("_max_stationary_speed")
    status = (
        status.when(F.col("n_shared") < MIN_VALID, int(PairStatus.MASK_NOT_VALID))
        .when(F.col("_min_sep") > far, int(PairStatus.TOO_FAR))
        .when((F.col("_vi") < still) & (F.col("_vj") < still), int(PairStatus.STATIONARY))
        .when(F.col("n_aligned") < MIN_VALID, int(PairStatus.PARTIAL_HEADING))
        .otherwise(int(PairStatus.OK))
    )
    agg = agg.withColumn("status", status.cast("int"))
    scored, ok = F.col("status").isin(*SCORED_STATUSES), F.col("status") == int(PairStatus.OK)
    nan = X.lit_d(X.NAN)

    def leader(name, neutral):
        return F.when(ok, F.col(name)).when(scored, X.lit_d(neutral)).otherwise(nan).alias(name)

    out = agg.select(
        *keys, *carry, "type_i", "type_j", "status", "n_shared",
        *[F.when(scored, F.col(c)).otherwise(nan).alias(c) for c in ("separation", "intersection", "collision", "mttcp")],
        leader("thw", X.INF), leader("ttc", X.INF), leader("drac", 0.0))
    for m in ("mttcp", "thw", "ttc"):
        out = out.withColumn(f"inv_{m}", F.when(scored, X.inverse_capped(F.col(m), inv_cap)).otherwise(nan))
    return out.select(*keys, *carry, "type_i", "type_j", "status", "n_shared", *PAIR_FEATURES)


def pair_features(
    points: DataFrame, scenarios: DataFrame, *, scope: str = "ego", criterion: str = "critical",
    include_vehicle_free: bool = True, limits: Limits | None = None, far_pairs: bool = False,
) -> DataFrame:
    """Interaction features of every pair in scope.

    Ego scope returns all pairs. All scope returns the pairs of the grid join that are not too far, wherever the grid lies; the
    remaining pairs are counted by :func:`pair_totals`, and are listed only with `far_pairs`.
    """
    tracks = pack_tracks(points)
    if scope == "ego":
        # Dealt anew by pair: the join leaves a whole scene in one task, and all the arithmetic of its pairs is still to come.
        rows = ego_pair_tracks(tracks, scenarios).repartition(*PAIR)
    elif scope == "all":
        rows = with_tracks(nearby_pairs(tracks, scenarios, limits), tracks)
    else:
        raise ValueError(f"unsupported pair scope {scope!r}; expected 'all' or 'ego'")
    rows, lim = attach(rows, scenarios, limits=limits)
    near = pair_metrics(rows, PAIR, lim, criterion=criterion, include_vehicle_free=include_vehicle_free)
    if scope == "ego":
        return near
    near = near.filter(F.col("status") != int(PairStatus.TOO_FAR))
    if not far_pairs:
        return near
    rest = all_pairs(agent_table(points)).join(near.select(*PAIR), PAIR, "left_anti")
    veh = (X.fold_ego(F.col("type_i")) == 1) | (X.fold_ego(F.col("type_j")) == 1)
    code = F.lit(int(PairStatus.TOO_FAR)) if include_vehicle_free else F.when(veh, int(PairStatus.TOO_FAR)).otherwise(
        int(PairStatus.OUT_OF_SCOPE))
    filler = rest.select(
        *PAIR, "type_i", "type_j", code.cast("int").alias("status"), F.lit(None).cast("long").alias("n_shared"),
        *[X.lit_d(X.NAN).alias(c) for c in PAIR_FEATURES])
    return near.unionByName(filler)


def features_for_pairs(
    points: DataFrame, scenarios: DataFrame, pairs: DataFrame, *, criterion: str = "critical",
    limits: Limits | None = None,
) -> DataFrame:
    """Features of an explicit pair list (scenario_id, i, j), without the range prefilter."""
    tracks = pack_tracks(points)
    ti = tracks.select("scenario_id", F.col("agent_idx").alias("i"), F.col("agent_type").alias("type_i"),
                       F.col("steps").alias("steps_i")).hint("merge")
    tj = tracks.select("scenario_id", F.col("agent_idx").alias("j"), F.col("agent_type").alias("type_j"),
                       F.col("steps").alias("steps_j")).hint("merge")
    named = pairs.select(*PAIR).distinct().join(ti, ["scenario_id", "i"]).join(tj, ["scenario_id", "j"])
    rows, lim = attach(named, scenarios, limits=limits)
    return pair_metrics(rows, PAIR, lim, criterion=criterion, prefilter=False)


def categorize_pairs(features: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Replace each pair feature by its category; -1 without thresholds or for pair type OTHER."""
    maps = threshold_maps(thresholds).select(F.col("type").alias("_type"), "cuts")
    name = X.pair_type_name(X.pair_type(F.col("type_i"), F.col("type_j")))
    df = features.withColumn("_type", name).join(F.broadcast(maps), "_type", "left")
    scored = F.col("status").isin(*SCORED_STATUSES)

    def cat(f):
        cuts = F.try_element_at("cuts", F.lit(f))
        hit = F.when((F.col("_type") == "OTHER") | cuts.isNull(), -1.0).otherwise(X.category(F.col(f), cuts))
        return F.when(scored, hit).otherwise(X.lit_d(X.NAN)).alias(f)

    keep = [c for c in features.columns if c not in PAIR_FEATURES]
    return df.select(*keep, *[cat(f) for f in PAIR_FEATURES])


def closest_agent_distances(
    points: DataFrame, scenarios: DataFrame, *, to: str = "ego", targets: DataFrame | None = None,
    valid_only: bool = False, ndim: int = 3,
) -> DataFrame:
    """Smallest distance over time of each agent to a set of target agents.

    `to="ego"` gives one row per agent; otherwise `targets` (scenario_id, agent_idx) lists the agents to measure to and
    each (agent, target) gets a row. Steps an agent has no row for sit at the origin, as in dense padded tracks, unless
    `valid_only` restricts the measure to shared valid steps.
    """
    goal = (
        scenarios.select("scenario_id", F.col("ego_idx").alias("agent_idx")) if to == "ego"
        else targets.select(*KEY).distinct()
    )
    pts = valid_points(points) if valid_only else points
    sizes = scenarios.select("scenario_id", "n_steps")

    def pack(rows: DataFrame) -> DataFrame:
        packed = rows.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("t", "x", "y", "z"))).alias("_seen"))
        kind = packed.schema["_seen"].dataType.elementType.simpleString()
        null = F.lit(None).cast(kind)
        hole = null if valid_only else F.struct(F.lit(None).cast("int").alias("t"), *[
            F.lit(0.0).alias(c) for c in ("x", "y", "z")]).cast(kind)
        steps = by_step("_seen", hole)
        if valid_only:
            return packed.select(*KEY, steps.alias("steps"))
        return packed.join(sizes.hint("merge"), "scenario_id").withColumn("_steps", steps).select(*KEY, F.concat(
            "_steps", F.array_repeat(hole, F.col("n_steps") - F.size("_steps"))).alias("steps"))

    # The targets' rows are picked before packing, so that only they travel to the other side of the join: by sort-merge, as for all that
    # grows with the scenes.
    aim = pack(pts.join(goal.hint("merge"), KEY, "left_semi")).select(
        "scenario_id", F.col("agent_idx").alias("target_idx"), F.col("steps").alias("goal"))
    near = F.filter(F.zip_with("steps", "goal", lambda p, q: X.norm3(
        p["x"] - q["x"], p["y"] - q["y"], p["z"] - q["z"])), lambda d: d.isNotNull() & ~F.isnan(d))
    return pack(pts).join(aim.hint("merge"), "scenario_id").select(
        *KEY, "target_idx", F.coalesce(F.array_min(near), X.lit_d(X.INF)).alias("distance"))
