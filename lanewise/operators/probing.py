"""Constant-velocity counterfactual probes for all scenarios and agents at once.

The points are packed once: a row per agent holds its track, its place at every step and, as the probe's change, the track it would
have had. Ego pairs are then measured three times within a row, as they were, with the other agent altered and with the ego altered; scores
before and after, distances for the weights and critical frames all come from these rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions import expr as X
from lanewise.operators import pairs as P
from lanewise.operators.individual import valid_points
from lanewise.operators.limits import attach
from lanewise.operators.scoring import agent_weights, distance_weight, pair_scores, scene_score_from_pairs
from lanewise.schema import MIN_VALID, Limits, ScoreConfig
from lanewise.session import materialize

KEY = ["scenario_id", "agent_idx"]
PROBE = ["scenario_id", "probed"]
STILL = 1e-4
#: Digits to which increases and critical values are compared, so that equal ones stay equal whatever the order of their sums.
DIGITS = 9


def constant_velocity(points: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Point rows of every probed agent: observed up to the current step, straight extrapolation after it.

    Agents without a valid observed step, or standing still in both axes, have no probe.
    """
    s = scenarios.select("scenario_id", "current_time_index", "frequency_hz", "n_steps")
    past = valid_points(points).join(s, "scenario_id").filter(F.col("t") <= F.col("current_time_index"))
    last = past.groupBy(*KEY).agg(
        F.max(F.struct("t", "x", "y", "z", "heading", "vx", "vy", "agent_type")).alias("r"),
        F.first("current_time_index").alias("now"), F.first("frequency_hz").alias("hz"), F.first("n_steps").alias("n"))
    moving = (F.abs(F.col("r.vx")) >= STILL) | (F.abs(F.col("r.vy")) >= STILL)
    ref = last.filter(moving)
    future = ref.filter(F.col("n") - 1 > F.col("now")).withColumn(
        "t", F.explode(F.sequence(F.col("now") + 1, F.col("n") - 1)))
    ahead = (F.col("t") - F.col("r.t")).cast("double") / F.col("hz")
    boxes = points.select(*KEY, "t", "length")
    fut = future.join(boxes, [*KEY, "t"], "left").select(
        *KEY, F.col("r.agent_type").alias("agent_type"), "t",
        (F.col("r.x") + ahead * F.col("r.vx")).alias("x"), (F.col("r.y") + ahead * F.col("r.vy")).alias("y"),
        F.col("r.z").alias("z"), F.coalesce("length", F.lit(0.0)).alias("length"), F.col("r.heading").alias("heading"),
        F.col("r.vx").alias("vx"), F.col("r.vy").alias("vy"), F.lit(True).alias("valid"))
    seen = points.join(ref.select(*KEY, "now"), KEY).filter(F.col("t") <= F.col("now"))
    return seen.select(fut.columns).unionByName(fut)


def splice_constant_velocity(tracks: DataFrame) -> DataFrame:
    """Adds `altered` and `altered_place` to packed tracks: as observed up to the current step, then straight on; null without a probe.

    The same rows as :func:`constant_velocity`, as a new tail of the packed track.
    """
    r, now = F.col("ref"), F.col("now")
    moving = (F.abs(r["vx"]) >= STILL) | (F.abs(r["vy"]) >= STILL)
    kind = tracks.schema["steps"].dataType.simpleString()
    ahead = lambda t: (t - r["t"]).cast("double") / F.col("hz")
    tail = F.transform(F.sequence(now + 1, F.col("n") - 1), lambda t: F.struct(
        t.alias("t"), (r["x"] + ahead(t) * r["vx"]).alias("x"), (r["y"] + ahead(t) * r["vy"]).alias("y"), r["z"].alias("z"),
        P.pair_speed(r["vx"], r["vy"]).alias("v"), F.degrees(r["heading"]).alias("h"), F.coalesce(F.get("lengths", t), F.lit(0.0)).alias("len")))
    tail = F.when(F.col("n") - 1 > now, tail).otherwise(F.array()).cast(kind)
    hole = F.lit(None).cast(tracks.schema["steps"].dataType.elementType.simpleString())
    df = tracks.withColumn("_tail", F.when(moving, tail))
    seen = F.slice("steps", 1, now + 1)
    altered = F.concat(seen, F.array_repeat(hole, now + 1 - F.size(seen)), "_tail")
    place = F.concat(F.slice("place", 1, now + 1), F.transform("_tail", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), s["z"].alias("z"))))
    return df.withColumns({"altered": F.when(F.col("_tail").isNotNull(), altered), "altered_place": F.when(F.col("_tail").isNotNull(), place)}).drop("_tail")


# name -> function that adds `altered` and `altered_place` to packed tracks; users may add their own.
PROBES: dict[str, Callable[[DataFrame], DataFrame]] = {"CONSTANT_VELOCITY": splice_constant_velocity}


def probe_tracks(points: DataFrame, scenarios: DataFrame, probe: str = "CONSTANT_VELOCITY") -> DataFrame:
    """One row per agent: agent_type, ego_idx, steps, place (struct(x, y, z) of every step, the origin where it has no row), and the altered ones."""
    s = scenarios.select("scenario_id", "ego_idx", F.col("current_time_index").alias("now"), F.col("frequency_hz").alias("hz"), F.col("n_steps").alias("n"))
    ok = X.is_valid(F.col("valid"))
    last = F.struct("t", "x", "y", "z", "heading", "vx", "vy")
    own = points.select(*KEY, "t", "agent_type", "x", "y", "z", "length", "heading", "vx", "vy", "valid")
    rows = own.join(s, "scenario_id").groupBy(*KEY).agg(
        F.first("agent_type").alias("agent_type"), *[F.first(c).alias(c) for c in ("ego_idx", "now", "hz", "n")],
        F.sort_array(F.collect_list(F.when(ok, P.packed_step()))).alias("_seen"), F.max(F.when(ok & (F.col("t") <= F.col("now")), last)).alias("ref"),
        F.sort_array(F.collect_list(F.struct("t", "x", "y", "z", "length"))).alias("_all"))
    every, seen = (rows.schema[c].dataType.elementType.simpleString() for c in ("_all", "_seen"))
    origin = F.struct(F.lit(None).cast("int").alias("t"), *[F.lit(0.0).alias(c) for c in ("x", "y", "z", "length")]).cast(every)
    rows = rows.withColumns({
        "steps": P.by_step("_seen", F.lit(None).cast(seen)), "_all": P.by_step("_all", origin)})
    rows = rows.withColumn("_all", F.concat("_all", F.array_repeat(origin, F.col("n") - F.size("_all"))))
    rows = rows.withColumns({"place": F.transform("_all", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"))),
                             "lengths": F.transform("_all", lambda p: p["length"])}).drop("_all", "_seen")
    return PROBES[probe](rows).select(*KEY, "agent_type", "ego_idx", "steps", "place", "altered", "altered_place")


def max_delta(candidates: DataFrame) -> DataFrame:
    """The probe with the greatest pair-score increase per scene; of those equal to DIGITS digits the later agent wins."""
    best = candidates.groupBy("scenario_id").agg(F.max(F.struct(F.round("delta", DIGITS).alias("increase"), "probed", "delta")).alias("b"))
    return best.select("scenario_id", F.col("b.probed").alias("probed"), F.col("b.delta").alias("delta"))


VALIDATORS: dict[str, Callable[[DataFrame], DataFrame]] = {"MAX_SCORE_DELTA": max_delta}


def baseline_pair_scores(pairs: DataFrame, cfg: ScoreConfig, skip_types: Sequence[int] = ()) -> DataFrame:
    if skip_types:
        pairs = pairs.filter(~F.col("type_i").isin(*skip_types) & ~F.col("type_j").isin(*skip_types))
    return pair_scores(pairs, cfg, finite=True).select("scenario_id", "i", "j", "pair_score")


def probe_pairs(agents: DataFrame, altered: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(scenario_id, probed, i, j): every pair of a probed ego, and the ego pair of any other probed agent."""
    ego = scenarios.select("scenario_id", "ego_idx")
    ids = altered.select(*KEY).distinct().join(ego, "scenario_id")
    others = ids.filter(F.col("agent_idx") != F.col("ego_idx")).select(
        "scenario_id", F.col("agent_idx").alias("probed"), F.col("ego_idx").alias("other"))
    mine = ids.filter(F.col("agent_idx") == F.col("ego_idx")).select("scenario_id", F.col("agent_idx").alias("probed"))
    egos = mine.join(agents.select("scenario_id", F.col("agent_idx").alias("other")), "scenario_id").filter(
        F.col("other") != F.col("probed"))
    return others.unionByName(egos).select(
        *PROBE, F.least("probed", "other").alias("i"), F.greatest("probed", "other").alias("j"))


def probe_pair_rows(tracks: DataFrame, *, original: bool = True) -> DataFrame:
    """Ego pairs as they were (`probed` null, unless switched off) and once with either agent altered, where it has a probe.

    Columns scenario_id, probed, other, agent_idx (the one that isn't the ego), i, j, types, steps_i, steps_j, probe_steps, other_steps and
    the closest distance of the two. At most 3(n-1) rows per scene of n agents, dealt out by agent.
    """
    names = ("agent_type", "steps", "place", "altered", "altered_place")
    ego = tracks.filter(F.col("agent_idx") == F.col("ego_idx")).select("scenario_id", *[F.col(c).alias(f"e_{c}") for c in names])
    # Dealt anew by pair: the join leaves a whole scene in one task, and all the arithmetic of its pairs is still to come.
    both = tracks.filter(F.col("agent_idx") != F.col("ego_idx")).join(ego, "scenario_id").repartition(*KEY)

    def variant(probed, other, own, ego_, when=None):
        side = lambda c, e: F.col(f"{'e_' if e else ''}{c}")
        v = F.struct(probed.alias("probed"), other.alias("other"), side("altered" if own else "steps", False).alias("own"),
                     side("altered" if ego_ else "steps", True).alias("ego"), side("altered_place" if own else "place", False).alias("place"),
                     side("altered_place" if ego_ else "place", True).alias("ego_place"))
        return v if when is None else F.when(when.isNotNull(), v)

    agent, mine, none = F.col("agent_idx"), F.col("ego_idx"), F.lit(None).cast("long")
    ways = [variant(none, none, False, False)] * original + [
        variant(agent, mine, True, False, F.col("altered")), variant(mine, agent, False, True, F.col("e_altered"))]
    rows = both.select(*KEY, "ego_idx", "agent_type", "e_agent_type", F.explode(F.array(*ways)).alias("v")).filter(F.col("v").isNotNull()).select(
        *KEY, "ego_idx", "agent_type", "e_agent_type", "v.*")
    gap = F.filter(F.zip_with("place", "ego_place", lambda p, q: X.norm3(p["x"] - q["x"], p["y"] - q["y"], p["z"] - q["z"])),
                   lambda d: d.isNotNull() & ~F.isnan(d))
    first = mine < agent
    of = lambda a, b: (F.when(first, F.col(a)).otherwise(F.col(b)), F.when(first, F.col(b)).otherwise(F.col(a)))
    (ti, tj), (si, sj) = of("e_agent_type", "agent_type"), of("ego", "own")
    probes_ego = F.col("probed") == mine
    return rows.select(
        "scenario_id", "probed", "other", "agent_idx", F.least(agent, mine).alias("i"), F.greatest(agent, mine).alias("j"),
        ti.alias("type_i"), tj.alias("type_j"), si.alias("steps_i"), sj.alias("steps_j"),
        F.when(probes_ego, F.col("ego")).otherwise(F.col("own")).alias("probe_steps"),
        F.when(probes_ego, F.col("own")).otherwise(F.col("ego")).alias("other_steps"),
        F.coalesce(F.array_min(gap), X.lit_d(X.INF)).alias("distance"))


def measured_pairs(rows: DataFrame, scenarios: DataFrame, *, criterion: str = "critical", limits: Limits | None = None) -> DataFrame:
    """Metrics of the rows of :func:`probe_pair_rows`; only pairs as they were are subject to the range filter."""
    rows, lim = attach(rows.drop("probe_steps", "other_steps"), scenarios, limits=limits)
    return P.pair_metrics(rows, [*PROBE, "i", "j"], lim, criterion=criterion, prefilter=F.col("probed").isNull(), carry=("other", "agent_idx", "distance"))


def without_types(df: DataFrame, skip_types: Sequence[int]) -> DataFrame:
    return df.filter(~F.col("type_i").isin(*skip_types) & ~F.col("type_j").isin(*skip_types)) if skip_types else df


def critical_frames(df: DataFrame, lim: dict[str, Column], out: str = "crit") -> DataFrame:
    """Adds struct(metric, t): the worst future frame of two agents, or null.

    Least time to collision if any is finite, else greatest positive required deceleration, on aligned frames of pairs
    that come within range (XY); of values equal to DIGITS digits the first. Needs `probe_steps`, `other_steps` and `current_time_index`.
    """
    shared = P.shared_steps(F.col("probe_steps"), F.col("other_steps"))

    def measure(s):
        a, b = s["a"], s["b"]
        xy = X.norm2(a["x"] - b["x"], a["y"] - b["y"])
        lead = X.i_leads(a["x"], a["y"], a["h"], b["x"], b["y"])
        gap, _, closing = X.gap_and_closing(xy, a["len"], b["len"], a["v"], b["v"], lead)
        return F.struct(
            xy.alias("xy"), (F.abs(X.wrap_degrees(b["h"] - a["h"])) <= lim["heading_threshold"]).alias("aligned"),
            X.time_to_collision(gap, closing).alias("ttc"),
            X.required_deceleration(gap, closing, lim["agent_max_deceleration"]).alias("drac"), a["t"].alias("t"))

    def worst(name, keep, sign):
        vals = F.transform(F.filter("_aligned", keep), lambda f: F.struct((F.round(f[name], DIGITS) * sign).alias("v"), f["t"].alias("t")))
        return F.array_min(vals)["t"]

    df = df.withColumn("_ahead", F.filter(shared, lambda s: s["a"]["t"] >= F.col("current_time_index")))
    df = df.withColumn("_frames", F.transform("_ahead", measure))
    df = df.withColumn("_aligned", F.filter("_frames", lambda f: f["aligned"]))
    near = F.exists("_frames", lambda f: f["xy"] <= lim["agent_to_agent_max_distance"])
    df = df.withColumns({
        "_ok": (F.size("_frames") >= MIN_VALID) & near & (F.size("_aligned") >= MIN_VALID),
        "_ttc": worst("ttc", lambda f: f["ttc"] < X.INF, 1.0), "_drac": worst("drac", lambda f: f["drac"] > 0, -1.0)})
    return df.withColumn(out, F.when(
        F.col("_ok") & F.col("_ttc").isNotNull(), F.struct(F.lit("TTC").alias("metric"), F.col("_ttc").alias("t"))).when(
        F.col("_ok") & F.col("_drac").isNotNull(), F.struct(F.lit("DRAC").alias("metric"), F.col("_drac").alias("t")))
    ).drop("_ahead", "_frames", "_aligned", "_ok", "_ttc", "_drac")


def probe_deltas(after: DataFrame, baseline: DataFrame) -> DataFrame:
    """Score change of every recomputed, scored pair: (.., before, after, delta). Absent before counts as 0."""
    before = baseline.select("scenario_id", "i", "j", F.col("pair_score").alias("before"))
    return after.join(before, ["scenario_id", "i", "j"], "left").withColumn(
        "before", F.coalesce("before", F.lit(0.0))).withColumn("delta", F.col("pair_score") - F.col("before"))


def candidates(deltas: DataFrame, min_delta: float) -> DataFrame:
    """Probes that raise at least one pair by `min_delta`, with their greatest increase."""
    return deltas.groupBy(*PROBE).agg(
        F.greatest(F.max("delta"), F.lit(0.0)).alias("delta"), F.max("delta").alias("_top")
    ).filter(F.round("_top", DIGITS) >= min_delta).drop("_top")


def probe_weights(weights: DataFrame, winners: DataFrame, measured: DataFrame, agents: DataFrame, cfg: ScoreConfig) -> DataFrame:
    """(scenario_id, probed, agent_idx, weight) after the winning probe; the distances it changed are those of its measured pairs."""
    base = weights.join(winners.select(*PROBE), "scenario_id")
    if cfg.weighting != "ego_distance":
        return base.select(*PROBE, "agent_idx", "weight")
    changed = measured.join(winners.select(*PROBE), PROBE, "left_semi").select(*PROBE, "agent_idx", "distance")
    df = base.join(changed, [*PROBE, "agent_idx"], "left").join(agents.select(*KEY, "agent_type"), KEY)
    new = distance_weight(F.col("distance"), F.col("agent_type"), cfg)
    return df.select(*PROBE, "agent_idx", F.when(F.col("distance").isNotNull(), new).otherwise(F.col("weight")).alias(
        "weight"))


def find_probes(
    points: DataFrame, agents: DataFrame, scenarios: DataFrame, cfg: ScoreConfig, *, min_delta: float = 1.0,
    probe: str = "CONSTANT_VELOCITY", validator: str = "MAX_SCORE_DELTA", criterion: str = "critical",
    single_affected: bool = True, skip_types: Sequence[int] = (), limits: Limits | None = None, stage=None,
) -> DataFrame:
    """At most one row per scene: the most critical probe with scores before and after and the affected agents.

    `stage(df, name)` writes a table that is read more than once (packed tracks, measured pairs, winners) and returns it
    read back; by default into the shared folder of the session.
    """
    stage = stage or materialize
    ego_scope = cfg.weighting == "ego_distance"
    tracks = stage(probe_tracks(points, scenarios, probe), "probe-tracks")
    if skip_types:
        keep = ~F.col("agent_type").isin(*skip_types)
        tracks = tracks.withColumns({c: F.when(keep, F.col(c)) for c in ("altered", "altered_place")})
    rows = probe_pair_rows(tracks, original=ego_scope)
    measured = stage(measured_pairs(rows, scenarios, criterion=criterion, limits=limits), "probe-pairs")
    if ego_scope:
        base, near = (measured.filter(F.col("probed").isNull()) for _ in range(2))
        weights = agent_weights(agents, scenarios, cfg, ego_distances=near.select(*KEY, "distance"))
    else:
        base = P.pair_features(points, scenarios, scope="all", criterion=criterion, limits=limits)
        weights = agent_weights(agents, scenarios, cfg, points=points)
    baseline = stage(baseline_pair_scores(base, cfg, skip_types), "baseline")
    altered = without_types(measured.filter(F.col("probed").isNotNull()), skip_types)
    after = pair_scores(altered, cfg).select(*PROBE, "other", "i", "j", "pair_score")
    deltas = stage(probe_deltas(after, baseline), "deltas")
    winners = stage(VALIDATORS[validator](candidates(deltas, min_delta)), "winners")

    hit = deltas.join(winners.select(*PROBE), PROBE, "left_semi").filter(F.round("delta", DIGITS) >= min_delta)
    # Only the pairs of the winning probe that changed enough are searched for their critical frame.
    ends = tracks.join(hit.select("scenario_id", F.explode(F.array("i", "j")).alias("agent_idx")), KEY, "left_semi")
    found_rows, lim = attach(probe_pair_rows(ends, original=False), scenarios, ("current_time_index",), limits=limits)
    found = hit.join(critical_frames(found_rows, lim).select(*PROBE, "other", "crit"), [*PROBE, "other"]).filter(
        F.col("crit").isNotNull())
    entry = F.struct(
        (F.col("crit.metric") == "DRAC").cast("int").alias("rank"), F.col("crit.t").alias("t"), "other",
        F.col("crit.metric").alias("metric"), F.col("before"), F.col("pair_score").alias("after"))
    affected = found.groupBy(*PROBE).agg(
        F.array(F.min(entry)).alias("affected") if single_affected
        else F.sort_array(F.collect_list(entry)).alias("affected"))

    won = after.join(winners.select(*PROBE), PROBE, "left_semi").select(*PROBE, "i", "j", F.col("pair_score").alias("new"))
    old = baseline.join(winners.select(*PROBE), "scenario_id").select(*PROBE, "i", "j", F.col("pair_score").alias("old"))
    merged = old.join(won, [*PROBE, "i", "j"], "full_outer").select(
        *PROBE, "i", "j", F.coalesce("new", "old").alias("pair_score"))
    w_after = probe_weights(weights, winners, measured, agents, cfg)
    score_after = scene_score_from_pairs(merged, w_after, cfg, tuple(PROBE)).withColumnRenamed(
        "scene_score", "score_after")
    w_before = weights.join(winners.select("scenario_id"), "scenario_id", "left_semi")
    score_before = scene_score_from_pairs(
        baseline.join(winners.select("scenario_id"), "scenario_id", "left_semi"), w_before, cfg
    ).withColumnRenamed("scene_score", "score_before")
    ego = scenarios.select("scenario_id", "ego_idx")
    return (
        affected.join(score_after, PROBE).join(score_before, "scenario_id").join(ego, "scenario_id")
        .select("scenario_id", F.lit(probe).alias("probe_type"), F.col("probed").alias("probed_agent"),
                (F.col("probed") == F.col("ego_idx")).alias("is_ego"), "score_before", "score_after", "affected")
    )


def probe_summary(probes: DataFrame, scenarios: DataFrame, agents: DataFrame) -> DataFrame:
    """One text row per scene with fixed columns; scenes without a probe say so. Agents go by their ids, in the order of `affected`."""
    ids = agents.select("scenario_id", "agent_idx", F.col("agent_id").cast("string").alias("agent_id"))
    others = (
        probes.select("scenario_id", F.posexplode("affected").alias("n", "a")).select("scenario_id", "n", F.col("a.other").alias("agent_idx"))
        .join(ids, ["scenario_id", "agent_idx"]).groupBy("scenario_id")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "agent_id"))), lambda x: x["agent_id"]).alias("affected_ids")))
    probed = ids.select("scenario_id", F.col("agent_idx").alias("probed_agent"), F.col("agent_id").alias("probed_id"))
    df = scenarios.select("scenario_id").join(probes, "scenario_id", "left").join(
        probed, ["scenario_id", "probed_agent"], "left").join(others, "scenario_id", "left")
    found = F.col("probed_agent").isNotNull()
    num = lambda c: F.when(found, F.format_string("%.6f", c)).otherwise("")
    return df.select(
        F.col("scenario_id").cast("string").alias("scenario_id"),
        F.when(found, "yes").otherwise("no").alias("probe_found"),
        F.coalesce("probe_type", F.lit("N/A")).alias("probe_type"),
        F.when(~found, "N/A").when(F.col("is_ego"), "yes").otherwise("no").alias("is_ego_agent"),
        F.coalesce("probed_id", F.lit("")).alias("probed_agent_id"),
        num(F.col("score_before")).alias("score_before"), num(F.col("score_after")).alias("score_after"),
        num(F.col("score_after") - F.col("score_before")).alias("score_delta"),
        F.coalesce(F.array_join("affected_ids", ";"), F.lit("")).alias("affected_agent_ids"))


def probe_records(probes: DataFrame, agents: DataFrame) -> DataFrame:
    """One record per probe, without the altered track, agents by their ids: what is stored as JSON.

    `criticality_results` has the worst frame of each affected agent; the pair scores go by both ids, the smaller first. For the track
    see :func:`altered_points`.
    """
    ids = agents.select("scenario_id", "agent_idx", "agent_id")
    named = probes.join(ids.withColumnsRenamed({"agent_idx": "probed_agent", "agent_id": "probed_agent_id"}), ["scenario_id", "probed_agent"])
    each = named.select("scenario_id", "probed_agent_id", F.posexplode("affected").alias("n", "a")).withColumn("agent_idx", F.col("a.other")).join(
        ids, ["scenario_id", "agent_idx"])
    pair = F.concat_ws(":", F.least("probed_agent_id", "agent_id"), F.greatest("probed_agent_id", "agent_id"))
    row = F.struct("n", "agent_id", F.col("a.metric").alias("metric"), F.col("a.t").alias("timestamp"), pair.alias("pair"),
                   F.col("a.before").alias("before"), F.col("a.after").alias("after"))
    found = each.groupBy("scenario_id").agg(F.sort_array(F.collect_list(row)).alias("r"))

    def entries(key, value):
        return F.map_from_entries(F.transform("r", lambda x: F.struct(x[key].cast("string"), value(x))))

    return named.join(found, "scenario_id").select(
        "scenario_id", "probed_agent_id", F.col("is_ego").alias("is_ego_agent"), "probe_type", F.transform("r", lambda x: x["agent_id"]).alias("affected_agent_ids"),
        entries("agent_id", lambda x: F.struct(x["timestamp"].alias("timestamp"), x["metric"].alias("metric"))).alias("criticality_results"),
        "score_before", "score_after", entries("pair", lambda x: x["before"]).alias("affected_pair_scores_before"),
        entries("pair", lambda x: x["after"]).alias("affected_pair_scores_after"))


def altered_points(probes: DataFrame, points: DataFrame, scenarios: DataFrame) -> DataFrame:
    """The altered track of every probe as point rows; only the probed agents' points are looked at."""
    mine = points.join(probes.select("scenario_id", F.col("probed_agent").alias("agent_idx")), KEY, "left_semi")
    return constant_velocity(mine, scenarios)
