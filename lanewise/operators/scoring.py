"""Weights, agent scores and scene scores.

Every side of a join here has a row per scene or agent, in few bytes: the joins ask for sort-merge, as Spark would send all of them through
the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions import expr as X
from lanewise.operators.pairs import closest_agent_distances
from lanewise.schema import EPS, SCORED_STATUSES, TRACK_SHAPE_WEIGHTS, AgentType, ScoreConfig

KEY = ["scenario_id", "agent_idx"]


def simple_individual(cfg: ScoreConfig) -> Column:
    """Weighted sum of capped features plus the manoeuvre weight. A NaN or missing jerk counts as the cap."""
    w, c = cfg.weights, cfg.caps
    gap = F.col("speed_limit_diff")
    total = F.when(gap.isNull() | F.isnan(gap), 0.0).otherwise(
        F.lit(w.speed_limit_diff) * F.least(X.lit_d(c.speed_limit_diff), gap))
    values = {
        "speed": F.col("speed"), "acceleration": F.col("acceleration"), "deceleration": F.col("deceleration"),
        "jerk": F.coalesce("jerk", X.lit_d(X.NAN)), "waiting_period": F.col("waiting_period"),
        "kalman_difficulty": F.greatest(F.col("kalman_difficulty"), X.lit_d(0.0)),
    }
    for name, v in values.items():
        total = total + F.lit(getattr(w, name)) * F.least(X.lit_d(getattr(c, name)), v)
    return total + F.lit(w.trajectory_type) * X.case_map(F.col("trajectory_type"), {
        int(k): v for k, v in TRACK_SHAPE_WEIGHTS.items()})


def simple_pair(cfg: ScoreConfig) -> Column:
    w, c = cfg.weights, cfg.caps
    total = F.lit(w.collision) * F.least(X.lit_d(c.collision), F.col("collision"))
    for m in ("mttcp", "thw", "ttc"):
        cap = 1.0 / (getattr(c, m) + EPS)
        total = total + F.lit(getattr(w, m)) * F.least(X.lit_d(cap), F.col(f"inv_{m}"))
    return total + F.lit(w.drac) * F.least(X.lit_d(c.drac), F.col("drac"))


# name -> builder of a score column from a config; users may add their own.
INDIVIDUAL_FUNCTIONS: dict[str, Callable[[ScoreConfig], Column]] = {"simple": simple_individual}
PAIR_FUNCTIONS: dict[str, Callable[[ScoreConfig], Column]] = {"simple": simple_pair}


def distance_weight(distance: Column, agent_type: Column, cfg: ScoreConfig) -> Column:
    """Capped inverse (root) distance, raised for cyclists and pedestrians."""
    d = distance + EPS
    if cfg.sqrt_distance:
        d = F.sqrt(d)
    base = F.least(1.0 / d, X.lit_d(1.0 / max(cfg.max_critical_distance, EPS)))
    vru = agent_type.isin(int(AgentType.CYCLIST), int(AgentType.PEDESTRIAN))
    return F.when(vru, base * cfg.vru_weight).otherwise(base)


def agent_weights(
    agents: DataFrame, scenarios: DataFrame, cfg: ScoreConfig, *, points: DataFrame | None = None,
    ego_distances: DataFrame | None = None, relevant_distances: DataFrame | None = None,
) -> DataFrame:
    """(scenario_id, agent_idx, weight). `agents` has agent_type and, where known, relevance.

    Distances may be passed in (from stored features) or are measured from `points`.
    """
    has_rel = "relevance" in agents.columns
    rel = F.col("relevance") if has_rel else F.lit(None).cast("double")
    size = agents.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n_agents"))
    df = agents.select(*KEY, "agent_type", rel.alias("relevance")).join(size.hint("merge"), "scenario_id").join(
        scenarios.select("scenario_id", "ego_idx").hint("merge"), "scenario_id")
    alone = F.coalesce("relevance", F.lit(1.0))
    is_ego = F.col("agent_idx") == F.col("ego_idx")
    if cfg.weighting == "uniform":
        weight = F.lit(1.0)
    elif cfg.weighting == "ego_distance":
        dist = closest_agent_distances(points, scenarios) if ego_distances is None else ego_distances
        df = df.join(dist.select(*KEY, "distance").hint("merge"), KEY, "left")
        weight = F.when(is_ego, 1.0).otherwise(
            distance_weight(F.coalesce("distance", X.lit_d(X.INF)), F.col("agent_type"), cfg))
    elif cfg.weighting == "relevant_distance":
        wanted = agents.filter(rel > 0).select(*KEY, rel.alias("target_relevance"))
        if relevant_distances is None:
            relevant_distances = closest_agent_distances(points, scenarios, to="relevant", targets=wanted)
        seen = relevant_distances.join(
            wanted.select("scenario_id", F.col("agent_idx").alias("target_idx"), "target_relevance").hint("merge"),
            ["scenario_id", "target_idx"])
        best = seen.groupBy(*KEY).agg(
            F.min(F.struct("distance", "target_idx", "target_relevance")).alias("best"))
        df = df.join(best.hint("merge"), KEY, "left")
        weight = (
            F.when(F.col("best").isNull(), 1.0).when(is_ego, 1.0)
            .otherwise(F.col("best.target_relevance") * distance_weight(
                F.col("best.distance"), F.col("agent_type"), cfg))
        )
    else:
        raise ValueError(f"unknown weighting {cfg.weighting!r}")
    return df.select(*KEY, F.when(F.col("n_agents") == 1, alone).otherwise(weight).alias("weight"))


def _clip(v: Column, cfg: ScoreConfig) -> Column:
    return F.least(F.greatest(v, X.lit_d(cfg.clip[0])), X.lit_d(cfg.clip[1]))


def _cut_array(thresholds) -> Column:
    return F.array(*[X.lit_d(v) for v in thresholds])


def _no_nan(v: Column) -> Column:
    return F.coalesce(F.nanvl(v, X.lit_d(0.0)), F.lit(0.0))


def individual_scores(features: DataFrame, weights: DataFrame, cfg: ScoreConfig, *, thresholds=None) -> DataFrame:
    """(scenario_id, agent_idx, score, valid) for every weighted agent; unusable agents score 0."""
    value = F.col("weight") * INDIVIDUAL_FUNCTIONS[cfg.individual_function](cfg)
    if thresholds is not None:
        value = X.category(value, _cut_array(thresholds))
    scored = features.join(weights.hint("merge"), KEY).select(*KEY, _no_nan(value).alias("score"))
    return weights.select(*KEY).join(scored.hint("merge"), KEY, "left").select(
        *KEY, F.coalesce("score", F.lit(0.0)).alias("score"), F.col("score").isNotNull().alias("valid"))


def scene_scores(agent_scores: DataFrame, cfg: ScoreConfig) -> DataFrame:
    """Sum over all agents divided by the number of valid ones, clipped."""
    n = F.greatest(F.count(F.when(F.col("valid"), 1)), F.lit(1))
    return agent_scores.groupBy("scenario_id").agg(_clip(F.sum("score") / n, cfg).alias("scene_score"))


def pair_scores(pairs: DataFrame, cfg: ScoreConfig, *, finite: bool = False) -> DataFrame:
    """(scenario_id, i, j, pair_score) of computed pairs; with `finite`, non-finite features count as 0."""
    df = pairs.filter(F.col("status").isin(*SCORED_STATUSES))
    if finite:
        for c in ("collision", "inv_mttcp", "inv_thw", "inv_ttc", "drac"):
            v = F.col(c)
            df = df.withColumn(c, F.when(v.isNull() | F.isnan(v) | (F.abs(v) == X.INF), 0.0).otherwise(v))
    return df.withColumn("pair_score", PAIR_FUNCTIONS[cfg.pair_function](cfg))


def spread_pair_scores(scores: DataFrame, weights: DataFrame, cfg: ScoreConfig, *, thresholds=None,
                       keys: tuple[str, ...] = ("scenario_id",)) -> DataFrame:
    """Give each pair score, weighted per agent, to both agents. Agents in no scored pair get 0 and stay not valid."""
    ends = scores.select(*keys, F.explode(F.array("i", "j")).alias("agent_idx"), "pair_score")
    sums = ends.groupBy(*keys, "agent_idx").agg(F.sum("pair_score").alias("_sum"))
    out = weights.join(sums.hint("merge"), [*keys, "agent_idx"], "left")
    score = F.coalesce(F.col("weight") * F.col("_sum"), F.lit(0.0))
    if thresholds is not None:
        score = X.category(score, _cut_array(thresholds))
    return out.select(*keys, "agent_idx", _no_nan(score).alias("score"), F.col("_sum").isNotNull().alias("valid"))


def paired_scenes(weights: DataFrame) -> DataFrame:
    """Scenes with two agents or more: only these have an interaction half."""
    return weights.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("scenario_id")


def interaction_scores(
    pairs: DataFrame, weights: DataFrame, cfg: ScoreConfig, scenarios: DataFrame, *, thresholds=None
) -> DataFrame:
    """(scenario_id, agent_idx, score, valid); ego weighting counts ego pairs only. A scene of one agent has no rows."""
    scores = pair_scores(pairs, cfg)
    weights = weights.join(paired_scenes(weights).hint("merge"), "scenario_id", "left_semi")
    if cfg.weighting == "ego_distance":
        scores = scores.join(scenarios.select("scenario_id", "ego_idx").hint("merge"), "scenario_id").filter(
            (F.col("i") == F.col("ego_idx")) | (F.col("j") == F.col("ego_idx")))
    return spread_pair_scores(scores, weights, cfg, thresholds=thresholds)


def scene_score_from_pairs(scores: DataFrame, weights: DataFrame, cfg: ScoreConfig,
                           keys: tuple[str, ...] = ("scenario_id",)) -> DataFrame:
    """Scene score from stored pair scores: (keys, i, j, pair_score) and (keys, agent_idx, weight)."""
    agents = spread_pair_scores(scores, weights, cfg, keys=keys)
    n = F.greatest(F.count(F.when(F.col("valid"), 1)), F.lit(1))
    return agents.groupBy(*keys).agg(_clip(F.sum("score") / n, cfg).alias("scene_score"))


def combined_scores(individual: DataFrame, interaction: DataFrame) -> DataFrame:
    """Agent scores add up; an agent is valid when either half is, unknown when a half is missing."""
    a = individual.select(*KEY, F.col("score").alias("a"), F.col("valid").alias("va"))
    b = interaction.select(*KEY, F.col("score").alias("b"), F.col("valid").alias("vb"))
    return a.join(b.hint("merge"), KEY, "full_outer").select(
        *KEY, (F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("score"),
        F.when(F.col("va").isNotNull() & F.col("vb").isNotNull(), F.col("va") | F.col("vb")).alias("valid"))


def combined_scene_scores(individual: DataFrame, interaction: DataFrame, cfg: ScoreConfig) -> DataFrame:
    a = individual.select("scenario_id", F.col("scene_score").alias("a"))
    b = interaction.select("scenario_id", F.col("scene_score").alias("b"))
    total = F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))
    return a.join(b.hint("merge"), "scenario_id", "full_outer").select(
        "scenario_id", _clip(F.lit(cfg.combine_weight) * total, cfg).alias("scene_score"))


def score_category(scores: DataFrame, thresholds, column: str = "score") -> DataFrame:
    """Category of each score; a missing score has none."""
    return scores.withColumn("category", F.when(F.col(column).isNotNull(), X.category(F.col(column), _cut_array(thresholds))))


def agent_scores(
    weights: DataFrame, individual: DataFrame, pairs: DataFrame, cfg: ScoreConfig, scenarios: DataFrame, *,
    thresholds: dict | None = None,
) -> DataFrame:
    """All three scorers in one pass, long form: (scenario_id, agent_idx, scorer, score, valid).

    Where a scene has no interaction half its interaction score is null, and so is the validity of both it and the combined
    score, which is then the individual one.
    """
    cuts = thresholds or {}
    ind = F.col("weight") * INDIVIDUAL_FUNCTIONS[cfg.individual_function](cfg)
    if cuts.get("individual") is not None:
        ind = X.category(ind, _cut_array(cuts["individual"]))
    feats = individual.drop("agent_type", "n_valid").withColumn("_seen", F.lit(True))
    inter = interaction_scores(pairs, weights, cfg, scenarios, thresholds=cuts.get("interaction")).select(
        *KEY, F.col("score").alias("_int"), F.col("valid").alias("_iv"))
    wide = weights.join(feats.hint("merge"), KEY, "left").join(inter.hint("merge"), KEY, "left").select(
        *KEY, F.when(F.col("_seen"), _no_nan(ind)).otherwise(0.0).alias("a"),
        F.coalesce("_seen", F.lit(False)).alias("va"), F.col("_int").alias("b"), F.col("_iv").alias("vb"))

    def row(name, score, valid):
        return F.struct(F.lit(name).alias("scorer"), score.alias("score"), valid.alias("valid"))

    a, b, va, vb = (F.col(c) for c in ("a", "b", "va", "vb"))
    rows = F.array(row("individual", a, va), row("interaction", b, vb), row("combined", a + F.coalesce(b, F.lit(0.0)), F.when(vb.isNotNull(), va | vb)))
    return wide.select(*KEY, F.explode(rows).alias("r")).select(*KEY, "r.score", "r.valid", "r.scorer")


def all_scene_scores(agents: DataFrame, cfg: ScoreConfig) -> DataFrame:
    """(scenario_id, scorer, scene_score) of the long agent scores; the combined score weighs the sum of the other two.

    A missing half has a null score and counts as zero in the combined one.
    """
    def part(name):
        mine = F.col("scorer") == name
        n = F.greatest(F.count(F.when(mine & F.col("valid"), 1)), F.lit(1))
        total = F.sum(F.when(mine, F.col("score")))
        return F.when(total.isNotNull(), _clip(total / n, cfg))

    both = agents.groupBy("scenario_id").agg(part("individual").alias("a"), part("interaction").alias("b"))
    total = _clip(F.lit(cfg.combine_weight) * (F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))), cfg)
    rows = F.array(*[F.struct(F.lit(n).alias("scorer"), v.alias("scene_score")) for n, v in (
        ("individual", F.col("a")), ("interaction", F.col("b")), ("combined", total))])
    return both.select("scenario_id", F.explode(rows).alias("r")).select("scenario_id", "r.scene_score", "r.scorer")


def missing_features(scenarios: DataFrame, features: DataFrame) -> DataFrame:
    """Scenarios a score job skips because no features are stored for them."""
    return scenarios.select("scenario_id").distinct().join(
        features.select("scenario_id").distinct().hint("merge"), "scenario_id", "left_anti")
