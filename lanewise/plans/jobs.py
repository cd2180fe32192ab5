"""The jobs users run: features, scores, profile and probes over all scenarios of all datasets at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lanewise.operators import individual as I
from lanewise.operators import maps as M
from lanewise.operators import pairs as P
from lanewise.operators import probing as C
from lanewise.operators import profiling as A
from lanewise.operators import scoring as S
from lanewise.schema import PRESETS, ScoreConfig
from lanewise.session import materialize, stored


SCORERS = ("individual", "interaction", "combined")


@dataclass
class Tables:
    """The canonical tables; the map parts may be absent."""

    points: DataFrame
    scenarios: DataFrame
    agents: DataFrame
    map_points: DataFrame | None = None
    lanes: DataFrame | None = None
    signals: DataFrame | None = None


def individual(t: Tables, *, criterion: str = "critical", threshold: float = 0.1, k_lanes: int = 16, lane_step: int = 1,
               stage=None) -> DataFrame:
    """Per-agent features with whatever the map allows; `lane_step` takes every n-th lane point. With `stage` the motion summary is written once and reused."""
    cps = near = None
    if t.map_points is not None:
        cps = M.conflict_points(t.map_points, t.signals, threshold=threshold)
        if t.lanes is not None:
            near = M.closest_lanes(t.points, t.map_points, k=k_lanes, subsample=lane_step)
    return I.individual_features(
        t.points, t.scenarios, criterion=criterion, conflict_points=cps, closest_lanes=near, lanes=t.lanes,
        stage=stage)


def features(t: Tables, cfg: ScoreConfig, *, criterion: str = "critical", include_vehicle_free: bool = True):
    """(individual, pairs, distances). Pairs are ego-scoped exactly when the weights only need ego distances."""
    ego = cfg.weighting == "ego_distance"
    pairs = P.pair_features(t.points, t.scenarios, scope="ego" if ego else "all", criterion=criterion,
                            include_vehicle_free=include_vehicle_free)
    return individual(t, criterion=criterion), pairs, distances(t, cfg)


def distances(t: Tables, cfg: ScoreConfig) -> DataFrame | None:
    """The closest distances the weights need: to the ego, to the relevant agents, or none for uniform weights."""
    if cfg.weighting == "ego_distance":
        return P.closest_agent_distances(t.points, t.scenarios)
    if cfg.weighting == "relevant_distance" and "relevance" in t.agents.columns:
        return P.closest_agent_distances(t.points, t.scenarios, to="relevant", targets=t.agents.filter("relevance > 0"))
    return None


def scores(t: Tables, ind: DataFrame, pairs: DataFrame, cfg: ScoreConfig, *, thresholds: dict | None = None,
           stored_distances: DataFrame | None = None, featured: DataFrame | None = None, stage=None):
    """(agent scores, scene scores) of all scenarios, or of those whose ids `featured` has: the ones with stored features, which
    may hold no usable agent at all. See `scoring.missing_features` for the rest.

    `stored_distances` are those of :func:`distances`; without them they are measured again. With `stage` the agent
    table is written once and the scene table read from it.
    """
    known = {f"{cfg.weighting.split('_')[0]}_distances": stored_distances} if stored_distances is not None else {}
    weights = S.agent_weights(t.agents, t.scenarios, cfg, points=t.points, **known)
    if stage:
        weights = stage(weights, "weights")
    if featured is not None:
        weights = weights.join(featured.select("scenario_id").distinct().hint("merge"), "scenario_id", "left_semi")
    out = S.agent_scores(weights, ind, pairs, cfg, t.scenarios, thresholds=thresholds)
    if stage:
        out = stage(out, "agent_scores")
    return out, S.all_scene_scores(out, cfg)


def probes(t: Tables, cfg: ScoreConfig, *, stage=None, **options) -> DataFrame:
    """One summary row per scenario, with or without a probe."""
    found = C.find_probes(t.points, t.agents, t.scenarios, cfg, stage=stage, **options)
    return C.probe_summary(stage(found, "probes") if stage else found, t.scenarios, t.agents)


class Profile:
    """The categorical profile as a chain of stored tables below `root`; a re-run skips the stages already there.

    Categories are a projection of stored continuous features, so features are computed once.
    """

    def __init__(self, spark: SparkSession, root: str, tables: Tables, *, criterion: str = "critical", **map_options):
        # What a stage depends on is part of its path, so other options never meet its tables.
        chosen = "-".join([criterion, *(f"{k}={v}" for k, v in sorted(map_options.items()))])
        self.spark, self.root, self.t, self.criterion = spark, f"{root.rstrip('/')}/{chosen}", tables, criterion
        self.map_options = map_options

    def _stage(self, name: str, build) -> DataFrame:
        return stored(self.spark, f"{self.root}/{name}", build)

    def individual(self) -> DataFrame:
        return self._stage("individual", lambda: individual(
            self.t, criterion=self.criterion, stage=materialize, **self.map_options))

    def pairs(self) -> DataFrame:
        return self._stage("pairs", lambda: P.pair_features(
            self.t.points, self.t.scenarios, scope="ego", criterion=self.criterion))

    def thresholds(self) -> DataFrame:
        def build():
            long = A.individual_long(self.individual()).unionByName(A.pair_long(self.pairs()))
            return A.category_thresholds(long, ["type", "feature"])
        return self._stage("thresholds", build)

    def individual_categories(self) -> DataFrame:
        return self._stage("individual_categories", lambda: I.categorize_individual(
            self.individual(), self.thresholds()))

    def pair_categories(self) -> DataFrame:
        return self._stage("pair_categories", lambda: P.categorize_pairs(self.pairs(), self.thresholds()))

    def agent_scores(self, kind: str = "categorical") -> DataFrame:
        """`raw` scores use continuous features and the pipeline preset, `categorical` ones categories and its preset."""
        def build():
            if kind == "raw":
                return scores(self.t, self.individual(), self.pairs(), PRESETS["pipeline_default"])[0]
            return scores(self.t, self.individual_categories(), self.pair_categories(),
                          PRESETS["combined_categorical"])[0]
        return self._stage(f"agent_scores_{kind}", build)

    def score_thresholds(self) -> DataFrame:
        def build():
            raw = self.agent_scores()
            scenes = A.complete_only(S.all_scene_scores(raw, PRESETS["combined_categorical"]).withColumnRenamed("scorer", "key"), SCORERS)
            return A.score_thresholds(raw.join(scenes.select("scenario_id").distinct().hint("merge"), "scenario_id", "left_semi"))
        return self._stage("score_thresholds", build)

    def score_categories(self) -> DataFrame:
        """Agent scores whose halves are categories, by their own thresholds, and the sum of the two."""
        def build():
            # A few boundaries for each of two scorers.
            cuts: dict[str, list[float]] = {}
            for r in self.score_thresholds().filter("scorer <> 'combined'").orderBy("scorer", "ord").collect():
                cuts.setdefault(r["scorer"], []).append(r["value"])
            return scores(self.t, self.individual_categories(), self.pair_categories(), PRESETS["combined_categorical"], thresholds=cuts)[0]
        return self._stage("score_categories", build)

    def scene_categories(self) -> DataFrame:
        """Scene scores of the categorised agent scores."""
        return self._stage("scene_categories", lambda: S.all_scene_scores(self.score_categories(), PRESETS["combined_categorical"]))
