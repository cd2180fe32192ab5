"""From raw observations to the canonical tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.functions import expr as X
from lanewise.functions.distributed import balanced_row_number
from lanewise.schema import (
    CATEGORY_TO_AGENT_TYPE, DEFAULT_BOX, DIFFICULTY_RELEVANCE, EPS, FALLBACK_BOX, LANE_MARK_TO_POLYLINE,
    MPH_TO_MS, PEDESTRIAN_CATEGORY_PREFIX, TABLES, AgentType,
)

KEY = ["scenario_id", "agent_idx"]
BODY = ("x", "y", "z", "length", "width", "height", "heading")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan one canonical table of all scenarios below `root`, with the declared schema."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def filter_ids(df: DataFrame, wanted: str | int | Iterable | DataFrame | None) -> DataFrame:
    """Keep one requested scenario, a short list, or the ids of a table; None keeps all."""
    if wanted is None:
        return df
    if isinstance(wanted, DataFrame):
        return df.join(wanted.select("scenario_id").distinct(), "scenario_id", "left_semi")
    ids = [wanted] if isinstance(wanted, (str, int)) else list(wanted)
    return df.filter(F.col("scenario_id").cast("string").isin([str(i) for i in ids]))


def sample_scenarios(ids: DataFrame, n: int | None, seed: int = 0) -> DataFrame:
    """A repeatable random subset of n ids; all of them when n is None, negative or not below the pool size."""
    ids = ids.select("scenario_id").distinct()
    if n is None or n < 0:
        return ids
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("scenario_id").cast("string")))
    drawn = balanced_row_number(ids.withColumns({"_draw": draw, "_all": F.lit(1)}), ["_all"], "_draw", ["scenario_id"])
    return drawn.filter(F.col("rn") <= n).select("scenario_id")


def truncate_horizon(points: DataFrame, steps: int) -> DataFrame:
    return points.filter(F.col("t") < steps)


def too_short(points: DataFrame, steps: int) -> DataFrame:
    """Scenarios with fewer steps than the horizon asks for; strict sources treat any row as an error."""
    return points.groupBy("scenario_id").agg((F.max("t") + 1).alias("n_steps")).filter(F.col("n_steps") < steps)


def pad_tracks(points: DataFrame, steps: int, default_dt: float = 0.1) -> DataFrame:
    """Every track up to `steps` rows: missing tail rows are zero and not valid, their time runs on at the last dt."""
    pts = truncate_horizon(points, steps)
    tail = F.slice(F.sort_array(F.collect_list(F.struct("t", "ts_s"))), -2, 2)
    ends = pts.groupBy(*KEY).agg(F.first("agent_type").alias("agent_type"), F.max("t").alias("last_t"),
                                 F.when(F.count(F.lit(1)) > 1, tail).alias("two"), F.max("ts_s").alias("last_ts"))
    dt = F.coalesce(F.get("two", F.lit(1))["ts_s"] - F.get("two", F.lit(0))["ts_s"], F.lit(default_dt))
    new = ends.filter(F.col("last_t") < steps - 1).withColumn(
        "t", F.explode(F.sequence(F.col("last_t") + 1, F.lit(steps - 1))))
    zero = F.lit(0.0)
    rows = new.select(
        *KEY, "t", "agent_type", (F.col("last_ts") + dt * (F.col("t") - F.col("last_t"))).alias("ts_s"),
        *[zero.alias(c) for c in (*BODY, "vx", "vy")], F.lit(False).alias("valid"))
    return pts.select(rows.columns).unionByName(rows)


def densify(points: DataFrame, n_steps: DataFrame) -> DataFrame:
    """One row per agent and step of its scene; steps without an observation are zero and not valid.

    `n_steps` has (scenario_id, n_steps). Only the missing rows are generated; observations are not joined.
    """
    have = points.groupBy(*KEY).agg(F.first("agent_type").alias("agent_type"), F.collect_set("t").alias("ts"))
    gaps = have.join(n_steps.select("scenario_id", "n_steps"), "scenario_id").select(
        *KEY, "agent_type", F.explode(F.array_except(F.sequence(F.lit(0), F.col("n_steps") - 1), "ts")).alias("t"))
    rows = gaps.select(
        *KEY, "t", "agent_type", *[F.lit(0.0).alias(c) for c in (*BODY, "vx", "vy")], F.lit(False).alias("valid"))
    return points.select(rows.columns).unionByName(rows)


def agent_type_of(category: Column) -> Column:
    """Source category to agent type; unknown categories are OTHER."""
    return F.coalesce(
        X.case_map(category, CATEGORY_TO_AGENT_TYPE),
        F.when(category.startswith(PEDESTRIAN_CATEGORY_PREFIX), int(AgentType.PEDESTRIAN)),
        F.lit(int(AgentType.OTHER))).cast("int")


def default_box(category: Column) -> Column:
    """struct(length, width, height) for a category without boxes."""
    box = None
    for name, (l, w, h) in DEFAULT_BOX.items():  # noqa: E741
        s = F.struct(F.lit(l).alias("length"), F.lit(w).alias("width"), F.lit(h).alias("height"))
        box = F.when(category == name, s) if box is None else box.when(category == name, s)
    l, w, h = FALLBACK_BOX  # noqa: E741
    return box.otherwise(F.struct(F.lit(l).alias("length"), F.lit(w).alias("width"), F.lit(h).alias("height")))


def mark_ego(agents: DataFrame, scenarios: DataFrame) -> DataFrame:
    df = agents.drop("ego_idx").join(scenarios.select("scenario_id", "ego_idx"), "scenario_id")
    return df.withColumn("agent_type", F.when(
        F.col("agent_idx") == F.col("ego_idx"), int(AgentType.EGO_AGENT)).otherwise(F.col("agent_type"))).drop("ego_idx")


def resample(keyframes: DataFrame, *, hz: float = 10.0, steps: int, n_keyframes: DataFrame | None = None) -> DataFrame:
    """Linear interpolation of keyframes onto a regular grid of `steps` at `hz`.

    A grid time gets a row only between two consecutive valid keyframes, or on the very last keyframe of the scene.
    Each segment generates its own grid steps, so no range join is needed. `n_keyframes` (scenario_id, n_keyframes)
    gives the keyframes per scene where the last ones may hold no observation.
    """
    eps = 1e-6
    w = Window.partitionBy(*KEY).orderBy("t")
    nxt = {f"n_{c}": F.lead(c).over(w) for c in ("t", "ts_s", "valid", *BODY)}
    if n_keyframes is None:
        n_keyframes = keyframes.groupBy("scenario_id").agg((F.max("t") + 1).alias("n_keyframes"))
    df = keyframes.withColumns(nxt).join(n_keyframes.select("scenario_id", "n_keyframes"), "scenario_id").withColumn(
        "last_t", F.col("n_keyframes") - 1).filter(X.is_valid(F.col("valid")))
    joined = (F.col("n_t") == F.col("t") + 1) & X.is_valid(F.col("n_valid"))
    k0 = F.greatest(F.ceil((F.col("ts_s") - eps) * hz), F.lit(0)).cast("int")
    k1 = F.least(F.ceil((F.col("n_ts_s") - eps) * hz) - 1, F.lit(steps - 1)).cast("int")
    at_end = F.rint(F.col("ts_s") * hz).cast("int")
    on_grid = (F.abs(at_end / hz - F.col("ts_s")) < eps) & (at_end < steps) & (at_end >= 0)
    ks = F.when(joined & (k0 <= k1), F.sequence(k0, k1)).when(
        (F.col("t") == F.col("last_t")) & on_grid, F.array(at_end))
    out = df.withColumn("k", F.explode(ks))
    span = F.col("n_ts_s") - F.col("ts_s")
    a = F.when(joined & (span > EPS), (F.col("k") / hz - F.col("ts_s")) / span).otherwise(F.lit(0.0))
    mixed = [F.when(joined, (1.0 - a) * F.col(c) + a * F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in BODY]
    return out.select(
        *KEY, F.col("k").alias("t"), "agent_type", F.round(F.col("k") / hz, 6).alias("ts_s"), *mixed,
        F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"), F.lit(True).alias("valid"))


def stride(points: DataFrame, every: int) -> DataFrame:
    """Every n-th step, renumbered: subsampling of a faster source to the working rate."""
    return points.filter(F.col("t") % every == 0).withColumn("t", F.expr(f"t div {every}").cast("int"))


def stride_for(source_dt: float, target_dt: float = 0.1) -> int:
    return 1 if source_dt <= 0 else max(1, round(target_dt / source_dt))


def recompute_velocity(points: DataFrame, *, dt: float | None = None) -> DataFrame:
    """Central difference over adjacent valid steps, one-sided at gaps, unchanged where isolated.

    Spacing is `dt` per step, or the recorded timestamps when `dt` is None.
    """
    w = Window.partitionBy(*KEY).orderBy("t")
    ok = X.is_valid(F.col("valid"))
    near = {}
    for tag, f, off in (("p", F.lag, -1), ("n", F.lead, 1)):
        near[f"{tag}_ok"] = (f("t").over(w) == F.col("t") + off) & X.is_valid(f("valid").over(w))
        for c in ("t", "ts_s", "x", "y"):
            near[f"{tag}_{c}"] = f(c).over(w)
    df = points.withColumns(near)

    def end(tag, c):
        return F.when(F.coalesce(F.col(f"{tag}_ok"), F.lit(False)), F.col(f"{tag}_{c}")).otherwise(F.col(c))

    clock = "ts_s" if dt is None else "t"
    span = (end("n", clock) - end("p", clock)) * (1.0 if dt is None else dt)
    moved = ok & (end("n", "t") != end("p", "t"))
    return df.withColumns({
        f"v{c}": F.when(moved, X.ieee_div(end("n", c) - end("p", c), span)).otherwise(F.col(f"v{c}"))
        for c in ("x", "y")}).drop(*near)


def dense_ids(observations: DataFrame, *, scene: str, track: str, t: str, is_ego: Column) -> DataFrame:
    """(scene, track, agent_idx): consecutive ids, ego first, then by first appearance."""
    first = observations.groupBy(scene, track).agg(
        F.min(t).alias("first_seen"), F.max(is_ego).alias("is_ego"))
    first = first.withColumn("_order", F.when(F.col("is_ego"), -1).otherwise(F.col("first_seen").cast("long")))
    return balanced_row_number(first, [scene], "_order", [track], out="rn").select(
        scene, track, (F.col("rn") - 1).alias("agent_idx"))


def relevance(agents: DataFrame, rule: str) -> DataFrame:
    """Agent relevance. `difficulty`: 0/1/2 -> 0.8/0.9/1.0 and ego 1; `all`: 1; `targets`: 1 for listed tracks and ego."""
    ego = F.col("agent_idx") == F.col("ego_idx")
    if rule == "all":
        value = F.lit(1.0)
    elif rule == "difficulty":
        value = F.when(ego, 1.0).otherwise(F.coalesce(
            X.case_map(F.col("difficulty"), DIFFICULTY_RELEVANCE), F.lit(0.0)))
    elif rule == "targets":
        value = F.when(ego | F.col("difficulty").isNotNull(), 1.0).otherwise(0.0)
    else:
        raise ValueError(f"unknown relevance rule {rule!r}")
    return agents.withColumn("relevance", value)


def select_targets(tracks: DataFrame, category: str = "category") -> DataFrame:
    """Prediction targets: unscored tracks are dropped, fragments get difficulty 0, the rest 1."""
    return tracks.filter(F.col(category) != "UNSCORED_TRACK").withColumn(
        "difficulty", F.when(F.col(category) == "TRACK_FRAGMENT", 0).otherwise(1))


def targets_by_scene(predictions: DataFrame, samples: DataFrame) -> DataFrame:
    """Prediction list (sample, instance) grouped by the scene of the sample; one row per (scene, instance).

    Kept long so that a scene with very many targets never becomes one array.
    """
    return predictions.join(samples.select("sample", "scene"), "sample").select("scene", "instance").distinct()


def objects_of_interest(tracks: DataFrame, targets: DataFrame) -> DataFrame:
    return tracks.join(targets, ["scene", "instance"], "left_semi")


def frequency(points: DataFrame, cap: float = 10.0) -> DataFrame:
    """Sampling rate per scene: rounded inverse of the mean step, at most `cap`. The mean of the steps telescopes."""
    line = points.groupBy("scenario_id", "t").agg(F.min("ts_s").alias("ts"))
    ends = line.groupBy("scenario_id").agg(
        F.min(F.struct("t", "ts")).alias("a"), F.max(F.struct("t", "ts")).alias("b"), F.count(F.lit(1)).alias("n"))
    mean = (F.col("b.ts") - F.col("a.ts")) / (F.col("n") - 1)
    return ends.filter(F.col("n") > 1).select("scenario_id", F.least(F.rint(1.0 / mean), F.lit(cap)).alias("frequency_hz"))


def duration(points: DataFrame) -> DataFrame:
    return points.groupBy("scenario_id").agg((F.max("ts_s") - F.min("ts_s")).alias("duration_s"))


def scene_seconds(frames: DataFrame, *, scene: str, ts_us: str = "ts_us") -> DataFrame:
    """Adds `ts_s`: seconds since the first frame of the scene."""
    start = frames.groupBy(scene).agg(F.min(ts_us).alias("_t0"))
    return frames.join(start, scene).withColumn("ts_s", (F.col(ts_us) - F.col("_t0")) / 1e6).drop("_t0")


def first_keyframes(frames: DataFrame, *, scene: str, n: int, ts_us: str = "ts_us", tie: str) -> DataFrame:
    return balanced_row_number(frames, [scene], ts_us, [tie], out="keyframe").filter(F.col("keyframe") <= n)


def candidate_frames(frames: DataFrame, tags: DataFrame) -> DataFrame:
    """Tagged frames of scenes that have at least two scenes before and after them in their log.

    `frames` has (log_id, scene, frame_id, ts_us); `tags` has frame_id.
    """
    scenes = frames.select("log_id", "scene").distinct()
    ordered = balanced_row_number(scenes, ["log_id"], "scene", out="pos")
    size = scenes.groupBy("log_id").agg(F.count(F.lit(1)).alias("n"))
    inner = ordered.join(size, "log_id").filter((F.col("pos") >= 3) & (F.col("pos") < F.col("n") - 1))
    return (
        frames.join(inner.select("log_id", "scene"), ["log_id", "scene"], "left_semi")
        .join(tags.select("frame_id").distinct(), "frame_id", "left_semi")
        .select("log_id", "frame_id", "ts_us").distinct()
    )


_MAP = "log_id long, chunk long, start long, exit long"


def _jump(ts: np.ndarray, i: int, gap: int) -> list[int]:
    kept = []
    while i < len(ts):
        kept.append(i)
        i = max(i + 1, int(np.searchsorted(ts, ts[i] + gap)))
    return kept


def _last_kept(ts: np.ndarray, gap: int) -> np.ndarray:
    """For each frame the last one kept when it is the first: its next one's, followed by doubling."""
    last, after = np.arange(len(ts)), np.minimum(np.searchsorted(ts, ts + gap), len(ts) - 1)
    after = np.where(ts[after] - ts >= gap, after, last)
    while not np.array_equal(after, further := after[after]):
        after = further
    return after


def _enter(starts: np.ndarray, exits: np.ndarray, last: int, gap: int) -> int:
    i = int(np.searchsorted(starts, last + gap))
    return int(exits[i]) if i < len(starts) else last


def thin_frames(frames: DataFrame, min_gap_s: float, *, chunk_gaps: int = 64, super_chunks: int = 512) -> DataFrame:
    """Per log, in time order, keep a frame only when at least `min_gap_s` passed since the last kept one.

    The choice depends on the previous one, so a long log is cut into chunks. A chunk's first kept frame lies within one
    gap of its start; for each such frame the chunk is walked once and its last kept time noted. These small maps are
    chained, over super-chunks first, to find how each chunk is entered, and each chunk then lists its kept frames.
    No task sees more than one chunk of frames or one super-chunk of maps. Without a gap every frame stays, those of equal times
    too.
    """
    gap = int(round(min_gap_s * 1e6))
    if gap <= 0:
        return frames.select("log_id", "frame_id", "ts_us")
    width = max(gap * chunk_gaps, 1)
    never = -(2**62)
    one = frames.groupBy("log_id", "ts_us").agg(F.min("frame_id").alias("frame_id")).withColumn(
        "chunk", F.floor(F.col("ts_us") / F.lit(width)).cast("long"))

    def chunk_map(pdf: pd.DataFrame) -> pd.DataFrame:
        ts = np.sort(pdf["ts_us"].to_numpy())
        upto = min(int(np.searchsorted(ts, pdf["chunk"].iloc[0] * width + gap)) + 1, len(ts))
        return pd.DataFrame({"start": ts[:upto], "exit": ts[_last_kept(ts, gap)[:upto]]}).assign(
            log_id=pdf["log_id"].iloc[0], chunk=pdf["chunk"].iloc[0])[["log_id", "chunk", "start", "exit"]]

    maps = one.groupBy("log_id", "chunk").applyInPandas(chunk_map, _MAP).withColumn(
        "super", F.floor(F.col("chunk") / super_chunks).cast("long"))

    def super_map(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [g.sort_values("start") for _, g in sorted(pdf.groupby("chunk"))]
        starts, state = parts[0]["start"].to_numpy(), parts[0]["exit"].to_numpy().copy()
        for n, g in enumerate(parts[1:]):
            s, e = g["start"].to_numpy(), g["exit"].to_numpy()
            at = np.searchsorted(s, state + gap)
            state = np.where(at < len(s), e[np.minimum(at, len(s) - 1)], state)
            if n == 0:  # entering too late for every frame of the first chunk means starting with this one
                starts, state = np.append(starts, s[0]), np.append(state, e[0])
        return pd.DataFrame({"log_id": pdf["log_id"].iloc[0], "chunk": pdf["super"].iloc[0],
                             "start": starts, "exit": state})

    supers = maps.groupBy("log_id", "super").applyInPandas(super_map, _MAP)

    def entries(pdf: pd.DataFrame, last: int) -> list[tuple[int, int]]:
        out = []
        for c, g in sorted(pdf.groupby("chunk")):
            out.append((int(c), last))
            g = g.sort_values("start")
            last = _enter(g["start"].to_numpy(), g["exit"].to_numpy(), last, gap)
        return out

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = entries(pdf, never)
        return pd.DataFrame(rows, columns=["super", "entry"]).assign(log_id=pdf["log_id"].iloc[0])[
            ["log_id", "super", "entry"]]

    heads = supers.groupBy("log_id").applyInPandas(chain, "log_id long, super long, entry long")

    def open_super(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = entries(pdf, int(pdf["entry"].iloc[0]))
        return pd.DataFrame(rows, columns=["chunk", "entry"]).assign(log_id=pdf["log_id"].iloc[0])[
            ["log_id", "chunk", "entry"]]

    opened = maps.join(heads, ["log_id", "super"]).groupBy("log_id", "super").applyInPandas(
        open_super, "log_id long, chunk long, entry long")

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts_us")
        ts = pdf["ts_us"].to_numpy()
        i = int(np.searchsorted(ts, int(pdf["entry"].iloc[0]) + gap))
        return pdf.iloc[_jump(ts, i, gap)][["log_id", "frame_id", "ts_us"]]

    return one.join(opened, ["log_id", "chunk"]).groupBy("log_id", "chunk").applyInPandas(
        keep, "log_id long, frame_id long, ts_us long")


def lane_boundaries(map_points: DataFrame, mark: str = "mark") -> DataFrame:
    """Boundary points typed by their paint; unmapped marks are dropped."""
    df = map_points.withColumn("polyline_type", X.case_map(F.upper(F.col(mark)), LANE_MARK_TO_POLYLINE))
    return df.filter(F.col("polyline_type").isNotNull())


def close_crosswalk(edges: DataFrame) -> DataFrame:
    """Join the two edges of a crosswalk into one outline: the second edge runs backwards after the first."""
    feat = ["scenario_id", "feature_idx"]
    n = edges.groupBy(*feat).agg(
        F.count(F.when(F.col("edge") == 1, 1)).alias("n1"), F.count(F.when(F.col("edge") == 2, 1)).alias("n2"))
    idx = F.when(F.col("edge") == 1, F.col("point_idx")).otherwise(
        F.col("n1") + F.col("n2") - 1 - F.col("point_idx"))
    return edges.join(n, feat).select(*feat, idx.cast("long").alias("point_idx"), "x", "y", "z")


def speed_limit_mph(metres_per_second: Column) -> Column:
    return F.coalesce(metres_per_second / MPH_TO_MS, X.lit_d(X.NAN))


def row_rules() -> dict[str, Column]:
    """Counts of track point rows with a null or negative key or an unknown agent type, for `storage.write_checked`."""
    keys = [F.col(c) for c in (*KEY, "t")]
    tests = {"null_key": reduce(Column.__or__, (k.isNull() for k in keys)), "negative_key": reduce(Column.__or__, (k < 0 for k in keys)),
             "unknown_type": ~F.coalesce(F.col("agent_type").isin([int(a) for a in AgentType]), F.lit(False))}
    return {name: F.count_if(test) for name, test in tests.items()}


def horizon_rule(steps: int) -> dict[str, Column]:
    """Number of scenarios that end before `steps`, by their ego rows: each whole one has an ego row at the first and at the last step."""
    ego = F.col("agent_type") == int(AgentType.EGO_AGENT)
    return {"too_short": F.count_if(ego & (F.col("t") == 0)) - F.count_if(ego & (F.col("t") == steps - 1))}


def violations(points: DataFrame) -> DataFrame:
    """(scenario_id, rule, rows): null or negative keys, duplicate steps, unknown agent types, unequal track lengths."""
    key = [*KEY, "t"]
    bad_null = F.lit(False)
    bad_neg = F.lit(False)
    for c in key:
        bad_null, bad_neg = bad_null | F.col(c).isNull(), bad_neg | F.coalesce(F.col(c) < 0, F.lit(False))
    bad_type = ~F.coalesce(F.col("agent_type").isin([int(a) for a in AgentType]), F.lit(False))
    flags = points.select("scenario_id", F.explode(F.filter(F.array(
        F.when(bad_null, "null_key"), F.when(bad_neg, "negative_key"), F.when(bad_type, "unknown_type")),
        lambda r: r.isNotNull())).alias("rule"))
    steps = points.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    dup = steps.filter(F.col("n") > 1).select("scenario_id", F.lit("duplicate_key").alias("rule"))
    length = steps.groupBy(*KEY).agg(F.count(F.lit(1)).alias("len"))
    longest = length.groupBy("scenario_id").agg(F.max("len").alias("most"))
    uneven = length.join(longest, "scenario_id").filter(F.col("len") < F.col("most")).select(
        "scenario_id", F.lit("unequal_length").alias("rule"))
    return flags.unionByName(dup).unionByName(uneven).groupBy("scenario_id", "rule").agg(
        F.count(F.lit(1)).alias("rows"))


def overlapping_scenarios(points: DataFrame, scenarios: DataFrame, *, shared: int = 5) -> DataFrame:
    """(scenario_id, overlaps): has the scene at least `shared` ego positions in common with another one?

    Scenes with identical position sets are folded into one first. Of the rest, two sets sharing `shared` positions
    must meet in one of the rarer positions of both, so only those are joined; a scene already matched with the first
    holder of one of its positions is not compared any further.
    """
    ego = points.filter(X.is_valid(F.col("valid"))).join(
        scenarios.select("scenario_id", F.col("ego_idx").alias("agent_idx")), KEY, "left_semi")
    pos = ego.select("scenario_id", "x", "y").distinct()
    common = pos.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    sets = pos.join(common, ["x", "y"]).groupBy("scenario_id").agg(
        F.sort_array(F.collect_list(F.struct("n", "x", "y"))).alias("p"))
    sets = sets.filter(F.size("p") >= shared)
    groups = sets.groupBy("p").agg(F.min("scenario_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    tokens = groups.select("rep", F.explode(F.slice("p", 1, F.size("p") - shared + 1)).alias("k"))
    body = groups.select("rep", "p")

    def verified(pairs: DataFrame) -> DataFrame:
        a = body.select(F.col("rep").alias("a"), F.col("p").alias("pa"))
        b = body.select(F.col("rep").alias("b"), F.col("p").alias("pb"))
        both = pairs.distinct().join(a, "a").join(b, "b").filter(F.size(F.array_intersect("pa", "pb")) >= shared)
        return both.select(F.explode(F.array("a", "b")).alias("rep")).distinct()

    hub = tokens.groupBy("k").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("m")).filter(F.col("m") > 1)
    near_hub = verified(hub.join(tokens, "k").filter(F.col("a") != F.col("rep")).select("a", F.col("rep").alias("b")))
    open_ = tokens.join(groups.filter(F.col("copies") == 1).select("rep"), "rep", "left_semi").join(
        near_hub, "rep", "left_anti")
    rest = verified(open_.select("k", F.col("rep").alias("a")).join(
        tokens.select("k", F.col("rep").alias("b")), "k").filter(F.col("a") != F.col("b")).select("a", "b"))
    hit = near_hub.unionByName(rest).distinct().withColumn("met", F.lit(True))
    per_set = groups.join(hit, "rep", "left").select(
        "p", (F.coalesce("met", F.lit(False)) | (F.col("copies") > 1)).alias("overlaps"))
    flagged = sets.join(per_set, "p").select("scenario_id", "overlaps")
    return scenarios.select("scenario_id").join(flagged, "scenario_id", "left").select(
        "scenario_id", F.coalesce("overlaps", F.lit(False)).alias("overlaps"))


def common_ids(branches: Sequence[DataFrame]) -> DataFrame:
    """Ids present in every branch, found in one aggregate instead of a chain of intersections."""
    tagged = None
    for n, df in enumerate(branches):
        part = df.select("scenario_id").distinct().withColumn("branch", F.lit(n))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") == len(branches)).select("scenario_id")


def schema_violations(df: DataFrame, name: str) -> list[str]:
    """Columns of a canonical table that are absent or of another type (checked on the schema, no job)."""
    have = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for f in TABLES[name].fields:
        if f.name not in have:
            out.append(f"{f.name}: missing")
        elif have[f.name] != f.dataType and not isinstance(f.dataType, T.ArrayType):
            out.append(f"{f.name}: {have[f.name].simpleString()} is not {f.dataType.simpleString()}")
    return out
