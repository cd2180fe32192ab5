"""Map geometry: conflict points, distances to them, closest lanes, polyline directions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions import expr as X
from lanewise.functions.nearest import CELL, Columns, cell_width, distances, nearest_distance, ring_join, sum_of_squares
from lanewise.operators.individual import valid_points
from lanewise.schema import EPS
from lanewise.session import materialize

KEY = ["scenario_id", "agent_idx"]
STATIC_CLASSES = ("crosswalk", "speed_bump", "stop_sign")


def static_conflict_points(map_points: DataFrame, *, resample_factor: int = 1) -> DataFrame:
    """All points of crosswalks, bumps and stop signs, optionally resampled by periodic (Fourier) interpolation."""
    pts = map_points.filter(F.col("feature_class").isin(*STATIC_CLASSES))
    if resample_factor == 1:
        return pts.select("scenario_id", F.lit("static").alias("kind"), "x", "y", "z")
    shape = pts.groupBy("scenario_id", "feature_class", "feature_idx").agg(
        F.sort_array(F.collect_list(F.struct("point_idx", "x", "y", "z"))).alias("p"))
    n = F.size("p")
    rows = shape.withColumn("m", F.explode(F.sequence(F.lit(0), n * resample_factor - 1)))

    def weight(k: Column) -> Column:
        u = F.col("m") / float(resample_factor) - k
        up = F.lit(math.pi) * u
        whole = F.col("m") % resample_factor == 0
        odd = n % 2 == 1
        tail = F.when(odd, F.sin(up / n)).otherwise(F.tan(up / n))
        on_node = F.when(F.floor(F.col("m") / float(resample_factor)) == k, 1.0).otherwise(0.0)
        return F.when(whole, on_node).otherwise(F.sin(up) / (n * tail))

    def interpolate(axis: str) -> Column:
        terms = F.transform("p", lambda q, k: q[axis] * weight(k))
        return F.aggregate(terms, X.lit_d(0.0), lambda acc, v: acc + v)

    return rows.select(
        "scenario_id", F.lit("static").alias("kind"), *[interpolate(a).alias(a) for a in ("x", "y", "z")])


def lane_intersections(map_points: DataFrame, *, threshold: float = 0.5, ndim: int = 3) -> DataFrame:
    """Points of either lane of a pair that lie within `threshold` of the other lane, once per pair.

    Equi-join on cells of the threshold size; the second side is offered to the neighbouring cells. Sort-merge is asked for: Spark would
    judge that side by the few bytes of the map's file and send all its rows, nine times over, through the driver.
    """
    lanes = map_points.filter(F.col("feature_class") == "lane").select(
        "scenario_id", F.col("feature_idx").alias("lane"), "point_idx", "x", "y", "z",
        F.floor(F.col("x") / threshold).alias("cx"), F.floor(F.col("y") / threshold).alias("cy"))
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    a = lanes.withColumnsRenamed({c: f"{c}_a" for c in ("lane", "point_idx", "x", "y", "z")})
    b = lanes.withColumn("o", F.explode(near)).select(
        "scenario_id", (F.col("cx") + F.col("o.a")).alias("cx"), (F.col("cy") + F.col("o.b")).alias("cy"),
        *[F.col(c).alias(f"{c}_b") for c in ("lane", "point_idx", "x", "y", "z")])
    dz = F.col("z_a") - F.col("z_b") if ndim == 3 else F.lit(0.0)
    dist = X.norm3(F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b"), dz)
    hits = a.join(b.hint("merge"), ["scenario_id", "cx", "cy"]).filter((F.col("lane_a") < F.col("lane_b")) & (dist < threshold))
    ends = F.array(*[F.struct(
        *[F.col(f"{c}_{s}").alias(c) for c in ("lane", "point_idx", "x", "y", "z")]) for s in ("a", "b")])
    return (
        hits.select("scenario_id", "lane_a", "lane_b", F.explode(ends).alias("e"))
        .select("scenario_id", "lane_a", "lane_b", "e.*")
        .distinct()
        .select("scenario_id", F.lit("lane_intersection").alias("kind"), "x", "y", "z")
    )


def signal_steps(signals: DataFrame) -> DataFrame:
    """Adds `step`: position among the steps that carry any signal."""
    seen = signals.select("scenario_id", "t").distinct()
    step = F.row_number().over(Window.partitionBy("scenario_id").orderBy("t")) - 1
    return signals.join(seen.withColumn("step", step.cast("int")), ["scenario_id", "t"])


def dynamic_conflict_points(signals: DataFrame, *, only_full_sets: bool = False, ndim: int = 3) -> DataFrame:
    """Stop points of the first signal step; with `only_full_sets`, of scenes that have exactly `ndim` of them."""
    per = signals.groupBy("scenario_id").agg(F.min("t").alias("t"))
    first = signals.join(per.hint("merge"), ["scenario_id", "t"])
    if only_full_sets:
        n = first.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == ndim)
        first = first.join(n, "scenario_id", "left_semi")
    return first.select("scenario_id", F.lit("dynamic").alias("kind"), "x", "y", "z")


def conflict_points(
    map_points: DataFrame, signals: DataFrame | None = None, *, resample_factor: int = 1, threshold: float = 0.1,
    ndim: int = 3, only_full_sets: bool = False, kinds: tuple[str, ...] = ("static", "dynamic", "lane_intersection"),
) -> DataFrame:
    """(scenario_id, kind, x, y, z) of every conflict point of the requested kinds."""
    parts = []
    if "static" in kinds:
        parts.append(static_conflict_points(map_points, resample_factor=resample_factor))
    if "dynamic" in kinds and signals is not None:
        parts.append(dynamic_conflict_points(signals, only_full_sets=only_full_sets, ndim=ndim))
    if "lane_intersection" in kinds:
        parts.append(lane_intersections(map_points, threshold=threshold, ndim=ndim))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def conflict_distances(points: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Distance of each agent step to each conflict point. Usually reduced at once; see :func:`nearest_conflict`."""
    c = conflicts.select("scenario_id", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"))
    d = X.norm3(F.col("cx") - F.col("x"), F.col("cy") - F.col("y"), F.col("cz") - F.col("z"))
    return points.select(*KEY, "t", "x", "y", "z").join(c, "scenario_id").select(*KEY, "t", "cx", "cy", "cz",
                                                                               d.alias("distance"))


def _steps(points: DataFrame, ndim: int = 3) -> DataFrame:
    """Agent steps as queries; a missing coordinate is a NaN."""
    x, y, z = (F.coalesce(F.col(c).cast("double"), X.lit_d(X.NAN)).alias(c) for c in "xyz")
    return points.select(*KEY, "t", x, y, z if ndim == 3 else F.lit(0.0).alias("z"))


def nearest_conflict(points: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Distance of each agent step to the nearest conflict point of its scene; scenes without any have no rows.

    Steps meet the conflict points of rings of cells, see :mod:`lanewise.functions.nearest`. A step without a position has a NaN.
    """
    return nearest_distance(_steps(points), conflicts, name="nearest-conflict").select(*KEY, "t", "distance")


def reaches_conflict(points: DataFrame, conflicts: DataFrame, *, within: float) -> DataFrame:
    """Whether an agent is ever within a distance of any conflict point of its scene; only cells of that width are compared."""
    agents = points.select(*KEY).distinct().join(conflicts.select("scenario_id").distinct(), "scenario_id", "left_semi")
    near = nearest_distance(_steps(points), conflicts, within=within, name="reached-conflict").filter(F.col("distance") <= within)
    hit = near.select(*KEY).distinct().withColumn("in_conflict", F.lit(True))
    return agents.join(hit, KEY, "left").withColumn("in_conflict", F.coalesce("in_conflict", F.lit(False)))


def _lane_targets(map_points: DataFrame, subsample: int, ndim: int) -> DataFrame:
    """Lane points with their place in the lane, both neighbours, half the longest segment and the number of lanes of the scene."""
    lane = Window.partitionBy("scenario_id", "lane")
    along = lane.orderBy("point_idx")
    pts = map_points.filter((F.col("feature_class") == "lane") & (F.col("point_idx") % subsample == 0)).select(
        "scenario_id", F.col("feature_idx").alias("lane"), "point_idx", "x", "y", (F.col("z") if ndim == 3 else F.lit(0.0)).alias("z"))
    missing = X.lit_d(X.NAN)
    pts = pts.withColumns({
        "pos": (F.row_number().over(along) - 1).cast("double"),
        **{f"b{c}": F.coalesce(F.lag(c).over(along), missing) for c in "xyz"}, **{f"a{c}": F.coalesce(F.lead(c).over(along), missing) for c in "xyz"}})
    gap = X.norm3(F.col("ax") - F.col("x"), F.col("ay") - F.col("y"), F.col("az") - F.col("z"))
    scene = pts.groupBy("scenario_id").agg(F.count_distinct("lane").cast("double").alias("lanes"),
                                           F.coalesce(F.max(F.when(~F.isnan(gap), gap)) / 2, F.lit(0.0)).alias("half"))
    return materialize(pts.drop("point_idx").join(scene.hint("merge"), "scenario_id"), "lane-targets")


_LANE_COLUMNS = [("lane_idx", pa.int64()), *((c, pa.float64()) for c in (
    "near", "idx", "proj", "along", "foot_x", "foot_y", "foot_z", "at_x", "at_y", "at_z"))]


def _lane_kernel(k: int, threshold: float):
    """Lanes of a step that may be among its k nearest, and those within `threshold`: nearest point, and foot on the adjacent segment.

    A foot is at most half a segment nearer than the nearest point, so a step is done when k lanes are nearer than what the ring
    covers less that, or all lanes of the scene are covered.
    """
    def kernel(q: Columns, t: Columns, reach: float) -> tuple[Columns, np.ndarray]:
        n = len(q["x"])
        nowhere = ~np.isfinite(q["x"] + q["y"] + q["z"])
        if not len(t["x"]):
            return {name: np.zeros(0) for name in ("query", *(c for c, _ in _LANE_COLUMNS))} | {"query": np.zeros(0, np.int64), "lane_idx": np.zeros(0, np.int64)}, nowhere
        order = np.lexsort((t["pos"], t["lane"]))
        t = {c: x[order] for c, x in t.items()}
        d = distances(q, t)
        ends = np.append(np.flatnonzero(np.diff(t["lane"])) + 1, len(order))
        best = np.stack([d[:, a:b].argmin(1) + a for a, b in zip([0, *ends[:-1]], ends, strict=True)], 1)
        near = np.take_along_axis(d, best, 1)
        near[~(near <= reach)] = np.inf
        half, kth = t["half"][0] + 1e-9, np.full(n, np.inf)
        if near.shape[1] >= k:
            kth = np.partition(near, k - 1, axis=1)[:, k - 1]
        done = (kth <= reach - half) | (np.isfinite(near).sum(1) == t["lanes"][0]) | nowhere
        keep = np.isfinite(near) & ((near - half <= kth[:, None]) | (near <= threshold)) & done[:, None]
        i, lane = np.nonzero(keep)
        j = best[i, lane]
        low = near[i, lane]
        x = [q[c][i] for c in "xyz"]
        c, before, after = ([t[f"{s}{a}"][j] for a in "xyz"] for s in ("", "b", "a"))
        to = lambda p: np.sqrt(sum_of_squares([a - b for a, b in zip(p, x, strict=True)]))
        first, last = np.isnan(before[0]), np.isnan(after[0])
        back = ~first & (last | (to(before) < to(after)))
        a, b = ([np.where(back, u, v) for u, v in zip(p, r, strict=True)] for p, r in ((before, c), (c, after)))
        s = [v - u for u, v in zip(a, b, strict=True)]
        long = sum_of_squares(s)
        with np.errstate(divide="ignore", invalid="ignore"):
            u = ((x[0] - a[0]) * s[0] + (x[1] - a[1]) * s[1] + (x[2] - a[2]) * s[2]) / long
            foot = [p + u * (r - p) for p, r in zip(a, b, strict=True)]
            proj = np.sqrt(sum_of_squares([v - f for v, f in zip(x, foot, strict=True)]))
            fits = (long >= EPS) & (u >= 0) & (u <= 1) & (proj < low)
        return {"query": i, "lane_idx": t["lane"][j].astype(np.int64), "near": low, "idx": t["pos"][j], "proj": np.where(fits, proj, np.inf),
                "along": t["pos"][j] - back + u, **dict(zip(("foot_x", "foot_y", "foot_z"), foot, strict=True)),
                **dict(zip(("at_x", "at_y", "at_z"), c, strict=True))}, done

    return kernel


def closest_lanes(
    points: DataFrame, map_points: DataFrame, *, k: int = 16, threshold: float = 10.0, subsample: int = 1, ndim: int = 3
) -> DataFrame:
    """K nearest lanes of each valid agent step: (.., t, rank, lane_idx, distance, point_idx, proj_x, proj_y, proj_z).

    Steps meet the lane points of rings of cells, see :mod:`lanewise.functions.nearest`; only lanes that may be among the nearest are
    rows. A lane an agent ever comes within `threshold` of is refined to the adjacent segment. Steps without a position have no lanes.
    """
    lanes = _lane_targets(map_points, subsample, ndim)
    near = ring_join(_steps(valid_points(points), ndim), lanes, cell_width(lanes, F.first("lanes"), k, max(CELL, threshold)),
                     _lane_kernel(k, threshold), _LANE_COLUMNS, name="closest-lanes")
    # One exchange by agent serves both windows.
    near = near.repartition(*KEY).withColumn("gate", F.min("near").over(Window.partitionBy(*KEY, "lane_idx")) <= threshold)
    use = F.col("gate") & (F.col("proj") < F.col("near"))
    out = near.select(
        *KEY, "t", "lane_idx", F.when(use, F.col("proj")).otherwise(F.col("near")).alias("distance"),
        F.when(use, F.col("along")).otherwise(F.col("idx")).alias("point_idx"),
        *[F.when(use, F.col(f"foot_{c}")).otherwise(F.col(f"at_{c}")).alias(f"proj_{c}") for c in "xyz"])
    order = Window.partitionBy(*KEY, "t").orderBy("distance", "lane_idx")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def polyline_directions(map_points: DataFrame, *, min_points: int = 2) -> DataFrame:
    """Adds the unit direction from the previous point (first point zero); drops features with too few points."""
    feat = ["scenario_id", "feature_class", "feature_idx"]
    w = Window.partitionBy(*feat).orderBy("point_idx")
    df = map_points.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*feat))).filter(
        F.col("_n") >= min_points)
    df = df.withColumns({f"_{c}": F.col(c) - F.coalesce(F.lag(c).over(w), F.col(c)) for c in "xyz"})
    size = F.greatest(X.norm3(F.col("_x"), F.col("_y"), F.col("_z")), X.lit_d(EPS))
    return df.withColumns({f"d{c}": F.col(f"_{c}") / size for c in "xyz"}).drop("_n", "_x", "_y", "_z")


def feature_ranges(map_points: DataFrame) -> DataFrame:
    """[start, end) of each feature in the scene's concatenated point list, in (class, index) order."""
    n = map_points.groupBy("scenario_id", "feature_class", "feature_idx").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("scenario_id").orderBy("feature_class", "feature_idx").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    end = F.sum("n").over(w)
    return n.select("scenario_id", "feature_class", "feature_idx", (end - F.col("n")).alias("start"), end.alias("end"))


def heading_directions(df: DataFrame, heading: str = "heading") -> DataFrame:
    return df.withColumn("dir_x", F.cos(heading)).withColumn("dir_y", F.sin(heading))


def crop_to_ego(
    points: DataFrame, scenarios: DataFrame, map_points: DataFrame, *, margin: float = 50.0, shape: str = "box"
) -> DataFrame:
    """Map points near the ego path: bounding box plus margin, or a circle of half the box diagonal plus margin."""
    ego = points.join(scenarios.select("scenario_id", F.col("ego_idx").alias("agent_idx")), KEY, "left_semi")
    ok = X.is_valid(F.col("valid"))

    def over(f, c):
        return F.coalesce(f(F.when(ok, F.col(c))), f(c))

    box = ego.groupBy("scenario_id").agg(
        over(F.min, "x").alias("x0"), over(F.max, "x").alias("x1"), over(F.min, "y").alias("y0"),
        over(F.max, "y").alias("y1"))
    df = map_points.join(box, "scenario_id")
    if shape == "box":
        keep = (F.col("x").between(F.col("x0") - margin, F.col("x1") + margin)
                & F.col("y").between(F.col("y0") - margin, F.col("y1") + margin))
    elif shape == "circle":
        r = 0.5 * X.norm2(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + margin
        keep = X.norm2(F.col("x") - (F.col("x0") + F.col("x1")) / 2, F.col("y") - (F.col("y0") + F.col("y1")) / 2) <= r
    else:
        raise ValueError(f"unknown crop shape {shape!r}")
    return df.filter(keep).drop("x0", "x1", "y0", "y1")


def entity_counts(agents: DataFrame, map_points: DataFrame, conflicts: DataFrame, signals: DataFrame) -> DataFrame:
    """Agents, map points, conflict points and stop points per scene; missing parts count as zero."""
    tagged = None
    for name, df in (("agents", agents), ("map_points", map_points), ("conflict_points", conflicts),
                     ("stop_points", signals)):
        part = df.select("scenario_id", F.lit(name).alias("what"))
        tagged = part if tagged is None else tagged.unionByName(part)
    names = ("agents", "map_points", "conflict_points", "stop_points")
    return tagged.groupBy("scenario_id").agg(
        *[F.count(F.when(F.col("what") == n, 1)).alias(f"num_{n}") for n in names])
