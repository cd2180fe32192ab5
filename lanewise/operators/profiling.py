"""Dataset-level profiles: thresholds, histograms, splits, counts, probe statistics.

What has a row per scene or agent is joined by sort-merge; what is broadcast has a row per group.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions import expr as X
from lanewise.functions.distributed import exact_percentiles, percentile_columns
from lanewise.operators.individual import valid_points
from lanewise.schema import (
    CATEGORIES, EPS, INDIVIDUAL_FEATURES, LARGE, PAIR_FEATURES, SCORED_STATUSES, AgentType, PairType,
)

KEY = ["scenario_id", "agent_idx"]
PROBE_COLUMNS = (
    "scenario_id", "probe_found", "probe_type", "is_ego_agent", "probed_agent_id", "score_before", "score_after",
    "score_delta", "affected_agent_ids",
)


def individual_long(features: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(type, feature, value) of vehicles, cyclists and pedestrians; the ego has no group of its own here.

    Unknown speed-limit differences and uncomputable forecast errors are left out.
    """
    kinds = (int(AgentType.VEHICLE), int(AgentType.CYCLIST), int(AgentType.PEDESTRIAN))
    df = features.filter(F.col("agent_type").isin(*kinds)).select(
        *keep, X.agent_type_name(F.col("agent_type")).alias("type"),
        F.explode(X.unpivot_features(INDIVIDUAL_FEATURES)).alias("f"),
    ).select(*keep, "type", "f.feature", "f.value")
    drop = ((F.col("feature") == "speed_limit_diff") & F.isnan("value")) | (
        (F.col("feature") == "kalman_difficulty") & (F.col("value") < 0))
    return df.filter(~F.coalesce(drop, F.lit(False)))


def pair_long(pairs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(type, feature, value) of computed pairs by pair type, with `inv_separation`; infinity becomes a large value."""
    df = pairs.filter(F.col("status").isin(*SCORED_STATUSES)).withColumn(
        "inv_separation", 1.0 / (F.col("separation") + EPS))
    names = ("inv_separation", *PAIR_FEATURES)
    out = df.select(
        *keep, X.pair_type_name(X.pair_type(F.col("type_i"), F.col("type_j"))).alias("type"),
        F.explode(X.unpivot_features(names)).alias("f")).select(*keep, "type", "f.feature", "f.value")
    return out.withColumn("value", F.when(F.abs("value") == X.INF, LARGE).otherwise(F.col("value")))


def _boundaries(categories):
    """[(label, percentile, [fallback percentiles])] between consecutive categories."""
    out = []
    for (name, hi), (nxt, nxt_hi) in zip(categories, categories[1:], strict=False):
        steps, p, mid = [], hi + 0.5, (hi + nxt_hi) / 2
        while p < mid + 0.5:
            steps.append(p)
            p += 0.5
        out.append((f"{name}/{nxt}", hi, steps))
    return out


def category_thresholds(long: DataFrame, keys: Sequence[str], categories=CATEGORIES, value: str = "value") -> DataFrame:
    """(keys, ord, label, value): percentile boundaries rounded to 2 decimals.

    A boundary equal to the one before takes the first greater value found up to half way to the next boundary. Groups
    with a NaN have NaN boundaries.
    """
    keys = list(keys)
    bounds = _boundaries(categories)
    wanted = sorted({p for _, hi, steps in bounds for p in (hi, *steps)})
    pct = exact_percentiles(long, keys, value, wanted)
    table = pct.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("p", "percentile"))).alias("m"))

    def at(p: float) -> Column:
        return X.round_half_even(F.try_element_at("m", F.lit(float(p))), 2)

    df, prev = table, None
    for n, (_, hi, steps) in enumerate(bounds):
        v = at(hi)
        if prev is not None and steps:
            greater = F.filter(F.array(*[at(p) for p in steps]), lambda c: c > F.col(prev))
            v = F.when(v == F.col(prev), F.coalesce(F.get(greater, F.lit(0)), v)).otherwise(v)
        df, prev = df.withColumn(f"b{n}", v), f"b{n}"
    nan = long.filter(F.isnan(value)).select(*keys).distinct().withColumn("_nan", F.lit(True))
    cell = [F.struct(F.lit(n).alias("ord"), F.lit(b[0]).alias("label"), F.col(f"b{n}").alias("value"))
            for n, b in enumerate(bounds)]
    return (
        df.join(nan, keys, "left").select(*keys, "_nan", F.explode(F.array(*cell)).alias("c"))
        .select(*keys, "c.ord", "c.label", F.when(F.col("_nan"), X.lit_d(X.NAN)).otherwise(F.col("c.value")).alias("value"))
    )


def histogram(long: DataFrame, keys: Sequence[str], bins: int = 20, value: str = "value") -> DataFrame:
    """Equal-width density histogram per key; the last bin is closed. Constant data gets a unit-wide range."""
    keys = list(keys)
    clean = long.filter(F.col(value).isNotNull() & ~F.isnan(value))
    span = clean.groupBy(*keys).agg(
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("n"))
    flat = F.col("lo") == F.col("hi")
    span = span.withColumns({"a": F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")),
                             "b": F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))})
    width = (F.col("b") - F.col("a")) / float(bins)
    pos = F.floor((F.col(value) - F.col("a")) / width)
    # One row per key: types and features, not scenes.
    binned = clean.join(F.broadcast(span), keys).withColumn(
        "bin", F.least(F.greatest(pos, F.lit(0)), F.lit(bins - 1)).cast("int"))
    got = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(got, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("a") + F.col("bin") * width).alias("lower"),
        F.coalesce("count", F.lit(0)).alias("count"),
        (F.coalesce("count", F.lit(0)) / (F.col("n") * width)).alias("density"))


def score_thresholds(agent_scores: DataFrame, keys: Sequence[str] = ("scorer",), categories=CATEGORIES) -> DataFrame:
    """Category boundaries of the valid, non-negative agent scores per score key."""
    ok = agent_scores.filter(F.coalesce("valid", F.lit(False)) & (F.col("score") >= 0))
    return category_thresholds(ok, keys, categories, "score")


ALL_DATASETS = "all"


def per_dataset(df: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Rows of scenes once under their dataset and once under the combined view; analyses then take `by=("dataset",)`."""
    own = scenarios.select("scenario_id", F.explode(F.array("dataset", F.lit(ALL_DATASETS))).alias("dataset"))
    return df.drop("dataset").join(own.hint("merge"), "scenario_id")


def complete_scenes(scenes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(scenario_id, complete): does the scene have a non-null score for every requested key?"""
    good = F.col("scene_score").isNotNull() & F.col("key").isin(list(keys))
    return scenes.groupBy("scenario_id").agg(
        (F.count_distinct(F.when(good, F.col("key"))) == len(keys)).alias("complete"))


def complete_only(scenes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The score rows of complete scenes; the others have no place in splits, overlaps and score thresholds."""
    return scenes.join(complete_scenes(scenes, keys).filter("complete").select("scenario_id").hint("merge"), "scenario_id", "left_semi")


def scene_splits(scenes: DataFrame, percentile: float = 80.0, by: Sequence[str] = ()) -> DataFrame:
    """(by, key, scenario_id, scene_score, out_of_distribution) at a percentile of the 3-decimal scene scores."""
    rounded = scenes.select(*by, "key", "scenario_id", F.round("scene_score", 3).alias("scene_score"))
    cut = exact_percentiles(rounded, [*by, "key"], "scene_score", [percentile]).select(
        *by, "key", F.col("percentile").alias("cut"))
    # One row per score key (and dataset).
    return rounded.join(F.broadcast(cut), [*by, "key"]).select(
        *by, "key", "scenario_id", "scene_score", (F.col("scene_score") >= F.col("cut")).alias("out_of_distribution"))


def split_sizes(splits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    out = F.col("out_of_distribution")
    return splits.groupBy(*by, "key").agg(
        F.count(F.when(~out, 1)).alias("num_in_distribution"), F.count(F.when(out, 1)).alias("num_out_of_distribution"))


def jaccard(splits: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Jaccard index of the out-of-distribution sets of every pair of score keys (0 for two empty sets)."""
    flags = splits.groupBy(*by, "scenario_id").pivot("key", list(keys)).agg(F.max("out_of_distribution"))
    for k in keys:
        flags = flags.withColumn(k, F.coalesce(k, F.lit(False)))
    aggs = []
    for a, b in combinations(keys, 2):
        aggs += [F.count(F.when(F.col(a) & F.col(b), 1)).alias(f"{a}&{b}"),
                 F.count(F.when(F.col(a) | F.col(b), 1)).alias(f"{a}|{b}")]
    one = flags.groupBy(*by).agg(*aggs) if by else flags.agg(*aggs)
    rows = [F.struct(
        F.lit(a).alias("a"), F.lit(b).alias("b"),
        F.when(F.col(f"`{a}|{b}`") > 0, F.col(f"`{a}&{b}`") / F.col(f"`{a}|{b}`")).otherwise(0.0).alias("jaccard"))
        for a, b in combinations(keys, 2)]
    return one.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")


def score_grid(agent_scores: DataFrame, scorers: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Counts of truncated agent scores over two or three scorers, optionally per agent type.

    `agent_scores` is wide: one `<scorer>` column per scorer plus `individual_valid` and `interaction_valid`; only
    agents valid for both count, negative scores are skipped.
    """
    df = agent_scores.filter(F.col("individual_valid") & F.col("interaction_valid"))
    for s in scorers:
        df = df.withColumn(s, F.col(s).cast("int")).filter(F.col(s) >= 0)
    return df.groupBy(*by, *scorers).agg(F.count(F.lit(1)).alias("agents"))


def wide_agent_scores(long: DataFrame) -> DataFrame:
    """(scenario_id, agent_idx, individual, interaction, combined, individual_valid, interaction_valid)."""
    picks = [F.max(F.when(F.col("scorer") == s, F.col("score"))).alias(s)
             for s in ("individual", "interaction", "combined")]
    flags = [F.coalesce(F.max(F.when(F.col("scorer") == s, F.col("valid"))), F.lit(False)).alias(f"{s}_valid")
             for s in ("individual", "interaction")]
    return long.groupBy(*KEY).agg(*picks, *flags)


def count_columns() -> list[str]:
    out = ["pairs_with_ego_total", "pairs_with_ego_valid"]
    for a in AgentType:
        out += [f"agents_total_{a.name}", f"agents_valid_{a.name}"]
    for p in PairType:
        out += [f"pairs_total_{p.name}", f"pairs_valid_{p.name}"]
    return out


def scenario_counts(
    scenarios: DataFrame, agents: DataFrame | None = None, individual: DataFrame | None = None,
    pairs: DataFrame | None = None, totals: DataFrame | None = None,
) -> DataFrame:
    """One row per scene: agents and pairs by type, in all and valid, and pairs with the ego. Missing halves are zero.

    `pairs` lists pairs with a status; when it lists near pairs only, `totals` (scenario_id, pair_type, pairs,
    with_ego) gives the number of enumerated pairs.
    """
    def rows(df, what, n=F.lit(1)):
        return df.select("scenario_id", what.alias("what"), n.cast("long").alias("n"))

    parts = []
    if agents is not None:
        parts.append(rows(agents, F.concat(F.lit("agents_total_"), X.agent_type_name(F.col("agent_type")))))
    if individual is not None:
        parts.append(rows(individual, F.concat(F.lit("agents_valid_"), X.agent_type_name(F.col("agent_type")))))
    if pairs is not None:
        ego = (F.col("type_i") == int(AgentType.EGO_AGENT)) | (F.col("type_j") == int(AgentType.EGO_AGENT))
        name = X.pair_type_name(X.pair_type(F.col("type_i"), F.col("type_j")))
        valid = pairs.filter(F.col("status").isin(*SCORED_STATUSES))
        parts += [rows(valid, F.concat(F.lit("pairs_valid_"), name)),
                  rows(valid.filter(ego), F.lit("pairs_with_ego_valid"))]
        if totals is None:
            parts += [rows(pairs, F.concat(F.lit("pairs_total_"), name)),
                      rows(pairs.filter(ego), F.lit("pairs_with_ego_total"))]
    if totals is not None:
        parts += [rows(totals, F.concat(F.lit("pairs_total_"), X.pair_type_name(F.col("pair_type"))), F.col("pairs")),
                  rows(totals, F.lit("pairs_with_ego_total"), F.col("with_ego"))]
    base = scenarios.select("scenario_id", "dataset")
    cols = count_columns()
    if not parts:
        return base.select("*", *[F.lit(0).cast("long").alias(c) for c in cols])
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    wide = long.groupBy("scenario_id").pivot("what", cols).agg(F.sum("n"))
    return base.join(wide.hint("merge"), "scenario_id", "left").na.fill(0, cols)


def dataset_counts(counts: DataFrame) -> DataFrame:
    """Totals per dataset plus one grand total (dataset null)."""
    return counts.rollup("dataset").agg(
        F.count(F.lit(1)).alias("num_scenarios_counted"), *[F.sum(c).alias(c) for c in count_columns()])


def coverage(scenarios: DataFrame, counted: DataFrame) -> DataFrame:
    """Scenes present against scenes counted, per dataset."""
    a = scenarios.groupBy("dataset").agg(F.count_distinct("scenario_id").alias("present"))
    b = counted.groupBy("dataset").agg(F.count_distinct("scenario_id").alias("counted"))
    return a.join(b, "dataset", "full_outer").na.fill(0, ["present", "counted"])


def counts_long(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(dataset, scenario_id, column, value)."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
    return counts.select("dataset", "scenario_id", F.explode(cells).alias("c")).select(
        "dataset", "scenario_id", "c.column", "c.value")


def interquartile_mean(long: DataFrame) -> DataFrame:
    """Mean of the values within the quartiles (inclusive) per (dataset, column), with the total."""
    keys = ["dataset", "column"]
    q = percentile_columns(long, keys, "value", {"q1": 25.0, "q3": 75.0})
    inside = F.when(F.col("value").between(F.col("q1"), F.col("q3")), F.col("value"))
    # One row per dataset and count column.
    return long.join(F.broadcast(q), keys).groupBy(*keys).agg(
        F.coalesce(F.avg(inside), F.lit(0.0)).alias("iqm"), F.sum("value").alias("total"))


def count_quartiles(long: DataFrame) -> DataFrame:
    """Box statistics of per-scene counts."""
    return percentile_columns(
        long, ["dataset", "column"], "value", {"low": 0.0, "q1": 25.0, "median": 50.0, "q3": 75.0, "high": 100.0})


def ego_scoped(totals: DataFrame) -> DataFrame:
    """Does every valid pair of every dataset involve the ego?"""
    valid = sum((F.col(f"pairs_valid_{p.name}") for p in PairType), F.lit(0))
    return totals.agg(F.bool_and(F.col("pairs_with_ego_valid") == valid).alias("ego_scoped"))


def composition(totals: DataFrame, prefix: str, names: Sequence[str]) -> DataFrame:
    """Percentage of each selected type within its dataset; 0 where the dataset has none of them."""
    whole = sum((F.col(f"{prefix}{n}") for n in names), F.lit(0))
    cells = F.array(*[F.struct(
        F.lit(n).alias("type"),
        F.when(whole > 0, 100.0 * F.col(f"{prefix}{n}") / whole).otherwise(0.0).alias("share")) for n in names])
    return totals.select("dataset", F.explode(cells).alias("c")).select("dataset", "c.type", "c.share")


def check_probe_columns(df: DataFrame) -> None:
    missing = [c for c in PROBE_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing probe columns: {missing}")


def probed_rows(summary: DataFrame) -> DataFrame:
    """Rows with a probe: numeric scores (unparsable text is null) and the number of affected agents."""
    check_probe_columns(summary)
    df = summary.filter(F.col("probe_found") == "yes")
    for c in ("score_before", "score_after", "score_delta"):
        df = df.withColumn(c, F.col(c).try_cast("double"))
    ids = F.trim(F.coalesce("affected_agent_ids", F.lit("")))
    return df.withColumn("n_affected", F.when(ids == "", 0).otherwise(F.size(F.split("affected_agent_ids", ";"))))


def probe_outcomes(summary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(outcome, scenes, share) for none, ego and non-ego probes."""
    found = F.col("probe_found") == "yes"
    tests = {"no_probe": F.col("probe_found") == "no", "ego": found & (F.col("is_ego_agent") == "yes"),
             "non_ego": found & (F.col("is_ego_agent") == "no")}
    one = summary.groupBy(*by).agg(
        *[F.count(F.when(t, 1)).alias(n) for n, t in tests.items()], F.count(F.lit(1)).alias("_all"))
    cells = F.array(*[F.struct(
        F.lit(n).alias("outcome"), F.col(n).alias("scenes"),
        (100.0 * F.col(n) / F.greatest(F.col("_all"), F.lit(1))).alias("share")) for n in tests])
    return one.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")


def probe_statistics(summary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Probe rate and the distribution of the score change: one row, or one per group."""
    keys = list(by) or ["_one"]
    if not by:
        summary = summary.withColumn("_one", F.lit(1))
    probed = probed_rows(summary)
    base = summary.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_scenarios")) if by else summary.agg(
        F.count(F.lit(1)).alias("total_scenarios")).withColumn("_one", F.lit(1))
    d = F.col("score_delta")
    stats = probed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_probed"), F.count(F.when(F.col("is_ego_agent") == "yes", 1)).alias("n_ego_probe"),
        F.count(F.when(F.col("is_ego_agent") == "no", 1)).alias("n_non_ego_probe"),
        F.round(F.avg(d), 6).alias("delta_mean"), F.round(F.stddev_samp(d), 6).alias("delta_std"),
        F.round(F.min(d), 6).alias("delta_min"), F.round(F.max(d), 6).alias("delta_max"))
    med = percentile_columns(probed, keys, "score_delta", {"m": 50.0}).select(*keys, F.round("m", 6).alias("delta_median"))
    joined = base.join(stats, keys, "left").join(med, keys, "left").na.fill(0, ["n_probed", "n_ego_probe", "n_non_ego_probe"])
    return joined.select(
        *by, "total_scenarios", "n_probed", (F.col("total_scenarios") - F.col("n_probed")).alias("n_no_probe"),
        F.when(F.col("total_scenarios") > 0, F.round(F.col("n_probed") / F.col("total_scenarios"), 4)).otherwise(0.0)
        .alias("probe_rate"),
        "n_ego_probe", "n_non_ego_probe", "delta_mean", "delta_std", "delta_median", "delta_min", "delta_max")


def top_probes(summary: DataFrame, n: int = 10) -> DataFrame:
    """The n scenes with the greatest score increase (ties by scenario id)."""
    return probed_rows(summary).orderBy(F.col("score_delta").desc(), "scenario_id").limit(n)


def delta_quartiles(summary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return percentile_columns(
        probed_rows(summary), [*by, "is_ego_agent"], "score_delta",
        {"low": 0.0, "q1": 25.0, "median": 50.0, "q3": 75.0, "high": 100.0})


def affected_counts(summary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return probed_rows(summary).groupBy(*by, "is_ego_agent", "n_affected").agg(F.count(F.lit(1)).alias("scenes"))


def score_bound(summary: DataFrame, column: str = "score_before", by: Sequence[str] = ()) -> DataFrame:
    """Pooled maximum of a probe score with a 2 % margin; 1.0 when there is none. By group, groups without a probe have no row."""
    return probed_rows(summary).groupBy(*by).agg(F.coalesce(F.max(column) * 1.02, F.lit(1.0)).alias("bound"))


def percentile_folders(
    scores: DataFrame, wanted: DataFrame, percentiles: Sequence[float] = (10, 50, 80), by: Sequence[str] = (),
) -> DataFrame:
    """(scenario_id, folder) by percentile range of the scene score, of all scenes or of those of a group; scenes without a score go to `unknown`."""
    edges, keys = [0, *percentiles, 100], list(by) or ["_one"]
    if not by:
        scores, wanted = (df.withColumn("_one", F.lit(1)) for df in (scores, wanted))
    cuts = percentile_columns(scores, keys, "scene_score", {f"p{n}": float(p) for n, p in enumerate(edges)})
    df = wanted.select("scenario_id", *keys).join(scores.select("scenario_id", *keys, "scene_score").hint("merge"), ["scenario_id", *keys], "left")
    df = df.join(F.broadcast(cuts), keys, "left")  # one row per group
    folder = F.when(F.col("scene_score").isNull(), "unknown")
    for n in range(1, len(edges)):
        name = f"percentile_{edges[n - 1]}-{edges[n]}"
        folder = folder.when(F.col("scene_score") < F.col(f"p{n}"), name) if n < len(edges) - 1 else folder.otherwise(name)
    return df.select("scenario_id", *by, folder.alias("folder"))


def normalized_scores(
    agent_scores: DataFrame, scenarios: DataFrame, *, low: float = 0.05, high: float = 1.0,
    bounds: tuple[float, float] | None = None,
) -> DataFrame:
    """Agent scores scaled to [low, high] within their scene (or given bounds); equal scores share 1/n, the ego is `high`."""
    clean = F.when(~F.isnan("score"), F.col("score"))
    per = agent_scores.groupBy("scenario_id").agg(
        F.min(clean).alias("lo"), F.max(clean).alias("hi"), F.count(F.lit(1)).alias("n"))
    df = agent_scores.join(per.hint("merge"), "scenario_id").join(scenarios.select("scenario_id", "ego_idx").hint("merge"), "scenario_id")
    lo, hi = (F.col("lo"), F.col("hi")) if bounds is None else (X.lit_d(bounds[0]), X.lit_d(bounds[1]))
    v = F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(1.0 / F.col("n"))
    v = F.least(F.greatest(v, X.lit_d(low)), X.lit_d(high))
    return df.select(*KEY, F.when(F.col("agent_idx") == F.col("ego_idx"), high).otherwise(v).alias("alpha"))


def ego_path_ends(points: DataFrame, scenarios: DataFrame) -> DataFrame:
    """First and last valid finite ego position and the straight distance between them; needs two such rows."""
    ego = valid_points(points).join(
        scenarios.select("scenario_id", F.col("ego_idx").alias("agent_idx")), KEY, "left_semi")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < X.INF)
    agg = ego.filter(finite("x") & finite("y")).groupBy("scenario_id").agg(
        F.min(F.struct("t", "x", "y")).alias("a"), F.max(F.struct("t", "x", "y")).alias("b"),
        F.count(F.lit(1)).alias("n"))
    return agg.filter(F.col("n") >= 2).select(
        "scenario_id", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"),
        F.col("b.y").alias("y1"),
        X.norm2(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")).alias("displacement"))
