"""Stored artifacts: partitioned tables, merges, threshold files and reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lanewise.schema import THRESHOLDS
from lanewise.session import unmark


def write_branch(df: DataFrame, root: str, *, scenario_type: str, criterion: str, mode: str = "append") -> None:
    """Store one (scenario type, criterion) branch; readers prune by both."""
    df.withColumns({"scenario_type": F.lit(scenario_type), "criterion": F.lit(criterion)}).write.partitionBy(
        "scenario_type", "criterion").mode(mode).parquet(root)


def read_branches(
    spark: SparkSession, root: str, *, scenario_types: Sequence[str] | None = None,
    criteria: Sequence[str] | None = None, ids: DataFrame | None = None,
) -> DataFrame:
    df = spark.read.parquet(root)
    if scenario_types:
        df = df.filter(F.col("scenario_type").isin(list(scenario_types)))
    if criteria:
        df = df.filter(F.col("criterion").isin(list(criteria)))
    return df if ids is None else df.join(ids.select("scenario_id").distinct(), "scenario_id", "left_semi")


def upsert(old: DataFrame | None, new: DataFrame, key: Sequence[str], mode: str = "add", *, same_scenes: bool = False) -> DataFrame:
    """Merge a new snapshot: `overwrite` replaces, `add` fills only what is missing, `update` lets new values win.

    Null never replaces a value; rows absent from `new` are kept. With `same_scenes`, a scene of `new` that `old` doesn't have fails
    the job that computes the merge.
    """
    if same_scenes and old is not None:
        known = old.select("scenario_id").distinct().withColumn("_known", F.lit(True))
        stray = F.raise_error(F.concat(F.lit("scenario to merge is not stored: "), F.col("scenario_id").cast("string")))
        kind = new.schema["scenario_id"].dataType
        checked = F.when(F.col("_known"), F.col("scenario_id")).otherwise(stray.cast(kind))
        new = new.join(known, "scenario_id", "left").withColumn("scenario_id", checked).select(new.columns)
    if mode == "overwrite" or old is None:
        return new
    if mode not in ("add", "update"):
        raise ValueError(f"unknown merge mode {mode!r}")
    cols = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in key]
    o = old.select(*key, *[F.col(c).alias(f"o_{c}") for c in old.columns if c not in key])
    n = new.select(*key, *[F.col(c).alias(f"n_{c}") for c in new.columns if c not in key])

    def pick(c):
        sides = [f"o_{c}" for _ in (1,) if c in old.columns], [f"n_{c}" for _ in (1,) if c in new.columns]
        order = sides[0] + sides[1] if mode == "add" else sides[1] + sides[0]
        return F.coalesce(*order).alias(c)

    return o.join(n, list(key), "full_outer").select(*key, *[pick(c) for c in cols])


def pending(ids: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Ids that still need work."""
    ids = ids.select("scenario_id").distinct()
    return ids if stored is None else ids.join(stored.select("scenario_id").distinct(), "scenario_id", "left_anti")


def load_thresholds(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Threshold JSON files ({feature: {label: value}}), one per type, as one long table in file order.

    A missing file is an error. The order of labels matters; maps keep that of the document.
    """
    def one(kind: str, path: str) -> DataFrame:
        doc = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("feature", "cuts"))
        return doc.select(F.lit(kind).alias("type"), "feature", F.posexplode("cuts").alias("ord", "label", "value"))

    return reduce(DataFrame.unionByName, (one(k, p) for k, p in files.items())).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in THRESHOLDS.fields])


def thresholds_json(thresholds: DataFrame) -> DataFrame:
    """One JSON document per type: {feature: {label: value}}."""
    cuts = F.map_from_entries(F.transform(
        F.sort_array(F.collect_list(F.struct("ord", "label", "value"))), lambda s: F.struct(s["label"], s["value"])))
    per = thresholds.groupBy("type", "feature").agg(cuts.alias("cuts"))
    doc = F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", F.to_json("cuts").alias("cuts")))))
    parts = F.transform(F.map_entries("doc"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"]))
    return per.groupBy("type").agg(doc.alias("doc")).select(
        "type", F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("json"))


def score_mapping(scene_scores: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per scene, one column per score key, rounded to 3 decimals. Input: (scenario_id, key, scene_score)."""
    return scene_scores.groupBy("scenario_id").pivot("key", list(columns)).agg(
        F.round(F.max("scene_score"), 3))


def write_checked(df: DataFrame, path: str, rules: dict[str, Column], mode: str = "errorifexists") -> DataFrame:
    """Write a table while counting what breaks a rule, and return it read back.

    `rules` are aggregates that are 0 (or null) where all is well, see `ingest.row_rules` and `ingest.horizon_rule`; they are observed by the writing
    job itself. If one isn't, the success marker is taken away, so that :func:`lanewise.session.stored` builds the table anew, and the call raises.
    """
    seen = Observation()
    df.observe(seen, *[rule.alias(name) for name, rule in rules.items()]).write.mode(mode).parquet(path)
    broken = {name: n for name, n in seen.get.items() if n}
    if broken:
        unmark(df.sparkSession, path)
        raise ValueError(f"{path}: {broken}")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
