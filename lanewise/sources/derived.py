"""Engine-shaped tables derived from the provided `events` table.

Ten neighbouring users form one group. Each user's events in time order are cut into scenes of 40 steps, so every event
is used and a scene never holds more than 10 agents x 40 steps, however busy one user is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.functions.distributed import balanced_row_number
from lanewise.schema import AgentType

STEPS = 40
CURRENT = 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw observations: events with their position in the user's timeline."""
    e = table(spark, sf_dir, "events").select(
        "user_id", "event_id", "ts", "event_type", "value",
        F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("k"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
    )
    e = balanced_row_number(e, ["user_id"], "ts_us", ["event_id"], out="rn")
    return e.withColumn("seq", F.col("rn") - 1).drop("rn")


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, u = F.col("agent_idx"), F.col("user_id")
    t = F.col("t").cast("double")
    step = F.when(a.isin(2, 8), 0.0).when(a == 4, -0.8).otherwise(0.1 * (5 + u % 7).cast("double"))
    moving = ~a.isin(2, 8)
    base = frames(spark, sf_dir).select(
        ((u - u % 10) * F.lit(1_000_000_000).cast("long") + F.expr(f"seq div {STEPS}")).alias("scenario_id"),
        F.when((u - u % 10) % 20 == 0, "alpha").otherwise("beta").alias("dataset"),
        (u % 10).alias("agent_idx"), u.alias("agent_id"), (F.col("seq") % STEPS).cast("int").alias("t"),
        "user_id", "k", "value", "event_type",
    )
    base = base.withColumn("ego_idx", F.min("agent_idx").over(Window.partitionBy("scenario_id")))
    kind = (
        F.when(a == F.col("ego_idx"), int(AgentType.EGO_AGENT))
        .when(a.isin(3, 7), int(AgentType.PEDESTRIAN)).when(a == 5, int(AgentType.CYCLIST))
        .when(a.isin(8, 9), int(AgentType.OTHER)).otherwise(int(AgentType.VEHICLE))
    )
    return base.select(
        "scenario_id", "dataset", "agent_idx", "agent_id", "ego_idx", "t", kind.alias("agent_type"),
        (t * 0.1 + (F.col("k") % 3).cast("double") * 0.01).alias("ts_s"),
        (a.cast("double") * 6.0 + F.when(a == 9, 500.0).otherwise(0.0) + step * t).alias("x"),
        ((F.col("k") % 5).cast("double") * 0.2 + F.when(a == 6, 0.05 * t * t).otherwise(0.0)).alias("y"),
        F.lit(0.0).alias("z"), F.lit(4.5).alias("length"), F.lit(2.0).alias("width"), F.lit(1.5).alias("height"),
        F.when(a == 4, 3.141592653589793).when(a == 6, 0.05 * t)
        .otherwise(0.01 * (F.col("k") % 7).cast("double")).alias("heading"),
        (F.when(~moving, 0.0).when(a == 4, -8.0).otherwise((5 + u % 7).cast("double"))
         + F.when(moving, F.sqrt(F.abs("value")) * 0.1).otherwise(0.0)).alias("vx"),
        F.when(a == 6, t).otherwise(0.0).alias("vy"),
        (F.col("event_type") != "error").alias("valid"),
    )


def scenarios(points: DataFrame) -> DataFrame:
    return points.groupBy("scenario_id").agg(
        F.first("dataset").alias("dataset"), F.min("agent_idx").alias("ego_idx"),
        F.lit(CURRENT).alias("current_time_index"), F.lit(10.0).alias("frequency_hz"),
        (F.max("t") + 1).cast("int").alias("n_steps"),
    )


def agents(points: DataFrame) -> DataFrame:
    """One row per agent; difficulty is 0/1/2 for vehicles, cyclists and the rest, unset for type other."""
    kind = F.col("agent_type")
    diff = F.when(kind == 4, F.lit(None).cast("int")).when(kind == 1, 0).when(kind == 3, 1).otherwise(2)
    return points.groupBy("scenario_id", "agent_idx").agg(
        F.first("dataset").alias("dataset"), F.first("agent_id").alias("agent_id"),
        F.first("agent_type").alias("agent_type"), F.first("ego_idx").alias("ego_idx"),
    ).withColumn("difficulty", diff)


def map_points(scenes: DataFrame) -> DataFrame:
    """Four parallel lanes, one crossing lane (25 points each) and one crosswalk per scene."""
    s = scenes.select("scenario_id")
    f, p = F.col("feature_idx"), F.col("point_idx")
    pd_ = p.cast("double")
    lanes_ = s.select(
        "scenario_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("feature_idx"))
    lanes_ = lanes_.select(
        "scenario_id", "feature_idx",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))).alias("point_idx"),
    ).select(
        "scenario_id", F.lit("lane").alias("feature_class"), "feature_idx", "point_idx",
        F.when(f == 4, 40.0).otherwise(4.0 * pd_).alias("x"),
        F.when(f == 4, 2.0 * pd_ - 24.1).otherwise(3.5 * (f - 2).cast("double") + 0.1).alias("y"),
        F.lit(0.0).alias("z"), F.lit(2).alias("polyline_type"),
    )
    walk = s.select(
        "scenario_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("point_idx"),
    ).select(
        "scenario_id", F.lit("crosswalk").alias("feature_class"), F.lit(0).cast("long").alias("feature_idx"),
        "point_idx", (20.0 + (p % 2).cast("double") * 3.0).alias("x"), ((p - p % 2).cast("double") - 5.0).alias("y"),
        F.lit(0.0).alias("z"), F.lit(18).alias("polyline_type"),
    )
    return lanes_.unionByName(walk)


def lanes(scenes: DataFrame, *, with_gap: bool = False) -> DataFrame:
    """Five lanes per scene; `with_gap` leaves the limit of lane 4 unknown."""
    s = scenes.select("scenario_id")
    idx = F.col("lane_idx")
    out = s.select(
        "scenario_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("lane_idx"))
    limit = 25.0 + 5.0 * idx.cast("double")
    return out.withColumn("lane_id", idx + 100).withColumn(
        "speed_limit_mph", F.when(idx == 4, F.lit(None).cast("double")).otherwise(limit) if with_gap else limit)


def signals(scenes: DataFrame, n: int = 5) -> DataFrame:
    """One stop point per lane at steps 3 and 7 (nothing before)."""
    s = scenes.select("scenario_id")
    out = s.select(
        "scenario_id",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("lane_idx"))
    out = out.withColumn("t", F.explode(F.array(F.lit(3), F.lit(7))))
    return out.select(
        "scenario_id", "t", (F.col("lane_idx") + 100).alias("lane_id"), F.lit(4).alias("state"),
        (30.0 + F.col("lane_idx").cast("double") + F.col("t").cast("double") * 0.0).alias("x"),
        (3.5 * (F.col("lane_idx") - 2).cast("double") + 0.3).alias("y"), F.lit(0.0).alias("z"),
    )
