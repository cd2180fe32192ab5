"""Headline timings on the derived scenes: python bench.py prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and threads. The canonical tables are
written first and timed as `ingest`; every other entry computes its result from them in full.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lanewise.session import RECOMMENDED_CONF


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("lanewise-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    if "spark.checkpoint.dir" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("OFF")

    from lanewise.operators import individual as I
    from lanewise.operators import maps as M
    from lanewise.operators import pairs as P
    from lanewise.operators import probing as C
    from lanewise.operators import profiling as A
    from lanewise.plans import jobs
    from lanewise.plans.catalog import PIPE, PROBE, Data
    from lanewise.session import materialize

    d = Data(spark, sf_dir)
    times: dict[str, float] = {}

    def timed(name, run):
        t = time.time()
        out = run()
        times[name] = round(time.time() - t, 3)
        return out

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    # Starting the first jobs loads and compiles code and starts the Python workers; that is not ingest.
    timed("warm_up", lambda: [drain(spark.range(1000).selectExpr("id % 7 AS k", "id").groupBy("k").sum("id")),
                              drain(spark.range(1000).mapInArrow(lambda batches: batches, "id long"))])
    timed("ingest", lambda: [d.points, d.scenarios, d.agents, d.map_points, d.lanes, d.signals])
    t = d.tables
    timed("motion_features", lambda: drain(I.individual_features(t.points, t.scenarios)))
    ind = timed("individual_with_map", lambda: materialize(
        jobs.individual(t, threshold=0.5, stage=materialize), "ind"))
    pairs = timed("pairs_ego", lambda: materialize(P.pair_features(t.points, t.scenarios, scope="ego"), "pairs"))
    timed("pairs_all", lambda: drain(P.pair_features(t.points, t.scenarios, scope="all")))
    timed("closest_lanes", lambda: drain(M.closest_lanes(t.points, t.map_points)))
    agent, scene = timed("scores", lambda: [materialize(x, "s") for x in jobs.scores(
        t, ind, pairs, PIPE, stage=materialize)])
    timed("thresholds", lambda: drain(A.category_thresholds(
        A.individual_long(ind).unionByName(A.pair_long(pairs)), ["type", "feature"])))
    timed("splits", lambda: drain(A.scene_splits(scene.withColumnRenamed("scorer", "key"))))
    timed("counts", lambda: drain(A.dataset_counts(A.scenario_counts(t.scenarios, t.agents, ind, pairs))))
    timed("probes", lambda: drain(C.find_probes(t.points, t.agents, t.scenarios, PROBE, stage=materialize)))
    n = t.points.agg(F.count(F.lit(1))).collect()[0][0]
    total = round(sum(v for k, v in times.items() if k != "warm_up"), 3)
    print(json.dumps({
        "metric": "feature_score_profile_probe_total", "value": total, "unit": "sec", "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "points": n,
        "points_per_sec": {k: round(n / max(v, 1e-3)) for k, v in times.items() if k != "warm_up"},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
