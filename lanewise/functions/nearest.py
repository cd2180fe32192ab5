"""Nearest targets of a scene by rings of grid cells.

Queries and targets are cut into square cells; a query meets the targets of its own cell and of the eight around it. Any target outside of
these is farther away than a cell is wide, so what is found within that distance is final. Only the queries for which that isn't
enough meet a wider ring: cells GROWTH times as wide. How wide the first cells of a scene are follows from the density of its
targets. Cells are counted from the queries, so map parts that no query is near are never moved, and a scene is spread over as many
tasks as it has occupied cells.

Its joins ask for sort-merge: queries, targets, widths and cells all grow with the scenes, but compress so well that Spark would broadcast
one side through the driver.

Within a cell the comparison is a matrix operation in an Arrow task. Rows of queries and targets arrive sorted by cell, targets first; a task
holds the targets of one block of nine cells and PAIRS distances at a time, however many queries a cell has.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lanewise.session import materialize

#: Least width of the cells of the first ring in metres, growth from ring to ring, and distances that a task computes at once.
CELL, GROWTH, PAIRS = 10.0, 16.0, 1 << 21
_CELL = ["scenario_id", "_cx", "_cy"]
Columns = dict[str, np.ndarray]
#: (queries, targets of the block, distance within which the targets are complete) -> result columns, `query` being the index of their
#: query, and which queries are done. Targets come sorted by cell order only.
Kernel = Callable[[Columns, Columns, float], tuple[Columns, np.ndarray]]


def _numpy(batch: pa.RecordBatch, names: list[str]) -> Columns:
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}


def _block_task(kernel: Kernel, q_names: list[str], t_names: list[str], out: list[tuple[str, pa.DataType]]):
    schema = pa.schema([("scenario_id", pa.int64()), *out, ("_done", pa.bool_())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, parts = None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            at = [batch.column(c).to_numpy() for c in (*_CELL, "_query")]
            cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in at], axis=0)) + 1
            for begin, end in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
                rows, own = batch.slice(begin, end - begin), tuple(x[begin] for x in at[:3])
                if own != key:
                    key, block, parts = own, None, []
                if not at[3][begin]:
                    parts.append(_numpy(rows, [f"t_{c}" for c in t_names]))
                    continue
                if block is None:
                    block = {c: np.concatenate([p[f"t_{c}"] for p in parts]) if parts else np.zeros(0) for c in t_names}
                    parts = []
                step, reach = max(1, PAIRS // max(1, len(block["x"]))), rows.column("_w")[0].as_py()
                for a in range(0, rows.num_rows, step):
                    q = _numpy(rows.slice(a, step), q_names)
                    found, done = kernel(q, block, reach)
                    # Queries that aren't done go on as they came.
                    left = np.flatnonzero(~done)
                    which = np.concatenate((found.pop("query"), left))
                    n = len(which) - len(left)
                    columns = [pa.array(np.full(len(which), own[0]), pa.int64())]
                    for name, kind in out:
                        x = q[name][which] if name in q else np.concatenate((found[name], np.zeros(len(left), found[name].dtype)))
                        columns.append(pa.array(x, kind, from_pandas=False))
                    yield pa.record_batch([*columns, pa.array(np.arange(len(which)) < n)], schema=schema)

    return task


_SQL = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double"}


def ring_join(queries: DataFrame, targets: DataFrame, scenes: DataFrame, kernel: Kernel, result: list[tuple[str, pa.DataType]], *,
              rings: int | None = None, name: str = "ring") -> DataFrame:
    """scenario_id, the columns of `queries` (scenario_id, x, y, and others; longs, ints and doubles without nulls) and those of `result`.

    `targets` has scenario_id, x, y and whatever the kernel reads, doubles without nulls; `scenes` has the width of the first cells of each
    scene with targets (scenario_id, width). Queries of other scenes vanish, so do those that aren't done after `rings` rings, if that
    is given; without it rings are widened until all are done. Each ring is stored, so a lost executor costs a part of one ring.
    """
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    own = [(f.name, kinds[f.dataType.simpleString()]) for f in queries.schema.fields if f.name != "scenario_id"] + [("_w", pa.float64())]
    q_names, t_names = [c for c, _ in own], [c for c in targets.columns if c != "scenario_id"]
    columns = [*own, *result]
    schema = "scenario_id long, " + ", ".join(f"{c} {_SQL[k]}" for c, k in columns) + ", _done boolean"
    width = scenes.select("scenario_id", F.col("width").cast("double").alias("_w"))
    pending = queries.join(width.hint("merge"), "scenario_id").select("scenario_id", *q_names)
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    cell = [F.floor(F.col(c) / F.col("_w")) for c in "xy"]
    found = []
    while True:
        rows = pending.select("*", cell[0].alias("_cx"), cell[1].alias("_cy"))
        wanted = rows.select(*_CELL).distinct().withColumn("_o", F.explode(around)).select(
            *_CELL, (F.col("_cx") + F.col("_o.a")).alias("_tx"), (F.col("_cy") + F.col("_o.b")).alias("_ty"))
        placed = targets.join(width.withColumn("_w", F.col("_w") * GROWTH ** len(found)).hint("merge"), "scenario_id").select(
            "scenario_id", *[F.col(c).cast("double").alias(f"t_{c}") for c in t_names], cell[0].alias("_tx"), cell[1].alias("_ty"))
        near = wanted.join(placed.hint("merge"), ["scenario_id", "_tx", "_ty"]).select(
            *_CELL, F.lit(0).alias("_query"), *[F.lit(None).cast(_SQL[k]).alias(c) for c, k in own], *[f"t_{c}" for c in t_names])
        asked = rows.select(*_CELL, F.lit(1).alias("_query"), *q_names, *[F.lit(None).cast("double").alias(f"t_{c}") for c in t_names])
        dealt = near.unionByName(asked).repartition(*_CELL).sortWithinPartitions(*_CELL, "_query")
        left = Observation()
        ring = materialize(dealt.mapInArrow(_block_task(kernel, q_names, t_names, columns), schema).observe(
            left, F.count(F.when(~F.col("_done"), 1)).alias("n")), name)
        found.append(ring.filter("_done").drop("_done", "_w"))
        if len(found) == rings or not left.get["n"]:
            break
        pending = ring.filter("NOT _done").withColumn("_w", F.col("_w") * GROWTH).select("scenario_id", *q_names)
    return reduce(DataFrame.union, found)


def cell_width(targets: DataFrame, count: Column, k: int = 1, least: float = CELL) -> DataFrame:
    """(scenario_id, width): three times the distance within which a query expects k of `count` evenly spread things, at most the scene's extent."""
    span = [F.max(c) - F.min(c) for c in "xy"]
    per = targets.groupBy("scenario_id").agg(count.alias("_n"), span[0].alias("_dx"), span[1].alias("_dy"))
    apart = F.sqrt((F.col("_dx") + least) * (F.col("_dy") + least) * k / F.col("_n") / math.pi)
    whole = F.greatest("_dx", "_dy")
    return per.select("scenario_id", F.greatest(F.lit(least), F.when(F.col("_n") <= k, whole).otherwise(F.least(3 * apart, whole))).alias("width"))


def sum_of_squares(d: list[np.ndarray]) -> np.ndarray:
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def distances(q: Columns, t: Columns) -> np.ndarray:
    """Of every query to every target."""
    return np.sqrt(sum_of_squares([q[c][:, None] - t[c][None] for c in "xyz"]))


def least_distance(q: Columns, t: Columns, reach: float) -> tuple[Columns, np.ndarray]:
    """Kernel: distance to the nearest target. A query that lies nowhere has none, a NaN."""
    if not len(t["x"]):
        low = np.full(len(q["x"]), np.inf)
    else:
        low = distances(q, t).min(1)
    nowhere = ~np.isfinite(q["x"] + q["y"] + q["z"])
    done = (low <= reach) | nowhere
    at = np.flatnonzero(done)
    return {"query": at, "distance": np.where(nowhere, np.nan, low)[at]}, done


def nearest_distance(queries: DataFrame, targets: DataFrame, *, within: float | None = None, name: str = "nearest") -> DataFrame:
    """`queries` (scenario_id, x, y, z, ids) with the distance to the nearest target (x, y, z) of their scene.

    With `within`, only the queries that have a target within that distance, from a single ring of that width.
    """
    real = ~F.isnan("x") & ~F.isnan("y") & ~F.isnan("z")
    targets = targets.select("scenario_id", "x", "y", "z").filter(real)
    scenes = cell_width(targets, F.count(F.lit(1)))
    if within:
        scenes = scenes.withColumn("width", F.lit(float(within)))
    return ring_join(queries, targets, scenes, least_distance, [("distance", pa.float64())], rings=1 if within else None, name=name)
