"""Distributed union-find over link tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import materialize


def _jump(hooks: DataFrame, name: str) -> DataFrame:
    """Follow parents (node, parent) to their roots, doubling the step each time."""
    while True:
        up = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        hooks = materialize(hooks.join(up, "parent", "left").select(
            "node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")), name)
        if hooks.filter("moved").isEmpty():
            return hooks.select("node", "parent")
        hooks = hooks.select("node", "parent")


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, component) of every node in `links` (a, b); component is the smallest node that links reach.

    Each round every root with a smaller neighbouring root hooks to the smallest one, hooks are followed to their roots by
    doubling, and links are carried over to the roots; links within a tree go. A node hooks once in all, so what is kept never
    exceeds the nodes. Rounds grow with the logarithm of the nodes. A node with very many links costs one partial minimum; no
    list of neighbours is ever built. Self-links add no link, nulls are ignored.
    """
    a, b = F.col("a"), F.col("b")
    edges = materialize(links.filter(a.isNotNull() & b.isNotNull()).select(
        F.greatest(a, b).alias("big"), F.least(a, b).alias("small")).distinct(), f"{name}-edges")
    nodes = edges.select(F.explode(F.array("big", "small")).alias("node")).distinct()
    edges, trees = edges.filter("big <> small"), []
    while not edges.isEmpty():
        hooks = _jump(edges.groupBy("big").agg(F.min("small").alias("parent")).withColumnRenamed("big", "node"), f"{name}-hooks")
        trees.append(hooks)
        for end in ("big", "small"):
            root = hooks.select(F.col("node").alias(end), "parent")
            edges = edges.join(root, end, "left").withColumn(end, F.coalesce("parent", end)).drop("parent")
        edges = materialize(edges.select(F.greatest("big", "small").alias("big"), F.least("big", "small").alias("small"))
                            .filter("big <> small").distinct(), f"{name}-edges")
    if not trees:
        return nodes.withColumn("component", F.col("node"))
    forest = trees[0] if len(trees) == 1 else _jump(reduce(DataFrame.unionByName, trees), f"{name}-forest")
    return nodes.join(forest, "node", "left").select("node", F.coalesce("parent", "node").alias("component"))
