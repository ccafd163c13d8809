"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.shared import cut_lineage


def _follow(parents: DataFrame) -> DataFrame:
    """node, up with every ``up`` replaced by the root it leads to, by pointer doubling."""
    while True:
        parents = cut_lineage(parents)
        upper = parents.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = parents.join(upper, "up", "left").select("node", "up", F.coalesce("top", "up").alias("top"))
        jumped = cut_lineage(jumped)
        if jumped.filter("top <> up").isEmpty():
            return jumped.select("node", "up")
        parents = jumped.select("node", F.col("top").alias("up"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``edges`` (a, b).

    Every round points each node at its smallest neighbour, follows these pointers to their
    roots and contracts the graph, so at least half of the nodes with edges disappear.
    """
    kind = edges.schema["a"].dataType.simpleString()
    labels = None
    edges = cut_lineage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("near"))
        )
        roots = _follow(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("up")))
        if labels is None:
            labels = roots.withColumnRenamed("up", "component")
        else:
            moved = roots.select(F.col("node").alias("component"), F.col("up").alias("_to"))
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
        labels = cut_lineage(labels)
        left = roots.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        right = roots.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        moved = edges.join(left, "a").join(right, "b").filter("ra <> rb")
        edges = cut_lineage(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if labels is None:
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    return labels
