"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b): the smallest node reachable.

    Each round takes the smallest label among neighbours and then the label of that label, so the rounds grow with the
    logarithm of a path's length. Only the count of changed labels reaches the driver. Rounds are written out, which
    cuts the lineage. A node with very many edges is one key of a join that Spark splits, and of sums taken before
    the shuffle.
    """
    edges = edges.select("a", "b").filter("a <> b")
    both = stage(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        low = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("far"))
        moved = stage(low.join(jump, "low").select("node", "old", F.least("low", "far").alias("component")), "labels")
        if moved.filter("component <> old").limit(1).count() == 0:
            return moved.select("node", "component")
        labels = moved.select("node", "component")
