"""Connected components of a graph that only Spark holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_engine.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the component, for every node of edges (a, b).

    Each round takes the smallest label among a node's neighbours and then follows the label
    once (pointer jumping), so long chains shrink by halves. Rounds end when no label changes.
    A hub's neighbours meet by partial minima; the joins carry one row for each edge, and
    adaptive execution splits a hub's share of them."""
    both = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
                  .unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "graph-edges")
    labels = stored(both.groupBy("node").agg(F.min("other").alias("_least")).select("node", F.least("node", "_least").alias("label")), "graph-labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("_seen")), "other")
                .groupBy("node").agg(F.min("_seen").alias("_seen")))
        lowered = labels.join(near, "node").select("node", F.col("label").alias("_old"), F.least("label", "_seen").alias("_new"))
        jump = labels.select(F.col("node").alias("_new"), F.col("label").alias("_far"))
        moved = stored(lowered.join(jump, "_new").select("node", F.least("_new", "_far").alias("label"), "_old"), "graph-labels")
        changed = moved.where(F.col("label") != F.col("_old")).limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels
