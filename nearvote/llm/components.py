"""Connected components of a graph given as pairs, with joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Returns node, component: the smallest node that can be reached, for every node of an edge.

    Each round takes the smallest label among a node and its neighbours, then the label of that label,
    so the number of rounds grows with the logarithm of a component's diameter. A node's neighbours are
    reduced by partial aggregation and never stand in one place. Each round ends in a checkpoint.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v")
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().checkpoint()
    labels = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")).checkpoint()
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        closer = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        new = closer.join(far, "label", "left").select("node", "was", F.least("label", F.coalesce("beyond", "label")).alias("label")).checkpoint()
        settled = new.filter("label <> was").limit(1).count() == 0
        labels = new.select("node", "label")
        if settled:
            return labels.withColumnRenamed("label", "component")
