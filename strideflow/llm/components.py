"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (smallest node reachable) for edges (a, b) of longs; nodes without edges are absent.

    Each round takes the smallest label of the neighbours and then the label of that label, so a chain
    of n nodes needs about log n rounds.  Both steps are joins and partial minima: a node with very many
    neighbours is only a skewed join key.
    """
    links = edges.filter("a <> b").select("a", "b")
    links = store(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-links")
    labels = store(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_b")).select("node", F.least("node", "_b").alias("label")), "cc-labels")
    while True:
        near = links.join(labels, links.b == labels.node).groupBy("a").agg(F.min("label").alias("_near"))
        met = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "_near").alias("_new"))
        roots = labels.select(F.col("node").alias("_root"), F.col("label").alias("_far"))
        new = met.join(roots, F.col("_new") == F.col("_root")).select("node", F.col("label").alias("_old"), F.least("_new", "_far").alias("label"))
        new = store(new, "cc-labels")
        if new.filter("label <> _old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
