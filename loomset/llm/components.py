"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.sources.storage import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of the undirected edges (a, b).

    A component is named by its smallest node. Each round takes the smallest name among
    the neighbours and then follows names to their own names, so the rounds grow with
    the logarithm of a chain's length. Each is written to the shared folder, which
    ends the lineage. Sums are combined before the shuffle, so a hub is no hot key.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.filter("a <> b").distinct(), "edges")
    names = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(
        F.col("a").alias("node"), F.least("a", "b").alias("component")), "components")
    while True:
        near = both.join(names.select(F.col("node").alias("b"), "component"), "b")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        least = names.join(near, "node").select("node", "component", F.least("component", "near").alias("new"))
        least = stored(least, "components")
        jump = least.select(F.col("node").alias("new"), F.least("new", "component").alias("far"))
        after = least.join(jump, "new", "left").select("node", "component", F.least("new", "far").alias("new"))
        after = stored(after, "components")
        names = after.select("node", F.col("new").alias("component"))
        if not after.filter("new <> component").limit(1).count():
            return names
