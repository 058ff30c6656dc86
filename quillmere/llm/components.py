"""Connected components of an edge table, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; a component is named by its smallest node.

    Each round takes the smallest label among a node and its neighbours and then
    follows labels once (pointer jumping), so long chains settle in about
    log(length) rounds.  Every round is written to the shared folder.  A hub's
    rows are pre-aggregated before the shuffle; joins leave splitting to AQE.
    No edges give no rows; self-loops and repeated edges change nothing.
    """
    both = written(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct(),
        "edges",
    )
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b")
            .groupBy("a").agg(F.min("c").alias("c"))
        )
        least = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        least = written(least, "least")
        jump = least.select(F.col("node").alias("via"), F.col("component").alias("far"))
        after = written(
            least.join(jump, F.col("component") == F.col("via"), "left").select("node", "old", F.least("component", "far").alias("component")),
            "labels",
        )
        labels = after.select("node", "component")
        if after.where("component <> old").isEmpty():
            return labels
