"""Connected components as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwell.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the edges ``a, b``: the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours, then the
    label of that label, so a round at least doubles the distance labels travel
    along a settled path. Labels of a round are stored in the shared folder. NULL
    ends are dropped; loops and repeated edges do no harm.
    """
    pairs = edges.select("a", "b").dropna().filter("a <> b")
    both = materialise(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node"))
        near = near.agg(F.min("component").alias("near"))
        moved = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("further"))
        after = moved.join(jump, "to").select("node", F.least("to", "further").alias("component"), (F.least("to", "further") < F.col("component")).alias("changed"))
        stored = materialise(after)
        labels = stored.select("node", "component")
        if stored.filter("changed").isEmpty():
            return labels
