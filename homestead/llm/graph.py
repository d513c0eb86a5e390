"""Connected components as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homestead.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node of its component) for all nodes of edges (a, b).

    Each round passes the smallest label on to neighbours and then follows labels one step further, so that rounds
    grow with the logarithm of a component's width. Tables written between rounds cut the lineage.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        lower = written(lower, "labels")
        jump = lower.select(F.col("node").alias("via"), F.col("component").alias("next"))
        after = written(lower.join(jump, lower["component"] == jump["via"]).select("node", "old", F.least("component", "next").alias("component")), "labels")
        labels = after.select("node", "component")
        if after.where("component <> old").isEmpty():
            return labels
