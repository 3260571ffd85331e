"""Connected components of an undirected graph as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import written


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node that an edge names; component is the smallest node reachable.

    Each round takes the smallest label of a node's neighbours and then the label of that label (pointer jumping), so
    the number of rounds grows with the logarithm of a component's diameter in practice. Minima are combined before the
    shuffle, so a hub costs one row a task. Nulls in either end drop the edge; self loops only name their node; an empty
    edge table gives an empty result. Every round is written to the shared folder, which also cuts the lineage.
    """
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null")
    both = written(e.union(e.select("v", "u")).distinct(), "cc-edges")
    labels = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("component").alias("c")), "v").groupBy("u").agg(F.min("c").alias("c"))
        step = labels.join(near, labels.node == near.u, "left").select("node", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = written(step.join(up, "component", "left").select("node", "old", F.least("component", F.coalesce("root", "component")).alias("component")), "cc-labels")
        if not new.where("old <> component").limit(1).count():
            return new.select("node", "component")
        labels = new.select("node", "component")
