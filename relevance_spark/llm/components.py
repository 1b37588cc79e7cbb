"""Connected components of an edge table, without bringing edges or labels to the driver.

Every node takes the smallest label among its own and its neighbours', then the label of its label, until nothing
changes: the number of rounds grows with the logarithm of the longest chain in practice. Each round is written to the
shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevance_spark.llm.shared import Workspace


def components(edges: DataFrame, ws: Workspace, name: str, most_rounds: int = 60) -> DataFrame:
    """Edges (a, b) of longs to (node, component): the smallest node that can be reached. Nodes without edges are absent."""
    both = ws.save(edges.select("a", "b").where("a <> b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), f"{name}_edges")
    labels = ws.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), f"{name}_0")
    for k in range(1, most_rounds + 1):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        roots = labels.select(F.col("node").alias("c"), F.col("component").alias("cc"))
        jumped = lower.join(roots, "c", "left").select("node", "old", F.least("c", F.coalesce("cc", "c")).alias("component"))
        stepped = ws.save(jumped, f"{name}_{k}")
        ws.drop(f"{name}_{k - 1}")
        labels = stepped.select("node", "component")
        if stepped.where("old <> component").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    ws.drop(f"{name}_edges")
    return labels
