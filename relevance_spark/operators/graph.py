"""Connected components by rounds of smallest labels, each written to the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir, deleted when the driver ends; a local session without one gets its own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or _own.get("root")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _own["root"] = f"file://{tempfile.mkdtemp()}"
    uri = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return uri


def connected(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """Edges (a, b) of longs to (node, component): the smallest node that can be reached, to the fixpoint.

    In a round every node takes the smallest label of its neighbours and then the label of that label, so long chains
    halve. Nodes without edges are absent.
    """
    spark = edges.sparkSession
    folder = shared_folder(spark, "components")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    pairs = edges.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    pairs = kept(pairs.distinct(), "pairs")
    labels = kept(pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component"), F.lit(True).alias("changed")), "round0")
    for k in range(1, most_rounds + 1):
        of_neighbours = pairs.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        lowered = labels.join(of_neighbours, "node").select("node", F.col("component").alias("old"), F.least("component", "low").alias("via"))
        jumped = lowered.join(labels.select(F.col("node").alias("via"), F.col("component").alias("jump")), "via", "left")
        new = F.least("via", F.coalesce("jump", "via"))
        labels = kept(jumped.select("node", new.alias("component"), (new != F.col("old")).alias("changed")), f"round{k}")
        if labels.where("changed").isEmpty():
            return labels.select("node", "component")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
