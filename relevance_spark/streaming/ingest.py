"""Streaming ingest and windows; an extension beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def ingest(stream: DataFrame, encode, target: str, checkpoint: str, id_col: str = "id", time_col: str | None = None, delay: str = "1 hour"):
    """Encode new documents and append them once per id; runs until all present input is taken."""
    if time_col:
        stream = stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])

    def put(batch: DataFrame, number: int) -> None:
        encode(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")  # a batch that runs again replaces itself

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latency_windows(events: DataFrame, width: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """(ts, value, ok) to counts and mean per window, in batch and in streams alike."""
    df = events.withWatermark("ts", watermark) if events.isStreaming else events
    return df.groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failed"), F.avg("value").alias("mean"))
