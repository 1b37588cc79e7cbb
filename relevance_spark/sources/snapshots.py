"""Snapshots of a corpus with vectors: staged, checked on reading, never overwritten in place."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from relevance_spark.config import without_secrets
from relevance_spark.operators.dense import check_vectors
from relevance_spark.sources.readers import canonical_json

FORMAT = 1


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def save(corpus: DataFrame, path: str, fingerprint: str, dim: int, extra: dict | None = None, kind: str = "exact") -> None:
    """Write beside the target, then rename; an existing snapshot is refused."""
    spark = corpus.sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    without_secrets(extra or {})
    # The corpus is worked out once, by the write; what is checked and counted is what was written.
    stage = f"{path}.{uuid.uuid4().hex}"
    corpus.write.parquet(f"{stage}/documents")
    written = spark.read.schema(corpus.schema).parquet(f"{stage}/documents")
    try:
        check_vectors(written, dim)
    except ValueError:
        fs.delete(_fs(spark, stage)[1], True)
        raise
    meta = {"format": FORMAT, "kind": kind, "fingerprint": fingerprint, "dim": dim, "count": written.count(), "extra": extra or {}}
    spark.createDataFrame([(canonical_json(meta),)], "value string").coalesce(1).write.text(f"{stage}/meta")
    if not fs.rename(_fs(spark, stage)[1], target):
        raise OSError(f"could not publish {path}")


def load(spark: SparkSession, path: str, fingerprint: str | None = None, strict: bool = False) -> tuple[DataFrame, dict]:
    """The corpus and its description; format, fingerprint, count and vectors must agree. strict asks for a fingerprint."""
    import json

    meta = json.loads(spark.read.text(f"{path}/meta").first().value)
    if meta["format"] != FORMAT:
        raise ValueError(f"unknown format {meta['format']}")
    if strict and fingerprint is None:
        raise ValueError("a strict load names its encoder")
    if fingerprint is not None and fingerprint != meta["fingerprint"]:
        raise ValueError("this snapshot was made by another encoder")
    corpus = spark.read.parquet(f"{path}/documents")
    if corpus.count() != meta["count"]:
        raise ValueError("rows are missing")
    check_vectors(corpus, meta["dim"])
    return corpus, meta
