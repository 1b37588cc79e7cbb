"""Blocks of documents, and buckets of hashes that all blocks send one another.

A block is a group of rows of bounded text; its hashes are made distinct before they leave it, so a passage that a
third of all rows share is one entry per block. A bucket gets one binary row from each block and answers to blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevance_spark.llm import arrays

#: Characters of text in a block, about.
BLOCK_CHARS = 6_000_000


def n_blocks(docs: DataFrame, chars: int = BLOCK_CHARS) -> int:
    """Blocks for so much text: one narrow aggregate over all rows."""
    total = docs.agg(F.sum(F.length("text").cast("long") + 20)).first()[0] or 0
    return max(4, -(-total // chars))


def in_blocks(docs: DataFrame, n: int) -> DataFrame:
    """docs with ``block``, dealt out by it; only rows that are equal in doc_id and text surely meet."""
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))).repartition(n, "block")


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Buckets are ranges of the upper 32 bits."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def by_bucket(h: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of sorted hashes, for buckets that have any: as many rows and steps as hashes, at most."""
    return in_runs(bucket_of(h, n))


def in_runs(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of sorted buckets."""
    start, size = arrays.runs(bucket)
    return list(zip(bucket[start].tolist(), start.tolist(), (start + size).tolist(), strict=True))


def rows(names: list[str], types: list[pa.DataType], values: list[tuple]) -> pa.Table:
    return pa.table([pa.array([v[i] for v in values], t) for i, t in enumerate(types)], names)
