"""Exact vector search: blocks of the corpus against a matrix of queries, top k per block, then overall.

The query side is collected in chunks of a fixed number of vectors; the corpus never leaves the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relevance_spark.functions import vectors as V
from relevance_spark.operators.ranking import DECIMALS, by_score, top_k

#: Query vectors in one matrix: 4096 of 1024 floats make 32 MB.
CHUNK = 4096
#: The approximate index: tables, bits of a bucket, and how many times k is fetched before a filter.
TABLES, BITS, OVERFETCH = 64, 6, 10


def check_vectors(df: DataFrame, dim: int, vec: str = "vec", item: str = "id") -> None:
    """Raise on a wrong length, a number that is not finite, or a repeated id: one aggregate."""
    bad, n, distinct = df.agg(F.count_if(~V.is_valid(F.col(vec), dim)), F.count("*"), F.count_distinct(item)).first()
    if bad or n != distinct:
        raise ValueError(f"{bad} invalid vectors, {n - distinct} repeated or missing ids")


def matrix(column, dtype=np.float64) -> np.ndarray:
    """An Arrow list column as a two-dimensional array."""
    flat = column.flatten() if hasattr(column, "flatten") else column.values
    return np.asarray(flat.to_numpy(zero_copy_only=False), dtype).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), V.FLOOR)


def _kernel(ids: list, q: np.ndarray, k: int, cosine: bool, id_type, query_type):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = matrix(batch.column("vec"))
            s = q @ (_unit(m) if cosine else m).T
            # All that tie with the k-th at the compared decimals stay, so that ids decide later.
            r = np.round(s, DECIMALS)
            bar = np.partition(r, -k, axis=1)[:, -k] if k < r.shape[1] else np.full(len(r), -np.inf)
            a, b = np.nonzero(r >= bar[:, None])
            own = batch.column("id").take(pa.array(b))
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in a], query_type), own, pa.array(s[a, b])], ["query_id", "id", "score"])

    return run


def search(queries: DataFrame, corpus: DataFrame, k: int = 10, metric: str = "cosine", exclude_self: bool = False) -> DataFrame:
    """(query_id, vec) against (id, vec): (query_id, id, score, rank)."""
    if metric not in ("cosine", "dot"):
        raise ValueError(f"unknown metric: {metric}")
    kinds = dict(queries.dtypes)["query_id"], dict(corpus.dtypes)["id"]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    found, n = None, queries.count()
    chunks = [queries] if n <= CHUNK else [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-n // CHUNK))) == c) for c in range(-(-n // CHUNK))]
    for chunk in chunks:
        rows = chunk.select("query_id", "vec").collect()
        q = np.array([r.vec for r in rows], np.float64).reshape(len(rows), -1)
        q = _unit(q) if metric == "cosine" else q
        kernel = _kernel([r.query_id for r in rows], q, k + int(exclude_self), metric == "cosine", arrow[kinds[1]], arrow[kinds[0]])
        part = corpus.select("id", "vec").mapInArrow(kernel, f"query_id {kinds[0]}, id {kinds[1]}, score double") if rows else None
        found = part if found is None else found.unionByName(part) if part is not None else found
    if found is None:
        return queries.sparkSession.createDataFrame([], f"query_id {kinds[0]}, id {kinds[1]}, score double, rank int")
    return top_k(found.where(F.col("query_id") != F.col("id")) if exclude_self else found, k)


def scored_pairs(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """All cosines of a small query side with a corpus, as expressions (for joins on labels and the like)."""
    return queries.select("query_id", F.col("vec").alias("qv")).join(corpus.select("id", "vec")).select("query_id", "id", V.dot(V.unit(F.col("qv")), V.unit(F.col("vec"))).alias("score"))


def signatures(planes: np.ndarray):
    """A column function: one bucket per table, from the sides of fixed hyperplanes."""
    tables, bits, dim = planes.shape

    @F.pandas_udf("array<int>")
    def run(vecs: pd.Series) -> pd.Series:
        sides = np.stack(vecs.to_list()).astype(float) @ planes.reshape(-1, dim).T > 0
        codes = (sides.reshape(len(vecs), tables, bits) << np.arange(bits)).sum(2) + (np.arange(tables) << bits)
        return pd.Series(list(codes.astype(np.int32)))

    return run


@dataclass
class ApproximateIndex:
    """Rows (id, vec, buckets, ...) of a locality-sensitive hash: a row is in one bucket of each table."""

    rows: DataFrame
    dim: int
    tables: int = TABLES
    bits: int = BITS
    seed: int = 42

    @classmethod
    def build(cls, corpus: DataFrame, dim: int, tables: int = TABLES, bits: int = BITS, seed: int = 42) -> ApproximateIndex:
        empty = cls(corpus, dim, tables, bits, seed)
        return cls(corpus.withColumn("buckets", empty.buckets("vec")), dim, tables, bits, seed)

    def buckets(self, vec: str):
        return signatures(np.random.default_rng(self.seed).standard_normal((self.tables, self.bits, self.dim)))(vec)

    def save(self, path: str, fingerprint: str) -> None:
        """Rows and settings; the planes follow from the seed."""
        from relevance_spark.sources import snapshots

        snapshots.save(self.rows, path, fingerprint, self.dim, {"tables": self.tables, "bits": self.bits, "seed": self.seed}, "lsh")

    @classmethod
    def load(cls, spark, path: str, fingerprint: str | None = None) -> ApproximateIndex:
        from relevance_spark.sources import snapshots

        rows, meta = snapshots.load(spark, path, fingerprint)
        if meta["kind"] != "lsh":
            raise ValueError("this snapshot holds no approximate index")
        index = cls(rows, meta["dim"], **meta["extra"])
        # A row's buckets follow from its vector; a few rows tell whether the planes are those of the writer.
        if not rows.limit(100).where(F.col("buckets") != index.buckets("vec")).isEmpty():
            raise ValueError("buckets and vectors do not belong together")
        return index

    def candidates(self, queries: DataFrame) -> DataFrame:
        """(query_id, id) that share a bucket."""
        keyed = queries.select("query_id", F.explode(self.buckets("vec")).alias("bucket"))
        return keyed.join(self.rows.select("id", F.explode("buckets").alias("bucket")), "bucket").select("query_id", "id").distinct()

    def search(self, queries: DataFrame, k: int, overfetch: int = OVERFETCH, predicate=None) -> DataFrame:
        """Over-fetches k * overfetch and filters afterwards, so that fewer than k rows may be left, as with any such index."""
        near = self.candidates(queries).join(self.rows.select("id", "vec"), "id").join(queries.select("query_id", F.col("vec").alias("qv")), "query_id")
        scored = near.select("query_id", "id", V.dot(V.unit(F.col("qv")), V.unit(F.col("vec"))).alias("score"))
        hits = top_k(scored, k * overfetch if predicate is not None else k)
        if predicate is None:
            return hits
        kept = hits.drop("rank").join(self.rows.where(predicate).select("id"), "id", "left_semi")
        return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by_score()))).where(F.col("rank") <= k)


def approximate_search(queries: DataFrame, corpus: DataFrame, k: int, dim: int, tables: int = TABLES, bits: int = BITS, seed: int = 42, overfetch: int = OVERFETCH, predicate=None) -> DataFrame:
    return ApproximateIndex.build(corpus, dim, tables, bits, seed).search(queries, k, overfetch, predicate)
