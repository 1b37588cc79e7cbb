"""Ranked relations: top-k per query, fusion of rankings, rescoring, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores are compared at this many decimals, so that the order of a sum does not decide a tie.
DECIMALS = 9


def by_score(score: str = "score", item: str = "id") -> list[Column]:
    """Best score first; ties in order of the id as text."""
    return [F.round(F.col(score), DECIMALS).desc(), F.col(item).cast("string").asc()]


def top_k(scored: DataFrame, k: int, query: str = "query_id", item: str = "id", order: list[Column] | None = None) -> DataFrame:
    """The k best rows of each query with ``rank`` from 1. Spark keeps k rows per group before the shuffle."""
    if not isinstance(k, int) or isinstance(k, bool) or k < 1:
        raise ValueError("k is a positive whole number")
    w = Window.partitionBy(query).orderBy(*(order or by_score(item=item)))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reciprocal_rank_fusion(branches: list[DataFrame], k: int, constant: float = 60.0) -> DataFrame:
    """Rankings (query_id, id, rank) to fused scores: the sum of 1 / (constant + rank)."""
    every = branches[0].select("query_id", "id", "rank")
    for b in branches[1:]:
        every = every.unionByName(b.select("query_id", "id", "rank"))
    fused = every.groupBy("query_id", "id").agg(F.sum(1.0 / (F.lit(float(constant)) + F.col("rank"))).alias("score"))
    return top_k(fused, k)


def rerank(hits: DataFrame, score: Column, k: int | None = None, depth: int | None = None) -> DataFrame:
    """Order a first ranking anew by another score, ties by first rank; only its first ``depth`` rows, if given."""
    scored = hits.withColumnRenamed("score", "retrieval_score").withColumnRenamed("rank", "first_rank").withColumn("score", score)
    order = [F.round(F.col("score"), DECIMALS).desc(), F.col("first_rank")]
    if depth is not None:
        order = [F.col("first_rank") > depth, F.when(F.col("first_rank") <= depth, F.round(F.col("score"), DECIMALS)).desc_nulls_last(), F.col("first_rank")]
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return out if k is None else out.where(F.col("rank") <= k)


def first_occurrences(run: DataFrame) -> DataFrame:
    """A ranked list without repeats of an id, ranked anew without gaps."""
    first = run.groupBy("query_id", "id").agg(F.min("rank").alias("old"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("old"))).drop("old")


def where_metadata(corpus: DataFrame, wanted: dict | Column | None) -> DataFrame:
    """Rows whose columns equal the wanted values; a missing column value equals None."""
    if wanted is None:
        return corpus
    if isinstance(wanted, Column):
        return corpus.where(wanted)
    for name, value in wanted.items():
        corpus = corpus.where(F.col(name).eqNullSafe(F.lit(value)))
    return corpus
