"""Retrievers: filter, score, rank, then fetch documents; dense, lexical, hybrid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relevance_spark.operators import bm25, dense
from relevance_spark.operators.encoders import Encoder
from relevance_spark.operators.ranking import reciprocal_rank_fusion, rerank, where_metadata


def with_documents(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Documents join after the cut: only ids and scores go through the ranking. Ids that are gone drop out."""
    return hits.join(corpus.drop("vec"), "id")


@dataclass
class Retriever:
    """corpus: id, text, vec and any metadata columns."""

    corpus: DataFrame
    encoder: Encoder | None = None
    metric: str = "cosine"

    def search(self, queries: DataFrame, k: int = 5, where: dict | Column | None = None, rescore: Column | None = None, candidates: int | None = None, min_score: float | None = None, instruction: Column | None = None) -> DataFrame:
        """queries: query_id and vec, or text for the encoder. Filters come before the ranking, min_score after it."""
        eligible = where_metadata(self.corpus, where)
        if "vec" not in queries.columns:
            if self.encoder is None:
                raise ValueError("queries have no vectors and there is no encoder")
            queries = queries.withColumn("vec", self.encoder.vectors(F.col("text"), "query", instruction))
        pool = max(k, candidates or 4 * k) if rescore is not None else k
        hits = dense.search(queries, eligible, pool, self.metric)
        found = with_documents(hits, eligible)
        if rescore is not None:
            found = rerank(found, rescore, k)
        return found if min_score is None else found.where(F.col("score") >= min_score)


@dataclass
class HybridRetriever:
    """BM25 and vectors over one corpus, fused by reciprocal ranks."""

    corpus: DataFrame
    depth: int = 100
    constant: float = 60.0
    k1: float = 1.5
    b: float = 0.75

    def search(self, queries: DataFrame, k: int = 5, where: dict | Column | None = None) -> DataFrame:
        eligible, depth = where_metadata(self.corpus, where), max(k, self.depth)
        lexical = bm25.search_many(bm25.build(self.corpus), queries, depth, k1=self.k1, b=self.b, allowed=eligible if where is not None else None)
        near = dense.search(queries.select("query_id", "vec"), eligible, depth)
        return with_documents(reciprocal_rank_fusion([lexical, near], k, self.constant), eligible)


def context(hits: DataFrame) -> DataFrame:
    """One prompt context per query: ``[id] text`` blocks in order of rank."""
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), "text").alias("t")))).alias("l"))
    return listed.select("query_id", F.array_join(F.transform("l", lambda x: x["t"]), "\n\n").alias("context"))
