"""Rerankers: a second score for the texts of a first ranking, and the request shape that ranks given documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relevance_spark.functions import vectors as V
from relevance_spark.operators.encoders import Encoder, load_encoder
from relevance_spark.operators.ranking import rerank
from relevance_spark.registry import Registry


def yes_probability(yes, no):
    """Softmax over the logits of two answers: numbers, arrays or columns."""
    exp = F.exp if isinstance(yes, Column) else np.exp
    return 1.0 / (1.0 + exp(no - yes))


def class_probability(logits: np.ndarray) -> np.ndarray:
    """Of a row of logits: the logistic function of a single one, else the softmax share of the last."""
    z = np.asarray(logits, float).reshape(len(logits), -1)
    if z.shape[1] == 1:
        return 1.0 / (1.0 + np.exp(-z[:, 0]))
    e = np.exp(z - z.max(1, keepdims=True))
    return e[:, -1] / e.sum(1)


class Reranker:
    """``column(query, text)`` is the score; everything else follows from it."""

    name = "reranker"

    def column(self, query: Column, text: Column) -> Column:
        raise NotImplementedError

    def rerank(self, hits: DataFrame, queries: DataFrame, k: int | None = None, depth: int | None = None) -> DataFrame:
        """hits (query_id, id, text, score, rank) and queries (query_id, text) to the same rows in the order of the score."""
        if not {"text", "rank", "score"} <= set(hits.columns):
            raise ValueError("hits need their text, score and rank")
        asked = hits.join(queries.select("query_id", F.col("text").alias("_query")), "query_id")
        return rerank(asked, self.column(F.col("_query"), F.col("text")), k, depth).drop("_query")

    def ranked_documents(self, spark, query: str, documents: list[str], top_n: int | None = None) -> list[dict]:
        """The shape of a rerank request's answer: index, relevance_score and document, best first, ties by index."""
        if not documents:
            raise ValueError("documents must not be empty")
        rows = spark.createDataFrame([(i, query, d) for i, d in enumerate(documents)], "index int, query string, document string")
        ranked = rows.withColumn("relevance_score", self.column(F.col("query"), F.col("document"))).orderBy(F.col("relevance_score").desc(), "index").limit(top_n or len(documents))
        return [{"index": r["index"], "relevance_score": r.relevance_score, "document": r.document} for r in ranked.collect()]


@dataclass
class EncoderReranker(Reranker):
    """Cosine under a second encoder."""

    encoder: Encoder
    name: str = "encoder"

    def column(self, query: Column, text: Column) -> Column:
        a, b = self.encoder.vectors(query, "query"), self.encoder.vectors(text)
        return V.dot(a, b) / (F.greatest(V.norm(a), F.lit(V.FLOOR)) * F.greatest(V.norm(b), F.lit(V.FLOOR)))


def _in_batches(score: Callable, load: Callable | None) -> Callable:
    """A pandas function over (query, text); a model that ``load`` makes is made once a worker."""

    def run(batches):
        model = load() if load else None
        for query, text in batches:
            values = score(list(query), list(text)) if load is None else score(model, list(query), list(text))
            values = np.asarray(values, float)
            if values.shape != (len(query),) or not np.isfinite(values).all():
                raise ValueError("a reranker returned a wrong number of scores, or some that are not finite")
            yield pd.Series(values)

    return run


@dataclass
class CallableReranker(Reranker):
    """score(queries, texts), or score(model, queries, texts) with ``load``, runs on batches in workers."""

    score: Callable
    load: Callable | None = None
    name: str = "callable"

    def column(self, query: Column, text: Column) -> Column:
        run = _in_batches(self.score, self.load)

        @F.pandas_udf("double")
        def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            yield from run(batches)

        return scored(query, text)


def cross_encoder(logits: Callable, load: Callable | None = None, name: str = "cross-encoder") -> CallableReranker:
    """logits([model,] queries, texts) gives a row per pair: one logit, or one per class with the relevant one last."""
    return CallableReranker(lambda *a: class_probability(logits(*a)), load, name)


def yes_no(logits: Callable, load: Callable | None = None, name: str = "yes-no") -> CallableReranker:
    """logits([model,] queries, texts) gives a pair (no, yes) of logits per pair of texts."""

    def score(*a):
        z = np.asarray(logits(*a), float)
        return yes_probability(z[:, 1], z[:, 0])

    return CallableReranker(score, load, name)


RERANKERS = Registry("reranker", encoder=lambda spec="hashing", **o: EncoderReranker(load_encoder(spec if not o else {"type": spec, **o})), callable=CallableReranker, cross_encoder=cross_encoder, yes_no=yes_no)


def load_reranker(spec: str | Reranker, **options) -> Reranker:
    """A reranker; ``encoder:<encoder>``; or a registered name with its options."""
    if isinstance(spec, Reranker):
        return spec
    kind, _, rest = spec.partition(":")
    return RERANKERS.build(kind, rest, **options) if rest else RERANKERS.build(kind, **options)
