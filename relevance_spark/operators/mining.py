"""Hard negatives: the nearest corpus texts of a query that are not its answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relevance_spark.operators import dense
from relevance_spark.operators.ranking import DECIMALS


def distinct_first(corpus: DataFrame, key: str = "text", order: str = "ord") -> DataFrame:
    """One row per key, that of the first place; conflicts of other columns are settled by it."""
    others = [c for c in corpus.columns if c not in (key, order)]
    return corpus.groupBy(key).agg(F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in others])


def hard_negatives(
    examples: DataFrame, corpus: DataFrame, num: int = 4, skip_top: int = 0, max_relative_score: float | None = 0.95, labelled: bool = False
) -> DataFrame:
    """examples (query_id, vec, positive, positive_score[, label]) against corpus (id, ord, vec[, label]).

    The skip_top + 3 * num + 1 nearest are fetched first and exclusions come after, so fewer than num may be left.
    Returns (query_id, id, score, position).
    """
    if num == 0:
        return examples.select("query_id", F.lit(None).cast("long").alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("position")).limit(0)
    fetch = skip_top + 3 * num + 1
    hits = dense.search(examples.select("query_id", "vec"), corpus.select("id", "vec"), fetch).select("query_id", "id", "score")
    side = ["query_id", "positive", "positive_score"] + (["label"] if labelled else [])
    ranked = hits.join(corpus.select("id", "ord", *([F.col("label").alias("own_label")] if labelled else [])), "id").join(examples.select(*side), "query_id")
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", DECIMALS).desc(), "ord")))
    kept = ranked.where(f"r > {skip_top} AND r <= {fetch} AND id <> positive")
    if max_relative_score is not None:
        kept = kept.where(F.round("score", DECIMALS) <= F.round(F.lit(max_relative_score) * F.col("positive_score"), DECIMALS))
    if labelled:
        kept = kept.where("own_label <> label")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("r"))).where(f"position <= {num}").select("query_id", "id", "score", "position")


def label_conflicts(corpus: DataFrame) -> DataFrame:
    """Texts that carry more than one label."""
    return corpus.groupBy("text").agg(F.count_distinct("label").alias("n")).where("n > 1")
