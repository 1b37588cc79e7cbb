"""Semantic routing and memory: aggregates of similarities, decay, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relevance_spark.functions import vectors as V
from relevance_spark.operators.ranking import DECIMALS, by_score, top_k


def centroids(routes: DataFrame) -> DataFrame:
    """(route, vec) to (route, vec): the mean of unit vectors, of unit length again."""
    parts = routes.select("route", F.posexplode(V.unit(F.col("vec"))).alias("pos", "x")).groupBy("route", "pos").agg(F.avg("x").alias("x"))
    listed = parts.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return listed.select("route", V.unit(F.transform("v", lambda s: s["x"])).alias("vec"))


def route_scores(queries: DataFrame, routes: DataFrame, how: str = "max") -> DataFrame:
    """(query_id, vec) against (route, vec): (query_id, route, score). Routes are the small, given side."""
    if how not in ("max", "mean", "centroid"):
        raise ValueError(f"unknown aggregation: {how}")
    side = centroids(routes) if how == "centroid" else routes.select("route", V.unit(F.col("vec")).alias("vec"))
    sims = queries.select("query_id", V.unit(F.col("vec")).alias("q")).join(side).select("query_id", "route", V.dot(F.col("q"), F.col("vec")).alias("s"))
    return sims.groupBy("query_id", "route").agg((F.avg("s") if how == "mean" else F.max("s")).alias("score"))


def choose(scores: DataFrame, threshold: float = 0.5, own: DataFrame | None = None) -> DataFrame:
    """The best route of each query, or none if it stays below its threshold; a runner-up never wins."""
    best = scores.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", DECIMALS).desc(), "route"))).where("r = 1")
    limit = F.lit(threshold)
    if own is not None:
        best, limit = best.join(own.select("route", F.col("threshold").alias("_t")), "route", "left"), F.coalesce("_t", F.lit(threshold))
    return best.select("query_id", F.when(F.round("score", DECIMALS) >= limit, F.col("route")).alias("route"), "score")


def shortlist(scores: DataFrame, k: int) -> DataFrame:
    return top_k(scores, k, item="route", order=[F.round("score", DECIMALS).desc(), F.col("route")])


def decayed(hits: DataFrame, now: float, half_life: float, k: int, created: str = "created_at", min_score: float | None = None) -> DataFrame:
    """A pool of hits (rank, score, created_at) to the k best after decay; negative scores decay towards 0."""
    if not half_life > 0:
        raise ValueError("half_life is positive")
    age = F.greatest(F.lit(0.0), F.lit(float(now)) - F.col(created).cast("double"))
    out = hits.withColumnRenamed("rank", "pool_rank").withColumn("score", F.col("score") * F.pow(F.lit(0.5), age / half_life))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", DECIMALS).desc(), "pool_rank"))).where(F.col("rank") <= k)
    return out if min_score is None else out.where(F.col("score") >= min_score)


def expire(memories: DataFrame, now: float, seconds: float, created: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """What stays and what goes: older than seconds, a missing time counts as 0."""
    stale = F.coalesce(F.col(created).cast("double"), F.lit(0.0)) < F.lit(float(now) - seconds)
    return memories.where(~stale), memories.where(stale)


def calibrated_threshold(scores: DataFrame) -> DataFrame:
    """(score, known) to the middle between the lowest known and the highest unknown score; null where they overlap."""
    ends = scores.agg(F.min(F.when(F.col("known"), F.col("score"))).alias("lo"), F.max(F.when(~F.col("known"), F.col("score"))).alias("hi"))
    return ends.select(F.when(F.col("lo") > F.col("hi"), (F.col("lo") + F.col("hi")) / 2).alias("threshold"), "lo", "hi")


def ranked_memories(scores: DataFrame, k: int) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by_score()))).where(F.col("rank") <= k)
