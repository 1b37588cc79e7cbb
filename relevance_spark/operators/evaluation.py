"""Ranking metrics, rejection metrics, correlations and resampling over long tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relevance_spark.operators.ranking import first_occurrences

METRICS = ("recall", "precision", "hit", "mrr", "ndcg", "map")


def _at_each(run: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """query_id and a struct per k, ``m<k>``, of all metrics; every query with a positive grade, an absent run scores 0.

    Ranks, judgements and running hits are worked out once; each k is a set of conditional sums over them.
    """
    good = qrels.where("rel > 0")
    gain = lambda rank: F.col("rel") / F.log2(F.col(rank) + 1.0)
    ideal = good.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rel").desc())))
    ideal = ideal.groupBy("query_id").agg(F.count("*").alias("n"), *[F.sum(F.when(F.col("i") <= k, gain("i"))).alias(f"idcg{k}") for k in ks])
    cut = first_occurrences(run).where(F.col("rank") <= max(ks)).join(good, ["query_id", "id"], "left").withColumn("hit", F.when(F.col("rel").isNotNull(), 1).otherwise(0))
    cut = cut.withColumn("cum", F.sum("hit").over(Window.partitionBy("query_id").orderBy("rank")))
    sums = [F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first")]
    for k in ks:
        top = F.col("rank") <= k
        sums += [F.sum(F.when(top, F.col("hit"))).alias(f"hits{k}"), F.sum(F.when(top, F.coalesce(gain("rank"), F.lit(0.0)))).alias(f"dcg{k}"), F.sum(F.when(top, F.col("hit") * F.col("cum") / F.col("rank"))).alias(f"ap{k}")]
    both = ideal.join(cut.groupBy("query_id").agg(*sums), "query_id", "left")
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)

    def at(k: int):
        hits = F.col(f"hits{k}")
        return F.struct(
            zero(hits / F.col("n"), "recall"),
            zero(hits / F.lit(float(k)), "precision"),
            zero(F.when(hits > 0, 1.0), "hit"),
            zero(F.when(F.col("first") <= k, 1.0 / F.col("first")), "mrr"),
            zero(F.col(f"dcg{k}") / F.col(f"idcg{k}"), "ndcg"),
            zero(F.col(f"ap{k}") / F.col("n"), "map"),
        ).alias(f"m{k}")

    return both.select("query_id", *[at(k) for k in ks])


def per_query(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, id, rank) and (query_id, id, rel) to one row per query with a positive grade."""
    return _at_each(run, qrels, [k]).select("query_id", f"m{k}.*")


def evaluate(run: DataFrame, qrels: DataFrame, ks: list[int], metrics=METRICS) -> DataFrame:
    """(metric, k, value): macro averages; 0 without any query that has a positive grade."""
    ks = sorted(set(ks))
    if not ks or ks[0] < 1:
        raise ValueError("cut-offs are positive whole numbers")
    means = _at_each(run, qrels, ks).agg(*[F.coalesce(F.avg(f"m{k}.{m}"), F.lit(0.0)).alias(f"{m}_{k}") for k in ks for m in metrics])
    rows = [F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"), F.col(f"{m}_{k}").alias("value")) for k in ks for m in metrics]
    return means.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row; 0 where either side does not vary."""
    centred = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    m = centred.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    d = centred.join(F.broadcast(m)).select((F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    s = d.agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    return s.select(F.coalesce(F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))), F.lit(0.0)).alias("value"))


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Ranks where ties share their mean: counts per distinct value, then a running sum over these."""
    counts = df.groupBy(column).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.select(F.col(column).alias("_v"), (before + (F.col("_c") + 1) / 2.0).alias(name))
    return df.join(ranks, F.col(column) == F.col("_v")).drop("_v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    return pearson(average_ranks(average_ranks(df, x, "_rx"), y, "_ry"), "_rx", "_ry")


def rejection(df: DataFrame, threshold: float) -> DataFrame:
    """(score, correct, in_scope) to coverage, false acceptance and accuracy of what is accepted (null if nothing)."""
    taken = F.coalesce(F.col("score") >= threshold, F.lit(False))
    rate = lambda a, b: F.try_divide(F.count_if(a).cast("double"), F.count_if(b))
    return df.agg(
        rate(taken & F.col("in_scope"), F.col("in_scope")).alias("coverage"),
        rate(taken & ~F.col("in_scope"), ~F.col("in_scope")).alias("false_acceptance"),
        rate(taken & F.col("in_scope") & F.col("correct"), taken & F.col("in_scope")).alias("accepted_accuracy"),
    )


def sweep(df: DataFrame, most_false: float) -> DataFrame:
    """The threshold with the largest coverage whose false acceptance stays within the limit.

    Candidates are the distinct scores and the next larger number of each; counts run over distinct scores. One row.
    """
    per = df.groupBy("score").agg(F.count_if("in_scope").alias("k"), F.count_if(~F.col("in_scope")).alias("u"))
    totals = per.agg(F.sum("k").alias("known"), F.sum("u").alias("unknown"))
    above = Window.orderBy(F.col("score").desc())
    at = per.where("score IS NOT NULL").select("score", F.sum("k").over(above).alias("k"), F.sum("u").over(above).alias("u"), "k", "u").toDF("score", "kc", "uc", "k", "u")
    same = at.select(F.col("score").alias("threshold"), F.col("kc").alias("k"), F.col("uc").alias("u"), F.lit(False).alias("above"))
    more = at.select(F.col("score").alias("threshold"), (F.col("kc") - F.col("k")).alias("k"), (F.col("uc") - F.col("u")).alias("u"), F.lit(True).alias("above"))
    curve = same.unionByName(more).join(F.broadcast(totals)).select("threshold", "above", (F.col("k") / F.col("known")).alias("coverage"), (F.col("u") / F.col("unknown")).alias("false_acceptance"))
    return curve.where(F.col("false_acceptance") <= most_false).orderBy(F.col("coverage").desc(), "false_acceptance", "threshold", "above").limit(1)


def next_up(x: float) -> float:
    up = math.nextafter(x, math.inf)
    if math.isinf(up):
        raise ValueError("no finite threshold rejects all")
    return up


def bootstrap(groups: DataFrame, samples: int = 2000, seed: int = 42, block: int = 64) -> dict:
    """Mean difference per group (one row each: n, total) resampled by groups; groups are as few as the study has.

    Samples are drawn a block at a time, so memory holds block times groups numbers.
    """
    rows = groups.orderBy("group").select("n", "total").collect()
    n, total = np.array([r.n for r in rows], float), np.array([r.total for r in rows], float)
    rng, means = np.random.default_rng(seed), []
    for at in range(0, samples, block):
        draws = rng.integers(0, len(rows), (min(block, samples - at), len(rows)))
        means.append(total[draws].sum(1) / n[draws].sum(1))
    low, high = np.quantile(np.concatenate(means), (0.025, 0.975))
    return {"mean": float(total.sum() / n.sum()), "low": float(low), "high": float(high)}
