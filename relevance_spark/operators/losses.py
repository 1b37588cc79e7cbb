"""Contrastive objectives evaluated as queries over batches of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relevance_spark.functions import vectors as V


def log_sum_exp(z: Column) -> Column:
    """Aggregate over an array of logits."""
    top = F.array_max(z)
    return top + F.log(F.aggregate(F.transform(z, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x))


def infonce(pairs: DataFrame, temperature: float = 0.05, margin: float | None = None, symmetric: bool = False, negatives: DataFrame | None = None, in_batch: bool = True) -> DataFrame:
    """(batch, item, q, p) of unit vectors to one row: the mean loss. Batches bound the self-join.

    margin drops other candidates that lie more than it above the own positive. negatives (batch, item, v) are
    candidates of their whole batch; without in_batch a query has only its own positive and its own negatives, and
    symmetric adds nothing.
    """
    if not temperature > 0:
        raise ValueError("temperature is positive")
    own = pairs.select("batch", "item", "q", V.dot(F.col("q"), F.col("p")).alias("own"))
    cands = pairs.select("batch", F.col("item").alias("other"), F.col("item").alias("of"), F.col("p").alias("v"))
    if negatives is not None:
        cands = cands.unionByName(negatives.select("batch", F.lit(None).cast(dict(pairs.dtypes)["item"]).alias("other"), F.col("item").alias("of"), "v"))
    met = own.join(cands, "batch") if in_batch else own.join(cands.withColumnRenamed("of", "item"), ["batch", "item"])
    sims = met.select("batch", "item", "own", "other", V.dot(F.col("q"), F.col("v")).alias("s"))
    if margin is not None:
        sims = sims.where(F.col("other").eqNullSafe(F.col("item")) | (F.col("s") <= F.col("own") + margin))
    one = sims.groupBy("batch", "item", "own").agg(F.collect_list(F.col("s") / temperature).alias("z")).select((log_sum_exp(F.array_sort("z")) - F.col("own") / temperature).alias("l"))
    loss = one.agg(F.avg("l").alias("loss"))
    if not symmetric or not in_batch:
        return loss
    back = infonce(pairs.select("batch", "item", F.col("p").alias("q"), F.col("q").alias("p")), temperature)
    return loss.withColumnRenamed("loss", "a").join(back).select(((F.col("a") + F.col("loss")) / 2).alias("loss"))


def cosent(scored: DataFrame, scale: float = 20.0) -> DataFrame:
    """(batch, score, cosine): log(1 + sum over s_i > s_j of exp(scale * (c_j - c_i))) per batch, averaged."""
    a, b = scored.select("batch", F.col("score").alias("si"), F.col("cosine").alias("ci")), scored.select("batch", F.col("score").alias("sj"), F.col("cosine").alias("cj"))
    terms = a.join(b, "batch").where("si > sj").groupBy("batch").agg(F.collect_list(scale * (F.col("cj") - F.col("ci"))).alias("z"))
    per = terms.select(log_sum_exp(F.concat(F.array_sort("z"), F.array(F.lit(0.0)))).alias("l"))
    return per.agg(F.coalesce(F.avg("l"), F.lit(0.0)).alias("loss"))


def triplet(rows: DataFrame, margin: float = 0.2) -> DataFrame:
    """(q, p, n) of unit vectors."""
    return rows.agg(F.avg(F.greatest(F.lit(0.0), V.dot(F.col("q"), F.col("n")) - V.dot(F.col("q"), F.col("p")) + margin)).alias("loss"))


def matryoshka(pairs: DataFrame, dims: list[int], weights: list[float] | None = None, **options) -> DataFrame:
    """Weighted mean of the InfoNCE losses of truncated vectors."""
    weights, out = weights or [1.0] * len(dims), None
    for d, w in zip(dims, weights, strict=True):
        cut = pairs.select("batch", "item", V.truncated(F.col("q"), d).alias("q"), V.truncated(F.col("p"), d).alias("p"))
        one = infonce(cut, **options).select((F.col("loss") * w).alias("loss"))
        out = one if out is None else out.unionByName(one)
    return out.agg((F.sum("loss") / sum(weights)).alias("loss"))


def learning_rate(step: Column, base: float, warmup: int, total: int) -> Column:
    """Linear warm-up, then linear decay to zero."""
    up = base * step / F.lit(float(max(1, warmup)))
    down = base * F.greatest(F.lit(0.0), (total - step) / F.lit(float(max(1, total - warmup))))
    return F.when(step < warmup, up).otherwise(down)


LOSSES = {"infonce": infonce, "cosent": cosent, "triplet": triplet, "matryoshka": matryoshka}


def build_loss(name: str):
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name!r}; one of {sorted(LOSSES)}")
    return LOSSES[name]
