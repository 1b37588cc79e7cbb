"""Queries that evaluate objectives: each vector with the next one of its label, in batches of 16 by id."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from relevance_spark.functions import vectors as V
from relevance_spark.operators import losses
from relevance_spark.plans.dense import cosine, vectors

QUERIES: dict = {}


def register(sql: str | None = None):
    def put(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return put


def pairs(spark, d):
    v = vectors(spark, d)
    nxt = v.withColumn("p", F.lead("vec").over(Window.partitionBy("label").orderBy("id"))).where("p IS NOT NULL")
    return nxt.select(F.floor(F.col("id") / 16).cast("long").alias("batch"), F.col("id").alias("item"), V.unit(F.col("vec")).alias("q"), V.unit(F.col("p")).alias("p"), "label")


P_SQL = "v AS (SELECT vec_id AS item, vec_id // 16 AS batch, label, embedding::DOUBLE[] AS q, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings), x AS (SELECT * FROM v WHERE p IS NOT NULL)"


def nce(cut: str = "", where: str = "true", swap: bool = False) -> str:
    a, b = (f"a.p{cut}", f"b.q{cut}") if swap else (f"a.q{cut}", f"b.p{cut}")
    own = cosine(f"a.q{cut}", f"a.p{cut}")
    return f"(SELECT avg(l) FROM (SELECT ln(sum(exp(s / 0.05))) - any_value(own) / 0.05 AS l FROM (SELECT a.item, b.item AS other, {cosine(a, b)} AS s, {own} AS own FROM x a JOIN x b USING (batch)) WHERE {where} GROUP BY item))"


@register(f"WITH {P_SQL} SELECT round({nce()}, 6) AS loss")
def loss_infonce(spark, d):
    return losses.infonce(pairs(spark, d)).select(F.round("loss", 6).alias("loss"))


@register(f"WITH {P_SQL} SELECT round({nce(where='item = other OR s <= own + 0.1')}, 6) AS loss")
def loss_infonce_margin(spark, d):
    return losses.infonce(pairs(spark, d), margin=0.1).select(F.round("loss", 6).alias("loss"))


# Negatives: each fourth row of a batch gives its query vector.
HARD = f"""c AS (SELECT batch, item AS of, p AS v FROM x UNION ALL SELECT batch, item, q FROM x WHERE item % 4 = 0),
l AS (SELECT x.item, ln(sum(exp({cosine('q', 'v')} / 0.05))) - any_value({cosine('q', 'p')}) / 0.05 AS l FROM x JOIN c ON c.batch = x.batch AND $on GROUP BY x.item) SELECT round(avg(l), 6) AS loss FROM l"""


def negatives(rows):
    return rows.where("item % 4 = 0").select("batch", "item", F.col("q").alias("v"))


@register(f"WITH {P_SQL}, {HARD.replace('$on', 'true')}")
def loss_infonce_shared_negatives(spark, d):
    rows = pairs(spark, d)
    return losses.infonce(rows, negatives=negatives(rows)).select(F.round("loss", 6).alias("loss"))


@register(f"WITH {P_SQL}, {HARD.replace('$on', 'c.of = x.item')}")
def loss_infonce_own_negatives(spark, d):
    rows = pairs(spark, d)
    return losses.infonce(rows, negatives=negatives(rows), in_batch=False).select(F.round("loss", 6).alias("loss"))


@register(f"WITH {P_SQL} SELECT round(({nce()} + {nce(swap=True)}) / 2, 6) AS loss")
def loss_infonce_symmetric(spark, d):
    return losses.infonce(pairs(spark, d), symmetric=True).select(F.round("loss", 6).alias("loss"))


@register(f"WITH {P_SQL} SELECT round(({nce('[1:64]')} + {nce('[1:32]')} + {nce('[1:16]')}) / 3, 6) AS loss")
def loss_matryoshka(spark, d):
    return losses.matryoshka(pairs(spark, d), [64, 32, 16]).select(F.round("loss", 6).alias("loss"))


@register(f"WITH {P_SQL}, c AS (SELECT batch, label AS s, {cosine('q', 'p')} AS c FROM x), l AS (SELECT a.batch, ln(1 + sum(exp(20 * (b.c - a.c)))) AS l FROM c a JOIN c b ON a.batch = b.batch AND a.s > b.s GROUP BY a.batch) SELECT round(avg(l), 6) AS loss FROM l")
def loss_cosent(spark, d):
    scored = pairs(spark, d).select("batch", F.col("label").alias("score"), V.dot(F.col("q"), F.col("p")).alias("cosine"))
    return losses.cosent(scored).select(F.round("loss", 6).alias("loss"))


@register(f"WITH {P_SQL}, t AS (SELECT q, p, lead(p) OVER (PARTITION BY batch ORDER BY item) AS n FROM x) SELECT round(avg(greatest(0, {cosine('q', 'n')} - {cosine('q', 'p')} + 0.2)), 6) AS loss FROM t WHERE n IS NOT NULL")
def loss_triplet(spark, d):
    rows = pairs(spark, d).withColumn("n", F.lead("p").over(Window.partitionBy("batch").orderBy("item"))).where("n IS NOT NULL")
    return losses.triplet(rows).select(F.round("loss", 6).alias("loss"))


@register("SELECT event_id AS step, round(CASE WHEN event_id < 100 THEN 0.001 * event_id / 100.0 ELSE 0.001 * greatest(0, (5000 - event_id) / 4900.0) END, 9) AS rate FROM events")
def lr_schedule(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("step"))
    return e.select("step", F.round(losses.learning_rate(F.col("step"), 0.001, 100, 5000), 9).alias("rate"))
