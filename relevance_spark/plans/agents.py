"""Queries of routers, memories and the service desk."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from relevance_spark.operators import agents, dense
from relevance_spark.plans.dense import SIMS, V_SQL, cosine, ranked, searched, vectors

QUERIES: dict = {}


def register(sql: str | None = None, name: str | None = None):
    def put(fn):
        QUERIES[name or fn.__name__] = (fn, sql)
        return fn

    return put


def routes(spark, d):
    return vectors(spark, d).select(F.col("label").alias("route"), "vec")


ROUTED = "best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, route) AS r FROM rs)"
CHOSEN = "SELECT query_id, CASE WHEN round(score, 9) >= 0.2 THEN route END AS route, round(score, 6) AS score FROM best WHERE r = 1"
RS = {
    "max": f"WITH {SIMS}, rs AS (SELECT query_id, label AS route, max(score) AS score FROM s GROUP BY query_id, label)",
    "mean": f"WITH {SIMS}, rs AS (SELECT query_id, label AS route, avg(score) AS score FROM s GROUP BY query_id, label)",
    "centroid": f"""WITH {V_SQL}, u AS (SELECT label, p, avg(vec[p] / greatest(sqrt(list_dot_product(vec, vec)), 1e-12)) AS x FROM v, range(1, 65) r(p) GROUP BY label, p), c AS (SELECT label, list(x ORDER BY p) AS vec FROM u GROUP BY label),
rs AS (SELECT query_id, label AS route, {cosine('qv', 'vec')} AS score FROM q, c)""",
}


def _route(how: str):
    @register(f"{RS[how]}, {ROUTED} {CHOSEN}", f"route_{how}")
    def one(spark, d):
        scores = agents.route_scores(searched(spark, d), routes(spark, d), how)
        return agents.choose(scores, 0.2).select("query_id", "route", F.round("score", 6).alias("score"))


for _how in RS:
    _route(_how)


@register(f"{RS['max']}, {ROUTED} SELECT query_id, CASE WHEN round(score, 9) >= CASE WHEN route % 2 = 0 THEN 0.3 ELSE 0.2 END THEN route END AS route, round(score, 6) AS score FROM best WHERE r = 1")
def route_thresholds(spark, d):
    """Even routes have a threshold of their own."""
    own = spark.range(0, 10, 2).select(F.col("id").cast("int").alias("route"), F.lit(0.3).alias("threshold"))
    scores = agents.route_scores(searched(spark, d), routes(spark, d).withColumn("route", F.col("route").cast("int")), "max")
    return agents.choose(scores, 0.2, own).select("query_id", "route", F.round("score", 6).alias("score"))


@register(f"{RS['mean']}, {ROUTED} SELECT query_id, route, r::INT AS rank, round(score, 6) AS score FROM best WHERE r <= 3")
def route_topk(spark, d):
    scores = agents.route_scores(searched(spark, d), routes(spark, d), "mean")
    return agents.shortlist(scores, 3).select("query_id", "route", "rank", F.round("score", 6).alias("score"))


@register(f"WITH {SIMS}, b AS (SELECT query_id, query_label < 8 AS known, max(score) AS score FROM s WHERE id <> query_id AND label < 8 GROUP BY ALL), e AS (SELECT min(score) FILTER (known) AS lo, max(score) FILTER (NOT known) AS hi FROM b) SELECT round(CASE WHEN lo > hi THEN (lo + hi) / 2 END, 6) AS threshold, round(lo, 6) AS lo, round(hi, 6) AS hi FROM e")
def router_calibration(spark, d):
    q, v = searched(spark, d), vectors(spark, d).where("label < 8")
    best = dense.search(q, v, 1, exclude_self=True).join(q.select("query_id", "query_label"), "query_id").select("score", (F.col("query_label") < 8).alias("known"))
    return agents.calibrated_threshold(best).select(*[F.round(c, 6).alias(c) for c in ("threshold", "lo", "hi")])


def pool(spark, d, k):
    return dense.search(searched(spark, d), vectors(spark, d), k).withColumn("created_at", F.col("id").cast("double"))


DECAY = "WITH {s}, {p}, y AS (SELECT query_id, id, rank, score * power(0.5, greatest(0, 5000 - id) / 700.0) AS score FROM rk), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rank)::INT AS r FROM y) SELECT query_id, id, r AS rank, round(score, 6) AS score FROM z WHERE r <= 5"


@register(DECAY.format(s=SIMS, p=ranked("s", 20)))
def memory_recall_decay(spark, d):
    return agents.decayed(pool(spark, d, 20), 5000.0, 700.0, 5).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@register(f"WITH {SIMS}, {ranked('s', 5)} SELECT query_id, id, rank, round(score, 6) AS score, id::DOUBLE AS created_at FROM rk")
def memory_recall(spark, d):
    return pool(spark, d, 5).select("query_id", "id", "rank", F.round("score", 6).alias("score"), "created_at")


@register("SELECT conv_id, turn, role FROM conversations WHERE coalesce(turn, 0) >= 8 - 5")
def memory_forget_older_than(spark, d):
    kept, _ = agents.expire(spark.read.parquet(f"{d}/conversations.parquet"), 8.0, 5.0, "turn")
    return kept.select("conv_id", "turn", "role")


# A request names a nation, a customer and an order; every third one names the wrong customer.
DESK = """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS cust, o_orderpriority AS topic FROM orders),
j AS (SELECT r.*, o.o_orderstatus AS status, c.c_nationkey AS nation, n.n_name FROM r LEFT JOIN orders o ON o.o_orderkey = r.o_orderkey AND o.o_custkey = r.cust LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey)
SELECT o_orderkey, CASE WHEN topic = '5-LOW' THEN NULL ELSE status END AS status, CASE WHEN topic = '5-LOW' THEN NULL ELSE n_name END AS tenant, CASE WHEN topic = '5-LOW' THEN 'route' WHEN status IS NULL THEN 'order' WHEN status = 'P' THEN 'policy' END AS reason FROM j"""


@register(DESK)
def service_desk_packets(spark, d):
    """The first failing stage gives the reason; an order that is missing and one of another customer look alike."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    asked = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"), F.col("o_orderpriority").alias("topic"))
    owned = orders.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"))
    customer = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nation = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("tenant"))
    j = asked.join(owned, ["o_orderkey", "o_custkey"], "left").join(customer, "o_custkey", "left").join(nation, "c_nationkey", "left")
    off = F.col("topic") == "5-LOW"
    reason = F.when(off, "route").when(F.col("status").isNull(), "order").when(F.col("status") == "P", "policy")
    hidden = lambda c: F.when(~(off | F.col("status").isNull()), F.col(c)).alias(c)
    return j.select("o_orderkey", hidden("status"), hidden("tenant"), reason.alias("reason"))


@register("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::INT AS recency FROM conversations WHERE trim(coalesce(text, '')) <> ''")
def memory_timeline(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    c = spark.read.parquet(f"{d}/conversations.parquet").where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return c.select("conv_id", "turn", "role", F.row_number().over(w).alias("recency"))
