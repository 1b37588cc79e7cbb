"""Queries that measure rankings, rejection, correlation and latency."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from relevance_spark.functions import vectors as V
from relevance_spark.operators import dense, evaluation
from relevance_spark.operators.ranking import first_occurrences
from relevance_spark.plans.dense import SIMS, cosine, ranked, searched, vectors
from relevance_spark.sources.readers import table_digest

QUERIES: dict = {}


def register(sql: str | None = None, name: str | None = None):
    def put(fn):
        QUERIES[name or fn.__name__] = (fn, sql)
        return fn

    return put


def run_and_qrels(spark, d):
    q, v = searched(spark, d), vectors(spark, d)
    run = dense.search(q, v, 10, exclude_self=True).select("query_id", "id", "rank")
    qrels = q.select("query_id", "query_label").join(v.select("id", "label"), F.col("query_label") == F.col("label")).where("id <> query_id").select("query_id", "id", F.lit(1.0).alias("rel"))
    return run, qrels


EVAL = f"""WITH {SIMS}, {ranked('s', 10, where='id <> query_id')}, qr AS (SELECT query_id, id FROM s WHERE label = query_label AND id <> query_id), n AS (SELECT query_id, count(*) AS n FROM qr GROUP BY query_id),
t AS (SELECT rk.query_id, rank, CASE WHEN qr.id IS NULL THEN 0 ELSE 1 END AS rel FROM rk LEFT JOIN qr ON qr.query_id = rk.query_id AND qr.id = rk.id WHERE rank <= $k),
u AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS cum FROM t),
a AS (SELECT query_id, sum(rel) AS hits, min(CASE WHEN rel = 1 THEN rank END) AS first, sum(rel / log2(rank + 1)) AS dcg, sum(rel * cum / rank) AS ap FROM u GROUP BY query_id),
i AS (SELECT query_id, sum(1 / log2(j + 1)) AS idcg FROM n, range(1, $k + 1) r(j) WHERE j <= n GROUP BY query_id),
m AS (SELECT n.query_id, coalesce(hits / n, 0) AS recall, coalesce(hits / $k, 0) AS precision, CASE WHEN hits > 0 THEN 1.0 ELSE 0 END AS hit, coalesce(1 / first, 0) AS mrr, coalesce(dcg / idcg, 0) AS ndcg, coalesce(ap / n, 0) AS map
FROM n LEFT JOIN a USING (query_id) LEFT JOIN i USING (query_id))"""


def _metric(metric: str):
    @register(EVAL.replace("$k", "10") + f" SELECT query_id, round({metric}, 6) AS value FROM m", f"eval_{metric}")
    def one(spark, d):
        run, qrels = run_and_qrels(spark, d)
        return evaluation.per_query(run, qrels, 10).select("query_id", F.round(metric, 6).alias("value"))


for _m in evaluation.METRICS:
    _metric(_m)

_LONG = " UNION ALL ".join(f"SELECT '{m}' AS metric, {{k}}::INT AS k, round(avg({m}), 6) AS value FROM m" for m in evaluation.METRICS)
_AT = [f"SELECT * FROM ({EVAL.replace('$k', str(k))} {_LONG.format(k=k)})" for k in (1, 5, 10)]


@register(" UNION ALL ".join(_AT))
def evaluate_run(spark, d):
    run, qrels = run_and_qrels(spark, d)
    return evaluation.evaluate(run, qrels, [1, 5, 10]).withColumn("value", F.round("value", 6))


@register(EVAL.replace("$k", "1") + ", l AS (SELECT query_label, avg(hit) AS hit1, count(*) AS n FROM m JOIN (SELECT DISTINCT query_id, query_label FROM q) USING (query_id) GROUP BY query_label) SELECT query_label AS label, n::BIGINT AS n, round(hit1, 6) AS hit1 FROM l UNION ALL SELECT -1, sum(n)::BIGINT, round(avg(hit1), 6) FROM l")
def ranking_metrics_by_label(spark, d):
    run, qrels = run_and_qrels(spark, d)
    per = evaluation.per_query(run, qrels, 1).join(searched(spark, d).select("query_id", "query_label"), "query_id")
    by = per.groupBy(F.col("query_label").alias("label")).agg(F.count("*").alias("n"), F.avg("hit").alias("hit1"))
    every = by.agg(F.lit(-1).alias("label"), F.sum("n").alias("n"), F.avg("hit1").alias("hit1"))
    return by.unionByName(every).select("label", "n", F.round("hit1", 6).alias("hit1"))


@register(EVAL.replace("$k", "10") + " SELECT round(avg(hit), 6) AS hit_rate, round(avg(recall), 6) AS mean_recall FROM m")
def candidate_coverage(spark, d):
    run, qrels = run_and_qrels(spark, d)
    return evaluation.per_query(run, qrels, 10).agg(F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("recall"), 6).alias("mean_recall"))


@register(EVAL.replace("$k", "10") + " SELECT count(*)::BIGINT AS n, round(avg(ndcg), 6) AS ndcg FROM m WHERE query_id NOT IN (SELECT query_id FROM rk WHERE rank = 1 AND label = query_label)")
def overlap_filtered_metrics(spark, d):
    run, qrels = run_and_qrels(spark, d)
    easy = run.where("rank = 1").join(qrels, ["query_id", "id"]).select("query_id")
    return evaluation.per_query(run, qrels, 10).join(easy, "query_id", "left_anti").agg(F.count("*").alias("n"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


@register(f"""WITH {SIMS}, {ranked('s', 20)}, b AS (SELECT query_id, label AS id, min(rank) AS old FROM rk GROUP BY query_id, label) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY old)::INT AS rank FROM b""")
def dedup_ranked_run(spark, d):
    run = dense.search(searched(spark, d), vectors(spark, d), 20).join(vectors(spark, d).select("id", "label"), "id")
    return first_occurrences(run.select("query_id", F.col("label").alias("id"), "rank"))


# Queries of labels 8 and 9 are out of scope; the gallery holds the others.
REJ = f"""WITH {SIMS}, {ranked('s', 1, where='id <> query_id AND label < 8')}, r AS (SELECT query_id, query_label < 8 AS in_scope, label = query_label AS correct, round(score, 9) AS score FROM rk)"""


def rejected(spark, d):
    q, v = searched(spark, d), vectors(spark, d)
    top = dense.search(q, v.where("label < 8"), 1, exclude_self=True).join(v.select("id", "label"), "id").join(q.select("query_id", "query_label"), "query_id")
    return top.select("query_id", (F.col("query_label") < 8).alias("in_scope"), (F.col("label") == F.col("query_label")).alias("correct"), F.round("score", 9).alias("score"))


@register(REJ + """ SELECT round(count(*) FILTER (in_scope AND score >= 0.3) / nullif(count(*) FILTER (in_scope), 0), 6) AS coverage, round(count(*) FILTER (NOT in_scope AND score >= 0.3) / nullif(count(*) FILTER (NOT in_scope), 0), 6) AS false_acceptance,
round(count(*) FILTER (in_scope AND correct AND score >= 0.3) / nullif(count(*) FILTER (in_scope AND score >= 0.3), 0), 6) AS accepted_accuracy FROM r""")
def rejection_metrics(spark, d):
    return evaluation.rejection(rejected(spark, d), 0.3).select(*[F.round(c, 6).alias(c) for c in ("coverage", "false_acceptance", "accepted_accuracy")])


@register(REJ + """, c AS (SELECT DISTINCT score AS threshold, false AS above FROM r UNION SELECT DISTINCT score, true FROM r),
e AS (SELECT threshold, above, count(*) FILTER (in_scope AND (score > threshold OR NOT above AND score = threshold)) / count(*) FILTER (in_scope) AS coverage, count(*) FILTER (NOT in_scope AND (score > threshold OR NOT above AND score = threshold)) / count(*) FILTER (NOT in_scope) AS fa FROM c, r GROUP BY ALL)
SELECT round(threshold, 6) AS threshold, above, round(coverage, 6) AS coverage, round(fa, 6) AS false_acceptance FROM e WHERE fa <= 0.2 ORDER BY coverage DESC, fa, e.threshold, above LIMIT 1""")
def select_rejection_threshold(spark, d):
    one = evaluation.sweep(rejected(spark, d), 0.2)
    return one.select(F.round("threshold", 6).alias("threshold"), "above", F.round("coverage", 6).alias("coverage"), F.round("false_acceptance", 6).alias("false_acceptance"))


@register(REJ + " SELECT query_id, in_scope, score >= 0.3 AS accepted, CASE WHEN score >= 0.3 THEN 'match' ELSE 'no match' END AS status, round(score, 6) AS score FROM r")
def intent_match(spark, d):
    hit = F.col("score") >= 0.3
    return rejected(spark, d).select("query_id", "in_scope", hit.alias("accepted"), F.when(hit, "match").otherwise("no match").alias("status"), F.round("score", 6).alias("score"))


STS = f"x AS (SELECT a.vec_id, {cosine('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')} AS c, abs(a.label - b.label)::DOUBLE AS g FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def pairs(spark, d):
    v = vectors(spark, d)
    nxt = v.select((F.col("id") - 1).alias("id"), F.col("vec").alias("v2"), F.col("label").alias("l2"))
    return v.join(nxt, "id").select(F.round(V.dot(V.unit(F.col("vec")), V.unit(F.col("v2"))), 9).alias("c"), F.abs(F.col("label") - F.col("l2")).cast("double").alias("g"))


@register(f"WITH {STS} SELECT round(coalesce(corr(round(c, 9), g), 0), 6) AS value FROM x")
def sts_pearson(spark, d):
    return evaluation.pearson(pairs(spark, d), "c", "g").select(F.round("value", 6).alias("value"))


@register(f"WITH {STS}, r AS (SELECT rank() OVER (ORDER BY round(c, 9)) + (count(*) OVER (PARTITION BY round(c, 9)) - 1) / 2 AS rc, rank() OVER (ORDER BY g) + (count(*) OVER (PARTITION BY g) - 1) / 2 AS rg FROM x) SELECT round(corr(rc, rg), 6) AS value FROM r")
def sts_spearman(spark, d):
    return evaluation.spearman(pairs(spark, d), "c", "g").select(F.round("value", 6).alias("value"))


@register("""SELECT user_id % 10 AS client, count(*)::BIGINT AS n, count(*) FILTER (event_type <> 'error')::BIGINT AS succeeded, count(*) FILTER (event_type = 'error')::BIGINT AS failed, round(quantile_cont(value, 0.5) FILTER (event_type <> 'error'), 6) AS p50,
round(quantile_cont(value, 0.95) FILTER (event_type <> 'error'), 6) AS p95, round(count(*) FILTER (event_type <> 'error') / nullif(epoch(max(ts)) - epoch(min(ts)), 0), 9) AS per_second FROM events GROUP BY 1""")
def latency_summary(spark, d):
    """Requests by client: what succeeded and failed, quantiles of successes, and successes per second of the time they span."""
    e = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 10).alias("client"), "value", "ts", (F.col("event_type") != "error").alias("ok"))
    good = F.when(F.col("ok"), F.col("value"))
    span = (F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - F.min(F.unix_micros(F.col("ts").cast("timestamp")))) / 1e6
    by = e.groupBy("client").agg(F.count("*").alias("n"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.percentile(good, F.array(F.lit(0.5), F.lit(0.95))).alias("p"), span.alias("span"))
    return by.select("client", "n", "succeeded", "failed", F.round(F.col("p")[0], 6).alias("p50"), F.round(F.col("p")[1], 6).alias("p95"), F.round(F.try_divide(F.col("succeeded").cast("double"), "span"), 9).alias("per_second"))


@register("SELECT event_type AS error, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def error_histogram(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("error")).agg(F.count("*").alias("n"))


@register("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def trailing_mean(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-9, 0)
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean"))


@register("SELECT time_bucket(INTERVAL '1 day', ts)::DATE AS day, count(*)::BIGINT AS n, count(*) FILTER (event_type = 'error')::BIGINT AS failed, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def latency_by_day(spark, d):
    from relevance_spark.streaming.ingest import latency_windows

    e = spark.read.parquet(f"{d}/events.parquet").select("ts", "value", (F.col("event_type") != "error").alias("ok"))
    return latency_windows(e).select(F.to_date("window.start").alias("day"), "n", "failed", F.round("mean", 6).alias("mean"))


@register()
def paired_bootstrap(spark, d):
    run, qrels = run_and_qrels(spark, d)
    q = searched(spark, d)
    short = dense.search(q.withColumn("vec", F.slice("vec", 1, 16)), vectors(spark, d).withColumn("vec", F.slice("vec", 1, 16)), 10, exclude_self=True)
    a, b = evaluation.per_query(run, qrels, 10), evaluation.per_query(short, qrels, 10)
    diff = a.select("query_id", F.col("ndcg").alias("x")).join(b.select("query_id", F.col("ndcg").alias("y")), "query_id").join(q.select("query_id", F.col("query_label").alias("group")), "query_id")
    found = evaluation.bootstrap(diff.groupBy("group").agg(F.count("*").alias("n"), F.sum(F.col("x") - F.col("y")).alias("total")))
    return spark.createDataFrame([(found["mean"], found["low"], found["high"], _verdict(found))], "mean double, low double, high double, verdict string")


def _verdict(ci: dict, target: float = 0.01) -> str:
    if ci["high"] <= 0:
        return "no_gain"
    if ci["low"] <= 0:
        return "inconclusive"
    return "practical" if ci["mean"] >= target else "improved_below_target"


@register()
def prediction_digest(spark, d):
    run, _ = run_and_qrels(spark, d)
    return spark.createDataFrame([(table_digest(run),)], "digest string")
