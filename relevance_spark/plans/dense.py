"""Queries over vectors: as queries every row whose id is divisible by 100, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from relevance_spark.functions import vectors as V
from relevance_spark.operators import dense
from relevance_spark.operators.graph import shared_folder
from relevance_spark.operators.ranking import reciprocal_rank_fusion, where_metadata
from relevance_spark.operators.retrieval import Retriever
from relevance_spark.sources import snapshots

QUERIES: dict = {}


def register(sql: str | None = None):
    def put(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return put


def vectors(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def searched(spark, d):
    return vectors(spark, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), "vec", F.col("label").alias("query_label"))


def cosine(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / (greatest(sqrt(list_dot_product({a}, {a})), 1e-12) * greatest(sqrt(list_dot_product({b}, {b})), 1e-12))"


V_SQL = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings), q AS (SELECT id AS query_id, vec AS qv, label AS query_label FROM v WHERE id % 100 = 0)"
SIMS = f"{V_SQL}, s AS (SELECT query_id, id, label, query_label, {cosine('qv', 'vec')} AS score FROM q, v)"


def ranked(source: str, k: int, name: str = "rk", where: str = "true") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id::VARCHAR)::INT AS rank FROM {source} WHERE {where}) WHERE rank <= {k})"


OUT = "SELECT query_id, id, rank, round(score, 6) AS score"
out = lambda df: df.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@register(f"WITH {SIMS}, {ranked('s', 10)} {OUT} FROM rk")
def dense_topk_cosine(spark, d):
    return out(dense.search(searched(spark, d), vectors(spark, d), 10))


@register(f"WITH {V_SQL}, s AS (SELECT query_id, id, list_dot_product(qv, vec) AS score FROM q, v), {ranked('s', 10)} {OUT} FROM rk")
def dense_topk_dot(spark, d):
    return out(dense.search(searched(spark, d), vectors(spark, d), 10, metric="dot"))


@register(f"WITH {SIMS}, {ranked('s', 10, where='label = 3')} {OUT} FROM rk")
def filtered_dense_topk(spark, d):
    return out(dense.search(searched(spark, d), where_metadata(vectors(spark, d), {"label": 3}), 10))


@register(f"WITH {SIMS}, {ranked('s', 10)} {OUT} FROM rk WHERE score >= 0.25")
def dense_min_score(spark, d):
    return out(Retriever(vectors(spark, d)).search(searched(spark, d), 10, min_score=0.25))


@register(f"WITH {SIMS} SELECT query_id, id, round(score, 6) AS score FROM s")
def cosine_matrix(spark, d):
    return dense.scored_pairs(searched(spark, d), vectors(spark, d)).withColumn("score", F.round("score", 6))


@register("SELECT vec_id AS id, unnest(range(1, len(embedding) + 1))::INT AS pos, round(unnest(embedding)::DOUBLE / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12), 6) AS x FROM embeddings")
def l2_normalize(spark, d):
    return vectors(spark, d).select("id", F.posexplode(V.unit(F.col("vec"))).alias("pos", "x")).select("id", (F.col("pos") + 1).alias("pos"), F.round("x", 6).alias("x"))


@register("SELECT id, unnest(range(1, 17))::INT AS pos, round(unnest(t) / greatest(sqrt(list_dot_product(t, t)), 1e-12), 6) AS x FROM (SELECT vec_id AS id, embedding[1:16]::DOUBLE[] AS t FROM embeddings)")
def matryoshka_truncate(spark, d):
    return vectors(spark, d).select("id", F.posexplode(V.truncated(F.col("vec"), 16)).alias("pos", "x")).select("id", (F.col("pos") + 1).alias("pos"), F.round("x", 6).alias("x"))


@register("SELECT vec_id AS id, unnest(range(1, len(embedding) + 1))::INT AS pos, round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings")
def embedding_export_round6(spark, d):
    rounded = F.transform("vec", lambda x: F.round(x.cast("double"), 6))
    return vectors(spark, d).select("id", F.posexplode(rounded).alias("pos", "x")).select("id", (F.col("pos") + 1).alias("pos"), "x")


@register(f"""WITH {V_SQL}, a AS (SELECT query_id, id, {cosine('qv', 'vec')} AS score FROM q, v), b AS (SELECT query_id, id, {cosine('qv[1:16]', 'vec[1:16]')} AS score FROM q, v),
{ranked('a', 50, 'ra')}, {ranked('b', 50, 'rb')}, f AS (SELECT query_id, id, sum(1.0 / (60.0 + rank)) AS score FROM (SELECT query_id, id, rank FROM ra UNION ALL SELECT query_id, id, rank FROM rb) GROUP BY query_id, id), {ranked('f', 10)} {OUT} FROM rk""")
def fused_dense_topk(spark, d):
    v, q = vectors(spark, d), searched(spark, d)
    short = lambda df: df.withColumn("vec", F.slice("vec", 1, 16))
    return out(reciprocal_rank_fusion([dense.search(q, v, 50), dense.search(short(q), short(v), 50)], 10))


@register(f"""WITH {V_SQL}, s AS (SELECT query_id, id, {cosine('qv[1:16]', 'vec[1:16]')} AS score, {cosine('qv', 'vec')} AS full_score FROM q, v), {ranked('s', 40)},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(full_score, 9) DESC, rank)::INT AS r2 FROM rk) SELECT query_id, id, r2 AS rank, round(full_score, 6) AS score, round(score, 6) AS retrieval_score FROM r WHERE r2 <= 10""")
def encoder_rerank_topk(spark, d):
    v, q = vectors(spark, d), searched(spark, d)
    corpus = v.select("id", F.slice("vec", 1, 16).alias("vec"), F.col("vec").alias("wide"))
    first = dense.search(q.select("query_id", F.slice("vec", 1, 16).alias("vec")), corpus, 40)
    from relevance_spark.operators.ranking import rerank

    both = first.join(corpus.select("id", "wide"), "id").join(q.select("query_id", F.col("vec").alias("qv")), "query_id")
    again = rerank(both, V.dot(V.unit(F.col("qv")), V.unit(F.col("wide"))), 10)
    return out(again.withColumn("retrieval_score", F.round("retrieval_score", 6))).join(again.select("query_id", "id", F.round("retrieval_score", 6).alias("retrieval_score")), ["query_id", "id"])


@register(f"WITH {SIMS}, {ranked('s', 10)} {OUT} FROM rk")
def snapshot_roundtrip_topk(spark, d):
    path = f"{shared_folder(spark, 'snapshot')}/corpus"
    snapshots.save(vectors(spark, d), path, "fixture", 64)
    corpus, _ = snapshots.load(spark, path, "fixture")
    return out(dense.search(searched(spark, d), corpus, 10))


KEPT = "label < 5"


@register()
def ann_overfetch_postfilter(spark, d):
    return out(dense.approximate_search(searched(spark, d), vectors(spark, d), 10, 64, predicate=KEPT))


@register()
def ann_persisted_topk(spark, d):
    """The same search over an index that was written and read again."""
    path = f"{shared_folder(spark, 'ann')}/index"
    dense.ApproximateIndex.build(vectors(spark, d), 64).save(path, "fixture")
    return out(dense.ApproximateIndex.load(spark, path, "fixture").search(searched(spark, d), 10, predicate=KEPT))


@register()
def ann_recall_vs_exact(spark, d):
    """Share of the exact top ten that the index finds, for all rows and for those that ann_overfetch_postfilter keeps."""
    q, v = searched(spark, d), vectors(spark, d)

    def recall(corpus, name, predicate=None):
        exact = dense.search(q, corpus, 10).select("query_id", "id")
        near = dense.approximate_search(q, v, 10, 64, predicate=predicate).select("query_id", "id", F.lit(1).alias("hit"))
        return exact.join(near, ["query_id", "id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias(name))

    return recall(v, "recall").join(recall(v.where(KEPT), "filtered_recall", KEPT), "query_id")


@register(f"""WITH {SIMS}, k AS (SELECT query_id, id, list_cosine_similarity(qv, vec) AS b, score AS a FROM (SELECT * FROM s JOIN (SELECT id AS i, vec FROM v) ON i = id JOIN (SELECT query_id AS j, qv FROM q) ON j = query_id)) SELECT count(*)::BIGINT AS n, count(*) FILTER (abs(a - b) > 2e-5 + 2e-4 * abs(b))::BIGINT AS apart, round(max(abs(a - b)), 6) AS largest FROM k""")
def vector_parity(spark, d):
    """Cosines by expressions against those of the matrix kernel, which keeps all rows here."""
    q, v = searched(spark, d), vectors(spark, d)
    both = dense.scored_pairs(q, v).join(dense.search(q, v, v.count()).select("query_id", "id", F.col("score").alias("b")), ["query_id", "id"], "full")
    gap = F.abs(F.col("score") - F.col("b"))
    return both.agg(F.count("*").alias("n"), F.count_if(gap.isNull() | (gap > 2e-5 + 2e-4 * F.abs("b"))).alias("apart"), F.round(F.max(gap), 6).alias("largest"))


@register("""WITH t AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings) SELECT id, p::INT AS pos, round((e[p] + e[16 + p] + e[32 + p]) / 3, 6) AS mean, round(e[32 + p], 6) AS last, round(e[p], 6) AS first
FROM t, range(1, 17) r(p)""")
def pool_mean_last_first(spark, d):
    # Each vector as four states of sixteen numbers, of which the last is masked out.
    states = F.array(*[F.slice("vec", 1 + 16 * i, 16) for i in range(4)])
    mask = F.array(F.lit(1), F.lit(1), F.lit(1), F.lit(0))
    three = {how: V.pooled(states, mask, how) for how in ("mean", "last", "first")}
    zipped = F.arrays_zip(*[v.alias(k) for k, v in three.items()])
    rows = vectors(spark, d).select("id", F.posexplode(zipped).alias("pos", "z"))
    return rows.select("id", (F.col("pos") + 1).alias("pos"), *[F.round(F.col("z")[k].cast("double"), 6).alias(k) for k in three])
