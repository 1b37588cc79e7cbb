"""Queries over texts: tokens, projections, BM25 and what is built on it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from relevance_spark.functions import text as X
from relevance_spark.operators import bm25, chunking, corpus, encoders
from relevance_spark.operators.ranking import rerank
from relevance_spark.operators.retrieval import HybridRetriever, context

QUERIES: dict = {}


def register(sql: str | None = None):
    def put(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return put


def documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").withColumnRenamed("doc_id", "id")


def items(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")


TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
PARTS = rf"""d AS (SELECT doc_id AS id, lang, source, text, {TOK} AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
po AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY id, term),
te AS (SELECT term, count(*) AS df FROM po GROUP BY term),
q AS (SELECT item_id AS query_id, unnest(list_distinct({TOK})) AS term FROM benchmark),
sc AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
       FROM po JOIN q USING (term) JOIN te USING (term), st GROUP BY query_id, id)"""


def ranked_sql(source: str, k: int, name: str = "rk") -> str:
    return f"{name} AS (SELECT *, rank AS rank_ FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id::VARCHAR) AS rank FROM {source}) WHERE rank <= {k})"


RANKED = "SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score"
out = lambda df: df.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@register(f"WITH {PARTS}, {ranked_sql('sc', 10)} {RANKED} FROM rk")
def bm25_topk(spark, d):
    return out(bm25.search(bm25.build(documents(spark, d)), items(spark, d), 10))


@register(f"WITH {PARTS} SELECT query_id, id, round(score, 6) AS score FROM sc")
def bm25_scores(spark, d):
    return bm25.scores(bm25.build(documents(spark, d)), items(spark, d)).withColumn("score", F.round("score", 6))


@register(f"WITH {PARTS}, f AS (SELECT sc.* FROM sc JOIN d USING (id) WHERE lang = 'en' AND length(text) > 1000), {ranked_sql('f', 10)} {RANKED} FROM rk")
def filtered_bm25_predicate(spark, d):
    docs = documents(spark, d)
    return out(bm25.search(bm25.build(docs), items(spark, d), 10, allowed=docs.where("lang = 'en' AND length(text) > 1000")))


@register(f"WITH {PARTS}, f AS (SELECT sc.* FROM sc JOIN d USING (id) WHERE source = 'src1'), {ranked_sql('f', 5)} {RANKED} FROM rk")
def bm25_filtered_global_stats(spark, d):
    docs = documents(spark, d)
    return out(bm25.search(bm25.build(docs), items(spark, d), 5, allowed=docs.where("source = 'src1'")))


@register(f"WITH {PARTS} SELECT term, df::BIGINT AS df, n::BIGINT AS n, round(avgdl, 6) AS avgdl FROM te, st")
def bm25_corpus_stats(spark, d):
    index = bm25.build(documents(spark, d))
    return index.terms.join(F.broadcast(index.stats)).select("term", "df", "n", F.round("avgdl", 6).alias("avgdl"))


@register(f"SELECT id, term, tf::BIGINT AS tf FROM (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({TOK}) AS term FROM documents) GROUP BY id, term)")
def tokenize_counts(spark, d):
    return bm25.build(documents(spark, d)).postings.select("id", "term", "tf")


@register(rf"""WITH t AS (SELECT {TOK} AS w FROM documents), g AS (SELECT unnest(w) AS gram, 1 AS n FROM t UNION ALL
SELECT w[i] || ' ' || w[i + 1], 2 FROM (SELECT w, unnest(range(1, len(w))) AS i FROM t)) SELECT gram, n::INT AS n, count(*)::BIGINT AS c FROM g GROUP BY gram, n""")
def word_ngram_counts(spark, d):
    w = documents(spark, d).select(X.tokens(F.col("text")).alias("w"))
    grams = w.select(F.explode("w").alias("gram"), F.lit(1).alias("n")).union(w.select(F.explode(X.word_ngrams(F.col("w"), 2)), F.lit(2)))
    return grams.groupBy("gram", "n").agg(F.count("*").alias("c"))


HASHED = rf"""w AS (SELECT doc_id AS id, {TOK} AS w FROM documents), g AS (SELECT id, unnest(w) AS g FROM w UNION ALL
SELECT id, w[i] || ' ' || w[i + 1] FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM w)), h AS (SELECT id, sha256('w:' || g) AS h FROM g),
s AS (SELECT id, (('0x' || substr(h, 1, 8))::BIGINT % 64)::INT AS bucket, sum(CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT % 2 = 1 THEN 1.0 ELSE -1.0 END) AS s FROM h GROUP BY ALL)"""


@register(f"WITH {HASHED} SELECT id, bucket, round(sign(s) * ln(1 + abs(s)), 6) AS value FROM s WHERE s <> 0")
def feature_hash_sha256(spark, d):
    return encoders.sql_hash_vectors(documents(spark, d)).withColumn("value", F.round("value", 6))


@register()
def hash_embed(spark, d):
    return documents(spark, d).select("id", encoders.HashingEncoder(native_dim=128).vectors(F.col("text")).alias("vec"))


@register()
def encode_documents(spark, d):
    vec = encoders.HashingEncoder(native_dim=256, characters=None, output_dim=64, document_template="passage: {text}").vectors(F.col("text"))
    return documents(spark, d).select("id", F.array_join(F.transform(vec, lambda x: F.format_number(x, 5)), " ").alias("vec"))


@register("SELECT doc_id AS id, CASE WHEN lang IS NULL THEN text ELSE 'Instruct: ' || lang || chr(10) || 'Query: ' || text END AS prompt FROM documents")
def format_prompts(spark, d):
    return documents(spark, d).select("id", X.prompt("Instruct: {instruction}\nQuery: {text}", F.col("text"), F.col("lang")).alias("prompt"))


@register()
def chunk_documents(spark, d):
    return chunking.chunk_documents(documents(spark, d).select("id", "text"))


@register()
def chunk_digests(spark, d):
    """Ids of all chunks of all texts, whole, with their sizes and digests."""
    cut = chunking.chunk_documents(documents(spark, d).select("id", "text"))
    return cut.select("id", "parent_id", "chunk", F.length("text").alias("size"), F.md5("text").alias("text_md5"))


# Of the letters in these tables folding differs from lower case in one alone.
FOLDED = TOK.replace("lower(coalesce(text, ''))", "replace(lower(coalesce(text, '')), 'ß', 'ss')")
FP = f"sha256(array_to_string(list_sort({FOLDED}), ' '))"


@register(f"SELECT fp, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM (SELECT doc_id, {FP} AS fp FROM documents) GROUP BY fp HAVING count(*) > 1")
def text_fingerprint_groups(spark, d):
    fp = documents(spark, d).select("id", X.token_digest(F.col("text")).alias("fp"))
    return fp.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


@register("SELECT doc_id AS id, substr(replace(text, chr(10), ' '), 1, 160) AS snippet FROM documents")
def search_snippets(spark, d):
    return documents(spark, d).select("id", X.snippet(F.col("text")).alias("snippet"))


@register("SELECT source, sum(greatest(1, length(text) // 4))::BIGINT AS tokens FROM documents GROUP BY source")
def usage_token_estimate(spark, d):
    return documents(spark, d).groupBy("source").agg(F.sum(X.usage(F.col("text"))).alias("tokens"))


@register("SELECT doc_id::VARCHAR AS id, text, lang, source, n_chars FROM documents")
def scan_documents_metadata(spark, d):
    return documents(spark, d).withColumn("id", F.col("id").cast("string"))


@register(f"WITH {PARTS}, {ranked_sql('sc', 5)} SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score, text, lang, source FROM rk JOIN d USING (id)")
def search_hits_with_text(spark, d):
    docs = documents(spark, d)
    return out(bm25.search(bm25.build(docs), items(spark, d), 5)).join(docs.select("id", "text", "lang", "source"), "id")


@register(f"WITH {PARTS}, {ranked_sql('sc', 3)} SELECT query_id, string_agg('[' || id || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS context FROM rk JOIN d USING (id) GROUP BY query_id")
def rag_context(spark, d):
    docs = documents(spark, d)
    return context(bm25.search(bm25.build(docs), items(spark, d), 3).join(docs.select("id", "text"), "id"))


@register(f"WITH {PARTS}, {ranked_sql('sc', 5)} SELECT query_id, id, round(score, 4) AS score, lang FROM rk JOIN d USING (id)")
def tool_hits_view(spark, d):
    docs = documents(spark, d)
    hits = bm25.search(bm25.build(docs), items(spark, d), 5).join(docs.select("id", "lang"), "id")
    seen = hits.withColumn("m", F.map_filter(F.create_map(F.lit("lang"), F.col("lang"), F.lit("_rank"), F.col("rank").cast("string")), lambda k, v: ~k.startswith("_")))
    return seen.select("query_id", "id", F.round("score", 4).alias("score"), F.col("m")["lang"].alias("lang"))


@register(f"""WITH {PARTS}, {ranked_sql('sc', 20)}, r2 AS (SELECT query_id, id, rank AS first_rank, score AS retrieval_score, row_number() OVER (PARTITION BY query_id ORDER BY length(text) DESC, rank) AS rank
FROM rk JOIN d USING (id)) SELECT query_id, id, rank::INT AS rank, first_rank::INT AS first_rank, round(retrieval_score, 6) AS retrieval_score FROM r2 WHERE rank <= 5""")
def rerank_topk(spark, d):
    docs = documents(spark, d)
    hits = bm25.search(bm25.build(docs), items(spark, d), 20).join(docs.select("id", F.length("text").cast("double").alias("size")), "id")
    return rerank(hits, F.col("size"), 5).select("query_id", "id", "rank", "first_rank", F.round("retrieval_score", 6).alias("retrieval_score"))


@register(f"""WITH {PARTS}, {ranked_sql('sc', 20)} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank > 8, CASE WHEN rank <= 8 THEN length(text) END DESC NULLS LAST, rank)::INT AS rank FROM rk JOIN d USING (id)""")
def rerank_head_keep_tail(spark, d):
    docs = documents(spark, d)
    hits = bm25.search(bm25.build(docs), items(spark, d), 20).join(docs.select("id", F.length("text").cast("double").alias("size")), "id")
    return rerank(hits, F.col("size"), depth=8).select("query_id", "id", "rank")


HYBRID = PARTS.replace("FROM documents)", "FROM documents JOIN embeddings ON doc_id = vec_id)").replace("SELECT item_id AS query_id", "SELECT doc_id AS query_id").replace("FROM benchmark)", "FROM documents JOIN embeddings ON doc_id = vec_id WHERE doc_id % 100 = 0)")


@register(f"""WITH {HYBRID}, {ranked_sql('sc', 100)}, v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings JOIN documents ON doc_id = vec_id),
s2 AS (SELECT a.id AS query_id, b.id, list_dot_product(a.vec, b.vec) / (greatest(sqrt(list_dot_product(a.vec, a.vec)), 1e-12) * greatest(sqrt(list_dot_product(b.vec, b.vec)), 1e-12)) AS score FROM v a, v b WHERE a.id % 100 = 0),
{ranked_sql('s2', 100, 'rd')}, fu AS (SELECT query_id, id, sum(1.0 / (60.0 + rank)) AS score FROM (SELECT query_id, id, rank FROM rk UNION ALL SELECT query_id, id, rank FROM rd) GROUP BY query_id, id), {ranked_sql('fu', 10, 'rf')}
{RANKED} FROM rf""")
def hybrid_rrf_topk(spark, d):
    """Documents that have a vector, by words and by vectors; those with an id divisible by 100 are asked for."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    both = documents(spark, d).select("id", "text").join(v, "id")
    return out(HybridRetriever(both).search(both.where("id % 100 = 0").withColumnRenamed("id", "query_id"), 10))


@register(f"""WITH {PARTS}, f AS (SELECT sc.*, d.source FROM sc JOIN d USING (id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY round(score, 9) DESC, id::VARCHAR) AS rank FROM f WHERE score >= 5)
SELECT query_id, source, id, rank::INT AS rank, round(score, 6) AS score FROM r WHERE rank <= 3""")
def scoped_support_search(spark, d):
    docs = documents(spark, d)
    scored = bm25.scores(bm25.build(docs), items(spark, d)).join(docs.select("id", "source"), "id").where("score >= 5")
    scoped = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.round("score", 9).desc(), F.col("id").cast("string"))))
    return scoped.where("rank <= 3").select("query_id", "source", "id", "rank", F.round("score", 6).alias("score"))


@register("SELECT doc_id AS id, text, lang FROM documents UNION ALL SELECT item_id + 1000000000 AS id, text, 'bench' AS lang FROM benchmark")
def corpus_add(spark, d):
    new = items(spark, d).select((F.col("query_id") + 1000000000).alias("id"), "text", F.lit("bench").alias("lang"))
    return corpus.add(documents(spark, d).select("id", "text", "lang"), new)


@register("SELECT doc_id AS id, coalesce(b.text, d.text) AS text, lang FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id")
def corpus_update(spark, d):
    known = documents(spark, d).select("id", "text", "lang")
    return corpus.update(known, items(spark, d).select(F.col("query_id").alias("id"), "text").join(known.select("id"), "id", "left_semi"))


@register("SELECT doc_id AS id, text FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def corpus_delete(spark, d):
    return corpus.delete(documents(spark, d).select("id", "text"), items(spark, d).select(F.col("query_id").alias("id")))[0]
