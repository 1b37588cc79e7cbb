"""Command line: encode, index, search, mine and evaluate tables with spark-submit."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from relevance_spark.operators import dense, evaluation, mining
from relevance_spark.operators.chunking import chunk_documents
from relevance_spark.operators.encoders import ENCODERS, HashingEncoder
from relevance_spark.operators.retrieval import Retriever
from relevance_spark.session import local_session, ship_package
from relevance_spark.sources import readers, snapshots


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, options in {"info": [], "encode": ["input", "output"], "index": ["input", "output"], "search": ["index", "query"], "mine": ["input", "output"], "eval": ["folder"]}.items():
        p = commands.add_parser(name)
        for o in options:
            p.add_argument(o)
        p.add_argument("--dim", type=int, default=256)
        p.add_argument("--k", type=int, default=5)
        p.add_argument("--chunk", type=int, default=0)
    a = parser.parse_args(argv)
    spark = ship_package(local_session())
    encoder = HashingEncoder(native_dim=a.dim)
    if a.command == "info":
        print("encoders:", ", ".join(sorted(ENCODERS.items)))
    elif a.command == "encode":
        texts = readers.read_texts(spark, a.input)
        texts.select("text", F.transform(encoder.vectors(F.col("text")), lambda x: F.round(x.cast("double"), 6)).alias("embedding")).write.json(a.output)
    elif a.command == "index":
        docs = readers.read_documents(spark, a.input)
        docs = chunk_documents(docs, a.chunk) if a.chunk else docs
        snapshots.save(docs.withColumn("vec", encoder.vectors(F.col("text"))), a.output, encoder.fingerprint(), a.dim)
    elif a.command == "search":
        corpus, _ = snapshots.load(spark, a.index, encoder.fingerprint())
        hits = Retriever(corpus, encoder).search(spark.createDataFrame([("q", a.query)], "query_id string, text string"), a.k)
        for r in hits.orderBy("rank").collect():
            print(f"{r.rank}. {r.score:.4f} {r.id} {r.text[:160]}".replace("\n", " "))
    elif a.command == "mine":
        ex = readers.read_examples(spark, a.input).withColumn("query_id", F.monotonically_increasing_id()).cache()
        corpus = mining.distinct_first(ex.select(F.col("positive").alias("text"), F.col("query_id").alias("ord"))).withColumn("id", F.col("ord")).withColumn("vec", encoder.vectors(F.col("text")))
        rows = ex.join(corpus.select(F.col("text").alias("positive"), F.col("id").alias("pid"), F.col("vec").alias("pv")), "positive").withColumn("vec", encoder.vectors(F.col("query"), "query"))
        rows = rows.select("query_id", "query", F.col("positive").alias("text"), "vec", F.col("pid").alias("positive"), dense.V.dot(F.col("vec"), F.col("pv")).alias("positive_score"))
        mined = mining.hard_negatives(rows, corpus, a.k).join(corpus.select("id", "text"), "id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("position", "text"))).alias("n"))
        rows.select("query_id", "query", F.col("text").alias("positive")).join(mined, "query_id", "left").select("query", "positive", F.transform("n", lambda x: x["text"]).alias("negatives")).write.json(a.output)
    else:
        corpus, queries, qrels = readers.read_beir(spark, a.folder)
        run = dense.search(queries.select("query_id", encoder.vectors(F.col("text"), "query").alias("vec")), corpus.select("id", encoder.vectors(F.col("text")).alias("vec")), 10)
        evaluation.evaluate(run, qrels, [1, 5, 10]).show(100)


if __name__ == "__main__":
    main()
