"""Readers and writers of documents, examples, judgements and vectors."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Accepted names of the fields of an example, in order of preference.
ALIASES = {"query": ("query", "anchor", "question"), "positive": ("positive", "pos", "document"), "negatives": ("negatives", "neg", "hard_negatives")}


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("text"))


def read_documents(spark: SparkSession, path: str, text_field: str = "text", id_field: str = "id") -> DataFrame:
    """JSON lines to id, text and one column per other field; ids are on all rows or on none."""
    raw = spark.read.json(path)
    if text_field not in raw.columns:
        raise ValueError(f"no field {text_field!r}")
    if id_field not in raw.columns:
        return raw.withColumnRenamed(text_field, "text").withColumn("id", F.expr("uuid()"))
    missing = raw.where(F.col(id_field).isNull()).limit(1).count()
    if missing and not raw.where(F.col(id_field).isNotNull()).isEmpty():
        raise ValueError("some rows have an id and some have none")
    return raw.select(F.col(id_field).cast("string").alias("id"), F.col(text_field).alias("text"), *[c for c in raw.columns if c not in (id_field, text_field)])


def _example_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, at, place) of JSON lines, or of the objects of a file that is one JSON list; at and place order a file's rows."""
    columns = ["value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("place")]
    lines = spark.read.text(path).select(*columns)
    first = lines.where(F.trim("value") != "").select(F.ltrim("value").alias("v")).first()
    if first is None or not first.v.startswith("["):
        return lines
    whole = spark.read.text(path, wholetext=True).select(*columns[:3], F.posexplode_outer(F.expr("try_variant_get(try_parse_json(value), '$', 'array<variant>')")).alias("place", "object"))
    if bad := whole.where("place IS NULL AND trim(value) NOT RLIKE '^\\\\[\\\\s*\\\\]$'").select("file").first():
        raise ValueError(f"{bad.file}: not a JSON list")
    return whole.where("place IS NOT NULL").select(F.coalesce(F.to_json("object"), F.lit("null")).alias("value"), "file", "at", "place")


def _refuse(rows: DataFrame, bad: DataFrame, message: str) -> None:
    """Raise with the file and the line of the first bad row, if any; lines are counted only then, in that file."""
    found = bad.select("file").agg(F.min("file").alias("file")).first().file
    if found is None:
        return
    order = Window.partitionBy("file").orderBy("at", "place")
    numbered = rows.where(F.col("file") == found).select("file", "at", "place", F.row_number().over(order).alias("line"))
    one = numbered.join(bad.where(F.col("file") == found).select("at", "place"), ["at", "place"]).agg(F.min("line").alias("line")).first()
    raise ValueError(f"{found}:{one.line}: {message}")


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, or a JSON list, to query, positive, negatives, instruction, score, label; of several aliases the first present counts."""
    fields = {name: T.StringType() for names in ALIASES.values() for name in names} | {"instruction": T.StringType(), "score": T.DoubleType(), "label": T.StringType()}
    lines = _example_lines(spark, path)
    raw = lines.where(F.trim("value") != "").withColumn("j", F.expr("try_parse_json(value)"))
    _refuse(lines, raw.where("j IS NULL OR schema_of_variant(j) NOT LIKE 'OBJECT%'"), "not a JSON object")
    text = lambda n: F.get_json_object("value", f"$.{n}")
    pick = lambda key: reduce(lambda rest, n: F.when(F.expr(f"variant_get(j, '$.{n}') IS NOT NULL"), text(n)).otherwise(rest), reversed(ALIASES[key]), F.lit(None).cast("string"))
    neg = pick("negatives")
    listed = F.when(neg.isNull(), F.array().cast("array<string>")).when(neg.startswith("["), F.from_json(neg, "array<string>")).otherwise(F.array(neg))
    named = raw.withColumns({"query": pick("query"), "positive": pick("positive")})
    _refuse(lines, named.where("query IS NULL OR positive IS NULL"), "an example needs a query and a positive")
    return named.select("query", "positive", listed.alias("negatives"), *[text(c).cast(fields[c]).alias(c) for c in ("instruction", "score", "label")])


def write_examples(examples: DataFrame, path: str) -> None:
    """JSON lines without nulls and empty lists."""
    examples.withColumn("negatives", F.when(F.size("negatives") > 0, F.col("negatives"))).write.json(path)


def read_beir(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus(id, text), queries(query_id, text) that are judged, qrels(query_id, id, rel)."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    corpus = corpus.select(F.col("_id").alias("id"), F.when(F.trim(F.coalesce("title", F.lit(""))) != "", F.concat_ws("\n", "title", "text")).otherwise(F.col("text")).alias("text"))
    lines = spark.read.text(f"{folder}/qrels/{split}.tsv").where(F.trim("value") != "").select(F.split("value", "\t").alias("f"))
    qrels = lines.select(F.col("f")[0].alias("query_id"), F.col("f")[1].alias("id"), F.col("f")[2].alias("g"), F.expr("try_cast(f[2] AS double)").alias("rel"))
    odd = qrels.where("rel IS NULL").limit(3).collect()
    if len(odd) > 1 or odd and odd[0].g not in ("score", "rel", "relevance", "grade"):
        raise ValueError(f"a grade is not a number: {odd[0].g!r}")
    qrels = qrels.where("rel IS NOT NULL").drop("g")
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").select(F.col("_id").alias("query_id"), "text")
    return corpus, queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi"), qrels


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Strict judgements: a header, whole grades, no pair twice."""
    qrels = spark.read.option("sep", "\t").option("header", True).schema("query_id string, id string, rel int").option("mode", "FAILFAST").csv(path)
    if not qrels.groupBy("query_id", "id").count().where("count > 1").isEmpty():
        raise ValueError("a pair is judged twice")
    return qrels.withColumn("rel", F.col("rel").cast("double"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Compressed JSON lines {query_id, hits: [{id, score, stage?}]} to a ranked run."""
    raw = spark.read.schema("query_id string, hits array<struct<id:string, score:double, stage:string>>").json(path)
    if not raw.groupBy("query_id").count().where("count > 1").isEmpty():
        raise ValueError("a query is predicted twice")
    return raw.select("query_id", F.posexplode("hits").alias("pos", "h")).select("query_id", (F.col("pos") + 1).alias("rank"), "h.*")


def write_predictions(run: DataFrame, path: str) -> None:
    listed = run.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id"), "score"))).alias("h"))
    listed.select("query_id", F.transform("h", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("hits")).write.option("compression", "gzip").json(path)


def table_digest(df: DataFrame) -> str:
    """Digest of the rows in any order."""
    rows = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("h")).groupBy(F.substring("h", 1, 3).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    parts = [r.h for r in rows.orderBy("p").collect()]  # at most 4096
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
