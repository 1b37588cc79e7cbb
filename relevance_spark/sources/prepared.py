"""Prepared evaluation data: checked bundles, frozen files with digests, a sealed test split, and source formats.

A bundle is corpus(id, text), queries(split, id, text, label) and qrels(split, query_id, id, rel), as tables.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevance_spark.sources.readers import canonical_json, table_digest

SPLITS = ("train", "dev", "test")


@dataclass
class Bundle:
    corpus: DataFrame
    queries: DataFrame
    qrels: DataFrame


def _none(df: DataFrame, message: str) -> None:
    bad = df.limit(3).collect()
    if bad:
        raise ValueError(f"{message}: {[tuple(r) for r in bad]}")


def _repeated(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def validate_bundle(bundle: Bundle) -> None:
    """Ids are unique, in and across splits; every judgement is of a known query and document, finite and not negative.

    A query without judgements has a row of qrels with a null id, so that a forgotten one is told from one without positives.
    """
    _none(_repeated(bundle.corpus, "id"), "repeated documents")
    _none(bundle.corpus.where("id IS NULL OR id = '' OR text IS NULL").select("id"), "documents without id or text")
    _none(_repeated(bundle.queries, "id"), "repeated queries in or across splits")
    asked, judged = bundle.queries.select("split", F.col("id").alias("query_id")), bundle.qrels
    _none(asked.join(judged, ["split", "query_id"], "left_anti"), "queries that qrels do not cover")
    _none(judged.select("split", "query_id").join(asked, ["split", "query_id"], "left_anti"), "judgements of unknown queries")
    given = judged.where("id IS NOT NULL")
    _none(_repeated(given, "query_id", "id"), "pairs that are judged twice")
    _none(given.join(bundle.corpus.select("id"), "id", "left_anti").select("query_id", "id"), "judgements of unknown documents")
    grade = F.col("rel")
    _none(given.where(grade.isNull() | F.isnan(grade.cast("double")) | (F.abs(grade) == float("inf")) | (grade < 0)).select("query_id", "id"), "grades that are no finite number from 0")


def validate_predictions(queries: DataFrame, run: DataFrame, corpus: DataFrame) -> None:
    """run(query_id, id, score): every query once or more, no unknown query or document, none twice, finite scores.

    A query without hits has one row with a null id.
    """
    _none(_repeated(queries, "id"), "repeated queries")
    _none(queries.join(run, F.col("query_id") == queries["id"], "left_anti").select("id"), "queries without a prediction")
    _none(run.join(queries.select(F.col("id").alias("query_id")), "query_id", "left_anti").select("query_id"), "predictions of unknown queries")
    hits = run.where("id IS NOT NULL")
    _none(_repeated(hits, "query_id", "id"), "documents that are predicted twice")
    _none(hits.join(corpus.select("id"), "id", "left_anti").select("query_id", "id"), "unknown documents")
    _none(hits.where(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))).select("query_id", "id"), "scores that are not finite")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def manifest_of(bundle: Bundle) -> dict:
    """Rows and a digest of the rows, in any order, per table and split."""
    tables = {"corpus": bundle.corpus}
    for split in SPLITS:
        tables[f"queries/{split}"] = bundle.queries.where(F.col("split") == split)
        tables[f"qrels/{split}"] = bundle.qrels.where(F.col("split") == split)
    return {name: {"rows": df.count(), "digest": table_digest(df)} for name, df in tables.items()}


def write_prepared(bundle: Bundle, path: str, notes: dict | None = None) -> dict:
    """Freeze a checked bundle; the same one may be written again, another one is refused."""
    validate_bundle(bundle)
    spark, manifest = bundle.corpus.sparkSession, {"files": manifest_of(bundle), "notes": notes or {}}
    store, target = _fs(spark, path)
    if store.exists(target):
        if read_manifest(spark, path) != manifest:
            raise ValueError(f"{path} is frozen with other contents")
        return manifest
    stage = f"{path.rstrip('/')}.stage-{hashlib.sha256(canonical_json(manifest).encode()).hexdigest()[:12]}"
    bundle.corpus.write.mode("overwrite").json(f"{stage}/corpus")
    for split in SPLITS:
        for name, df in (("queries", bundle.queries), ("qrels", bundle.qrels)):
            df.where(F.col("split") == split).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{stage}/{name}/{split}")
    schemas = {"corpus": bundle.corpus.schema.json(), "queries": bundle.queries.schema.json(), "qrels": bundle.qrels.schema.json()}
    spark.createDataFrame([(canonical_json(manifest), canonical_json(schemas))], "manifest string, schemas string").coalesce(1).write.mode("overwrite").json(f"{stage}/manifest")
    if not store.rename(_fs(spark, stage)[1], target):
        raise OSError(f"could not publish {path}")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    import json

    return json.loads(spark.read.json(f"{path}/manifest").first().manifest)


def load_prepared(spark: SparkSession, path: str, split: str = "dev", allow_test: bool = False) -> Bundle:
    """One split, checked against its digests. The test split is sealed until it is asked for by name and switch."""
    import json

    from pyspark.sql.types import StructType

    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    if split == "test" and not allow_test:
        raise PermissionError("the test split is sealed: freeze the protocol, then pass allow_test=True")
    manifest = read_manifest(spark, path)["files"]
    schemas = json.loads(spark.read.json(f"{path}/manifest").first().schemas)

    def table(kind: str, name: str) -> DataFrame:
        df = spark.read.schema(StructType.fromJson(json.loads(schemas[kind]))).json(f"{path}/{name}")
        if table_digest(df) != manifest[name]["digest"] or df.count() != manifest[name]["rows"]:
            raise ValueError(f"{name} is not what was frozen")
        return df

    found = Bundle(table("corpus", "corpus"), table("queries", f"queries/{split}"), table("qrels", f"qrels/{split}"))
    validate_bundle(found)
    return found


def from_intents(train: DataFrame, test: DataFrame, dev_fraction: float = 0.1, out_of_scope: str | None = None) -> Bundle:
    """Labelled texts (text, label) to a bundle: train texts are the corpus, positives are texts of the same label.

    Development queries are a grouped, label-stratified share of train (and leave the corpus); out_of_scope is a label
    whose queries have no positives.
    """
    from relevance_spark.functions.text import token_digest
    from relevance_spark.operators.splitting import grouped_split

    rows = train.select("text", "label", F.substring(F.sha2(F.concat_ws("\n", "label", "text"), 256), 1, 16).alias("id")).dropDuplicates(["id"]).withColumn("group", token_digest(F.col("text")))
    chosen = grouped_split(rows.select("id", "label", "group"), dev_fraction)
    split = rows.join(chosen, "group")
    corpus = split.where("NOT in_dev" + (f" AND label <> '{out_of_scope}'" if out_of_scope else "")).select(F.concat(F.lit("d-"), "id").alias("id"), "text", "label")
    asked = lambda df, name: df.select(F.lit(name).alias("split"), F.concat(F.lit(f"{name}-"), "id").alias("id"), "text", "label")
    held = test.select("text", "label", F.substring(F.sha2(F.concat_ws("\n", "label", "text"), 256), 1, 16).alias("id")).dropDuplicates(["id"])
    queries = asked(split.where("in_dev"), "dev").unionByName(asked(held, "test"))
    qrels = queries.join(corpus.select(F.col("id").alias("doc"), "label"), "label", "left").select("split", F.col("id").alias("query_id"), F.col("doc").alias("id"), F.when(F.col("doc").isNotNull(), 1.0).alias("rel"))
    return Bundle(corpus.select("id", "text"), queries, qrels)


def read_banking77(spark: SparkSession, folder: str, dev_fraction: float = 0.1) -> Bundle:
    """train.csv and test.csv with text and category."""
    read = lambda name: spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{folder}/{name}.csv").select("text", F.col("category").alias("label"))
    return from_intents(read("train"), read("test"), dev_fraction)


def read_clinc150(spark: SparkSession, path: str, dev_fraction: float = 0.1) -> Bundle:
    """One JSON object of splits, each a list of [text, intent]; oos_* splits are out of scope."""
    whole = spark.read.option("multiLine", True).schema("train array<array<string>>, test array<array<string>>, oos_test array<array<string>>, oos_train array<array<string>>").json(path)
    rows = lambda name: whole.select(F.explode(name).alias("r")).select(F.col("r")[0].alias("text"), F.col("r")[1].alias("label"))
    return from_intents(rows("train"), rows("test").unionByName(rows("oos_test")), dev_fraction, "oos")


def read_scifact(spark: SparkSession, folder: str) -> Bundle:
    """A judged-retrieval folder; title and abstract are joined by a space, documents without either drop out."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    texts = corpus.select(F.col("_id").alias("id"), F.trim(F.concat_ws(" ", F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim("text"), F.lit("")))).alias("text")).where("text <> ''")
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").select(F.col("_id").alias("query_id"), "text")
    judged = None
    for split, name in (("train", "train"), ("test", "test")):
        part = spark.read.option("sep", "\t").option("header", True).schema("query_id string, id string, rel double").csv(f"{folder}/qrels/{name}.tsv").withColumn("split", F.lit(split))
        judged = part if judged is None else judged.unionByName(part)
    # Whole query ids of train are the development part, by hash.
    dev = (F.col("split") == "train") & (F.pmod(F.xxhash64("query_id"), F.lit(10)) == 0)
    judged = judged.withColumn("split", F.when(dev, "dev").otherwise(F.col("split"))).join(texts.select("id"), "id", "left_semi")
    asked = queries.join(judged.select("split", "query_id").distinct(), "query_id").select("split", F.col("query_id").alias("id"), "text", F.lit(None).cast("string").alias("label"))
    return Bundle(texts, asked, judged.select("split", "query_id", "id", "rel"))
