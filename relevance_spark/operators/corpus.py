"""Corpora as immutable tables: add, update, delete, validate, encode what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add(corpus: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; repeated or taken ids raise, and nothing is added."""
    if not new.groupBy("id").count().where("count > 1 OR id IS NULL").isEmpty():
        raise ValueError("ids of new rows must be distinct and not null")
    if not new.join(corpus, "id", "left_semi").isEmpty():
        raise ValueError("an id is already there")
    return corpus.unionByName(new)


def update(corpus: DataFrame, changed: DataFrame) -> DataFrame:
    """New texts for known ids; other columns stay. An unknown or repeated id raises, and nothing changes."""
    if not changed.join(corpus, "id", "left_anti").isEmpty():
        raise ValueError("an id is not there")
    if not changed.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("an id is changed twice")
    renamed = changed.select("id", F.col("text").alias("_new"), F.lit(True).alias("_hit"))
    return corpus.join(renamed, "id", "left").withColumn("text", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("text"))).select(*corpus.columns)


def delete(corpus: DataFrame, ids: DataFrame) -> tuple[DataFrame, int]:
    """What is left, and how many of the ids were there; unknown ids are ignored."""
    return corpus.join(ids.select("id").distinct(), "id", "left_anti"), corpus.join(ids.select("id").distinct(), "id", "left_semi").count()


def reencode(corpus: DataFrame, encoded: DataFrame, encode) -> DataFrame:
    """(id, text) with vectors of (id, digest, vec): only new or changed texts are encoded."""
    keyed = corpus.withColumn("digest", F.sha2("text", 256))
    old = keyed.join(encoded.select("id", "digest", "vec"), ["id", "digest"])
    fresh = encode(keyed.join(encoded.select("id", "digest"), ["id", "digest"], "left_anti"))
    return old.unionByName(fresh.select(*old.columns))


def same_ids(a: DataFrame, b: DataFrame) -> bool:
    both = a.select("id", F.lit(1).alias("a")).join(b.select("id", F.lit(1).alias("b")), "id", "full_outer")
    return both.where("a IS NULL OR b IS NULL").isEmpty()
