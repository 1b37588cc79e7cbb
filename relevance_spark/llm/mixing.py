"""Mixing sources to target weights.

Tokens (words) are summed per source, target sizes follow from weights and a repetition limit, and every document is
emitted floor(rate) times plus one more copy with probability equal to the fraction; the draw is a hash of the seed
and doc_id, so that reruns agree. Repeated rows of one doc_id draw alike. Null texts have size 0, a null source is a
source of its own, last in order; a source of size 0 has target 0 and emits nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relevance_spark.llm.shared import Workspace, maybe_broadcast, text_or_empty, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2.0
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): one row a source.

    Resharing an excess by weight until no source is above its limit gives min(limit, weight * level) for one level.
    With sources in order of limit / weight, those up to some place stand at their limit; the level is the first for
    which the next source stays below. The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    n = len(weights)
    ranked = sizes.withColumn("k", (F.row_number().over(order) - 1) % n).withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("k") + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    before = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = ranked.withColumn("ratio", F.col("cap") / F.col("w")).withColumns({
        "total": F.sum("source_size").over(every) * F.lit(float(share)),
        "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "w_left": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
    })
    # The level if just the sources before this one stand at their limit; valid where this one stays at or below it.
    r = r.withColumn("here", (F.col("total") - F.col("cap_before")) / F.col("w_left"))
    r = r.withColumn("level", F.min(F.when(F.col("here") <= F.col("ratio"), F.struct("ratio", "here"))).over(every)["here"])
    return r.select("source", "source_size", F.least(F.col("cap"), F.col("w") * F.coalesce(F.col("level"), F.lit(float("inf")))).alias("target"))


def draw(seed: str = SEED):
    """A number in [0, 1) from doc_id: the first 32 bits of an MD5; null ids draw as an empty string."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(docs: DataFrame, spark=None, seed: str = SEED) -> DataFrame:
    """docs as struct ``row`` with size, source_size, target and copies: how often the mix takes each row."""
    ws = Workspace(docs.sparkSession, "mix")
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), word_count(text_or_empty()).alias("size"), F.col("source").alias("source"), draw(seed).alias("u"))
    totals = docs.select("source", word_count(text_or_empty()).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = ws.save(source_targets(ws.save(totals, "totals")), "targets")
    rates = targets.select(F.col("source").alias("of"), "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))
    joined = sized.join(maybe_broadcast(rates, targets.count(), 10_000), F.col("source").eqNullSafe(F.col("of")))
    n = F.floor("rate") + F.when(F.col("u") < F.col("rate") - F.floor("rate"), F.lit(1)).otherwise(F.lit(0))
    return joined.select("row", "size", "source_size", "target", n.cast("int").alias("copies"))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed documents: each row of docs as often as it is taken, with the columns of docs."""
    taken = copies(docs, seed=seed).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return copies(docs).select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / w AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS total,
      coalesce(sum(cap) OVER p, 0) AS cap_before, sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS w_left
      FROM k WINDOW p AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT (total - cap_before) / w_left AS level FROM r WHERE (total - cap_before) / w_left <= ratio ORDER BY ratio LIMIT 1),
t AS (SELECT source, source_size, least(cap, w * level) AS target FROM r, l),
j AS (SELECT d.doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
      ('0x' || substr(md5('mix-1:' || d.doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM j
"""
