"""Leakage-safe splits, audits of duplicates, deterministic samples and label pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relevance_spark.operators.batching import plain_batches
from relevance_spark.operators.graph import connected, shared_folder


#: Ranges of the hash that a label's groups are counted by: three hexadecimal digits.
PARTS = 16**3


def _brings_nearer(chosen, n, total, fraction: float, distance=abs):
    """Whether n more rows bring the chosen ones nearer to the share and leave something over; of columns or numbers."""
    return (distance(chosen + n - total * fraction) < distance(chosen - total * fraction)) & (chosen + n < total)


def grouped_split(rows: DataFrame, fraction: float, seed: str = "split") -> DataFrame:
    """(id, label, group) to (group, in_dev): whole groups, near the fraction of each label's rows.

    Groups with more than one label stay in train. Groups of a label are taken in order of a hash, each only if it
    brings the count nearer to its target and leaves something over. What is too large once is so for good, so in each
    round a label takes all that may still come up to the first range of the hash that passes the target, and goes
    through that range group by group. A round that does not end takes a group and leaves a label nearer.
    """
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, "split")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    fraction = float(fraction)
    label, group = dict(rows.dtypes)["label"], dict(rows.dtypes)["group"]
    found = rows.groupBy("group").agg(F.count_distinct("label").alias("labels"), F.min("label").alias("label"), F.count("*").alias("n"))
    found = found.withColumn("h", F.when(F.col("labels") == 1, F.sha2(F.concat_ws(":", F.lit(seed), "label", "group"), 256)))
    groups = kept(found.withColumn("part", F.conv(F.substring("h", 1, 3), 16, 10).cast("int")).drop("labels"), "groups")
    usable = groups.where("h IS NOT NULL")
    nearer = _brings_nearer(F.col("chosen"), F.col("n"), F.col("total"), fraction, F.abs)

    def through(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h")
        chosen, total, taken = int(pdf["chosen"].iloc[0]), int(pdf["total"].iloc[0]), []
        for n in pdf["n"].tolist():
            taken.append(_brings_nearer(chosen, n, total, fraction))
            chosen += n if taken[-1] else 0
        return pdf.loc[taken, ["label", "n", "group"]]

    state = [(r.label, r.total, 0, 0) for r in usable.groupBy("label").agg(F.sum("n").alias("total")).collect()]  # a row per label
    whole, single = [], None  # ranges of a label that are taken up to a size, and groups that are taken by themselves
    while state:
        at = F.broadcast(spark.createDataFrame(state, f"label {label}, total long, chosen long, start int"))
        near = usable.join(at, "label").where(F.col("part") >= F.col("start")).where(nearer)
        sums = near.groupBy("label", "total", "chosen", "part").agg(F.sum("n").alias("n"))
        after = F.col("chosen") + F.sum("n").over(Window.partitionBy("label").orderBy("part"))
        fits = (F.col("after") <= F.col("total") * fraction) & (F.col("after") < F.col("total"))
        ends = sums.withColumn("after", after).groupBy("label").agg(F.max(F.when(fits, F.col("after"))).alias("after"), F.min(F.when(~fits, F.col("part"))).alias("stop"))
        ends = {r.label: r for r in ends.collect()}
        whole += [(*s, PARTS if ends[s[0]].stop is None else ends[s[0]].stop) for s in state if s[0] in ends]
        state = [(s[0], s[1], ends[s[0]].after or s[2], ends[s[0]].stop) for s in state if s[0] in ends and ends[s[0]].stop is not None]
        if not state:
            break
        at = F.broadcast(spark.createDataFrame(state, f"label {label}, total long, chosen long, start int"))
        crossed = usable.join(at, "label").where(F.col("part") == F.col("start")).where(nearer).select("label", "total", "chosen", "n", "h", "group")
        taken = kept(crossed.groupBy("label").applyInPandas(through, f"label {label}, n long, group {group}"), f"taken{len(whole)}")
        single = taken if single is None else single.unionByName(taken)
        more = {r.label: r.n for r in taken.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        state = [(x, total, chosen + more.get(x, 0), stop + 1) for x, total, chosen, stop in state]
    marked = groups.withColumn("in_dev", F.lit(False))
    if whole:
        spans = F.broadcast(spark.createDataFrame(whole, f"label {label}, total long, chosen long, start int, stop int"))
        inside = usable.join(spans, "label").where(F.col("part").between(F.col("start"), F.col("stop") - 1)).where(nearer).select("group")
        chosen = (inside if single is None else inside.unionByName(single.select("group"))).withColumn("hit", F.lit(True))
        marked = groups.join(chosen, "group", "left").withColumn("in_dev", F.coalesce("hit", F.lit(False)))
    return marked.select("group", "in_dev")


def shuffled_split(examples: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """The first max(1, round(n * fraction)) examples (halves to even) in the order of a seeded hash of ``ord`` are dev.

    Nulls have no hash and come last. Places in that order come from counts per range, so no task and no driver holds
    all examples.
    """
    n = examples.count()
    cut = max(1, round(n * fraction)) if n else 0
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("ord").cast("string")), 256)
    placed = plain_batches(examples.withColumn("_ord", F.col("ord")).withColumn("ord", F.coalesce(drawn, F.lit("~"))), 1)  # after all digits
    return placed.withColumn("in_dev", F.col("batch") < cut).withColumn("ord", F.col("_ord")).drop("_ord", "batch", "position")


def duplicate_audit(rows: DataFrame) -> DataFrame:
    """(fingerprint, split, label) to one row per fingerprint that occurs more than once."""
    found = rows.groupBy("fingerprint").agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits"), F.count_distinct(F.coalesce("label", F.lit(""))).alias("labels"))
    return found.where("n > 1").withColumn("cross_split", F.col("splits") > 1).withColumn("conflicting", F.col("labels") > 1)


def round_robin(rows: DataFrame, n: int) -> DataFrame:
    """n rows, one per label in turn, in order of a hash of the id."""
    turn = Window.partitionBy("label").orderBy(F.sha2(F.col("id").cast("string"), 256))
    return rows.withColumn("turn", F.row_number().over(turn)).orderBy("turn", "label").limit(n)


def hash_sample(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.sha2(F.col("id").cast("string"), 256), F.col("id").cast("string")).limit(n)


def cyclic_pairs(rows: DataFrame) -> DataFrame:
    """Each row of a label with the next one of another text, the last with the first."""
    w = Window.partitionBy("label").orderBy("id")
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    every = Window.partitionBy("label").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = F.coalesce(F.first("id").over(ahead), F.first("id").over(every))
    return rows.withColumn("pair", nxt).where("pair <> id")


def evidence_components(rows: DataFrame) -> DataFrame:
    """(id, fingerprint, positives) to (id, component): the smallest id that shared fingerprints or positive documents lead to.

    ``id`` is a long, ``positives`` an array of strings. Every piece of evidence links its rows with the smallest id
    among them, and labels are passed on until nothing changes.
    """
    keys = F.concat(F.array(F.concat(F.lit("text:"), "fingerprint")), F.transform(F.coalesce("positives", F.array().cast("array<string>")), lambda p: F.concat(F.lit("doc:"), p)))
    keyed = rows.select("id", F.explode(keys).alias("key")).where("key IS NOT NULL").distinct()
    shared = keyed.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    found = connected(keyed.join(shared, "key").select("a", F.col("id").alias("b")))
    return rows.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))
