"""Batches of training examples without repeated texts or labels inside a batch."""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges in which rows are put in order, and the rows drawn to bound them.
RANGES, DRAWN = 256, 16_384


def range_of(value: Column, bounds: list, kind: str) -> Column:
    """How many of the sorted bounds are not above the value, by halving; 0 for null."""
    known = F.array(*map(F.lit, bounds)).cast(f"array<{kind}>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, x: F.when(F.get(known, at + x - 1) <= value, at + x).otherwise(at)) if bounds else F.lit(0)


def plain_batches(examples: DataFrame, size: int, drop_last: bool = False) -> DataFrame:
    """Consecutive batches in order of ``ord``: a row's place is its range's offset and its place in the range.

    Bounds and counts are found once and become constants, so no later plan can deal the rows out in another way.
    """
    kind = dict(examples.dtypes)["ord"]
    drawn = [r.ord for r in examples.select("ord").where("ord IS NOT NULL").orderBy(F.rand(0)).limit(DRAWN).orderBy("ord").collect()]
    bounds = sorted({len(drawn) * k // RANGES for k in range(1, RANGES)}) if drawn else []
    parts = examples.withColumn("part", range_of(F.col("ord"), [drawn[k] for k in bounds], kind))
    sizes = {r.part: r.n for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row per range
    starts = F.array(*[F.lit(n).cast("long") for n in accumulate((sizes.get(k, 0) for k in range(len(bounds))), initial=0)])
    i = F.row_number().over(Window.partitionBy("part").orderBy("ord")) - 1
    out = parts.withColumn("n", F.get(starts, F.col("part")) + i)
    out = out.withColumn("batch", F.floor(F.col("n") / size).cast("long")).withColumn("position", (F.col("n") % size).cast("int")).drop("part", "n")
    if drop_last:
        full = out.groupBy("batch").count().where(F.col("count") == size).select("batch")
        out = out.join(full, "batch", "left_semi")
    return out


class Skips(dict):
    """Places that are taken, each with a later one to look at; paths are shortened as they are walked."""

    def next_free(self, place: int) -> int:
        walked = []
        while place in self:
            walked.append(place)
            place = self[place]
        for w in walked:
            self[w] = place
        return place

    def take(self, place: int) -> None:
        self[place] = place + 1


def greedy(keys: list[set], size: int, drop_last: bool = False) -> list[tuple[int, int]]:
    """(batch, position) per example: the earliest open batch that holds none of its keys; -1 where dropped.

    Each key knows the batches that hold it, and the full ones are known as well, as places to skip; so an example
    costs a few steps for each of its keys, however many others share them.
    """
    full, held, sizes, out = Skips(), {}, [], []
    for k in keys:
        skips = [full, *(held.setdefault(x, Skips()) for x in k)]
        b, before = 0, -1
        while b != before:
            before = b
            for s in skips:
                b = s.next_free(b)
        if b == len(sizes):
            sizes.append(0)
        out.append((b, sizes[b]))
        sizes[b] += 1
        for s in skips[1:]:
            s.take(b)
        if sizes[b] == size:
            full.take(b)
    if drop_last:
        stop = next((i for i, n in enumerate(sizes) if n < size), len(sizes))
        out = [(b, p) if b < stop else (-1, -1) for b, p in out]
    return out


def duplicate_free_batches(examples: DataFrame, size: int, by_label: bool = False, drop_last: bool = False, group: str | None = None) -> DataFrame:
    """Greedy batches in order of ``ord`` over (ord, query, positive[, label]); sequential within each ``group``.

    The rule is sequential by definition: one task per group. Give a shard column for tables beyond one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        texts = [{("t", q), ("t", p)} for q, p in zip(pdf["query"], pdf["positive"], strict=True)]
        if by_label:
            if pdf["label"].isna().any():
                raise ValueError("label-aware batches need labels everywhere")
            texts = [t | {("l", x)} for t, x in zip(texts, pdf["label"], strict=True)]
        placed = greedy(texts, size, drop_last)
        out = pd.DataFrame({"ord": pdf["ord"].to_numpy(), "batch": [b for b, _ in placed], "position": [p for _, p in placed]})
        out["shard"] = pdf["shard"].to_numpy()
        return out[out.batch >= 0]

    sharded = examples.withColumn("shard", F.col(group).cast("string") if group else F.lit(""))
    return sharded.groupBy("shard").applyInPandas(run, "ord long, batch long, position int, shard string")


def negative_counts(examples: DataFrame, most: int) -> DataFrame:
    """Hard negatives per example that each batch can use: the fewest any of its examples has, up to a limit."""
    return examples.groupBy("batch").agg(F.least(F.min(F.size("negatives")), F.lit(most)).alias("per_example"))
