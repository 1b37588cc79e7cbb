"""Places in a global order, where Spark deals rows out in other ways from one plan to the next."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from relevance_spark.operators import batching, splitting
from relevance_spark.plans import catalog


@pytest.fixture
def small_partitions(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def against_sql(spark, name, folder):
    """Sorted rows of a query and of its SQL over the documents in a folder."""
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, str(folder)).select(*[f"`{c}`" for c in want.columns])
    return sorted(map(tuple, got.collect()), key=str), sorted(want.fetchall(), key=str)


def test_places_of_many_wide_rows(spark, small_partitions):
    """Counts leave the wide column out, so that Spark joins their ranges otherwise than those of the rows."""
    wide = spark.range(60_000).select(F.col("id").alias("ord"), F.concat(*[F.sha2(F.concat("id", F.lit(f":{k}")), 512) for k in range(3)]).alias("text"))
    rows = batching.plain_batches(wide.orderBy(F.rand(1)), 7).select("ord", "batch", "position", F.length("text").alias("n")).collect()
    assert sorted(r.batch * 7 + r.position for r in rows) == list(range(60_000))
    assert all(r.batch * 7 + r.position == r.ord and r.n == 384 for r in rows)


def test_places_of_few_rows(spark):
    kind = "ord string, x int"
    assert batching.plain_batches(spark.createDataFrame([], kind), 2).count() == 0
    rows = batching.plain_batches(spark.createDataFrame([("b", 1), (None, 0), ("a", 2), ("b", 1)], kind), 3).collect()
    assert sorted((r.batch, r.position, r.ord or "") for r in rows) == [(0, 0, ""), (0, 1, "a"), (0, 2, "b"), (1, 0, "b")]


def test_range_of(spark):
    for n in range(6):
        bounds = [10 * k for k in range(1, n + 1)]
        rows = spark.range(70).select("id", batching.range_of(F.col("id"), bounds, "bigint").alias("r")).collect()
        assert all(r.r == sum(b <= r.id for b in bounds) for r in rows)


def test_evaluator_of_many_texts_and_null_ones(spark, small_partitions, tmp_path):
    texts = spark.range(30_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 1000 != 7, F.concat(*[F.sha2(F.concat((F.col("id") % 25_000).cast("string"), F.lit(f":{k}")), 512) for k in range(3)])).alias("text"),
        F.concat(F.lit("l"), F.col("id") % 3).alias("lang"),
    )
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    got, want = against_sql(spark, "evaluator_from_examples", tmp_path)
    assert got == want and len(want) > 24_000


def test_shuffled_split_of_many_examples(spark, small_partitions):
    n = 400_000
    order = sorted(range(n), key=lambda i: hashlib.sha256(f"42:{i}".encode()).hexdigest())
    rows = splitting.shuffled_split(spark.range(n).withColumnRenamed("id", "ord"), 0.1).collect()
    assert len(rows) == n and {r.ord for r in rows} == set(range(n))
    assert {r.ord for r in rows if r.in_dev} == set(order[: n // 10])


@pytest.mark.parametrize("ids", [[None] * 300 + [1, 2, 3], [None] * 30, [5, 5, 5, None, *range(31)]])
def test_split_examples_of_null_and_repeated_ids(spark, tmp_path, ids):
    spark.createDataFrame([(i,) for i in ids], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = against_sql(spark, "split_examples", tmp_path)
    assert got == want and len(want) == len(ids)


def split_by_hand(groups, fraction):
    """groups: {(label, group): rows}; the groups that are taken, one after the other."""
    taken = set()
    for label in {x for x, _ in groups}:
        own = sorted((hashlib.sha256(f"split:{label}:{g}".encode()).hexdigest(), g, n) for (x, g), n in groups.items() if x == label)
        total, chosen = sum(n for *_, n in own), 0
        for _, g, n in own:
            if chosen + n < total and abs(chosen + n - total * fraction) < abs(chosen - total * fraction):
                taken.add(g)
                chosen += n
    return taken


def test_grouped_split_of_groups_of_all_sizes(spark):
    draw = random.Random(5)
    groups = {(f"l{k}", f"g{k}-{i}"): draw.choice([1, 1, 2, 3, 5, 40, 200]) for k in range(30) for i in range(draw.choice([1, 2, 9, 60]))}
    groups |= {("big", f"b{i}"): 1 + 400 * (i == 7) for i in range(300)}
    rows = spark.createDataFrame([(x, g, n) for (x, g), n in groups.items()], "label string, group string, n int")
    each = rows.selectExpr("label", "group", "explode(sequence(1, n)) AS id").unionByName(spark.createDataFrame([("l0", "both", 1), ("l1", "both", 2), (None, "none", 3)], "label string, group string, id int"))
    for fraction in (0.2, 0.5, 1.0):
        got = splitting.grouped_split(each, fraction).collect()
        assert sorted(r.group for r in got) == sorted([g for _, g in groups] + ["both", "none"])
        assert {r.group for r in got if r.in_dev} == split_by_hand(groups, fraction)


def test_grouped_split_of_many_groups_is_fast(spark):
    began = time.time()
    rows = spark.range(130_000).select("id", F.lit("x").alias("label"), F.concat(F.lit("g"), F.col("id") % 120_000).alias("group"))
    got = {r.group for r in splitting.grouped_split(rows, 0.2).collect() if r.in_dev}
    assert time.time() - began < 60
    assert got == split_by_hand({("x", f"g{i}"): 1 + (i < 10_000) for i in range(120_000)}, 0.2)
