"""Hand-computed and brute-force cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from relevance_spark.operators import agents, batching, bm25, chunking, corpus, dense, encoders, evaluation, losses, ranking, splitting
from relevance_spark.sources import readers, snapshots


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("a", "apple apple pear"), ("b", "pear"), ("c", "")], "id string, text string")
    q = spark.createDataFrame([(1, "APPLE apple"), (2, "unknown"), (3, "")], "query_id long, text string")
    index = bm25.build(docs)
    want = math.log(1 + 2.5 / 1.5) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / (4 / 3)))
    for allowed in (None, docs.where("id = 'a'")):
        rows = bm25.search(index, q, 5, allowed=allowed).collect()
        assert [(r.query_id, r.id) for r in rows] == [(1, "a")] and rows[0].score == pytest.approx(want)
    with pytest.raises(ValueError):
        bm25.scores(index, q, k1=0)


def test_fusion_by_hand(spark):
    a = spark.createDataFrame([(1, "l", 1)], "query_id long, id string, rank int")
    b = spark.createDataFrame([(1, "s", 1), (1, "m", 2), (1, "l", 3)], "query_id long, id string, rank int")
    rows = ranking.reciprocal_rank_fusion([a, b], 3, 10).orderBy("rank").collect()
    assert [r.id for r in rows] == ["l", "s", "m"] and rows[0].score == pytest.approx(1 / 11 + 1 / 13)


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_dense_brute_force(spark, metric):
    rng = np.random.default_rng(5)
    v, q = rng.standard_normal((60, 8)).round(1), rng.standard_normal((4, 8))
    v[10] = 0
    v[11] = v[12]
    corpus_df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<float>")
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, vec array<float>")
    f = lambda m: m.astype(np.float32).astype(float)
    s = f(q) @ f(v).T
    if metric == "cosine":
        s /= np.maximum(np.linalg.norm(f(q), axis=1)[:, None], 1e-12) * np.maximum(np.linalg.norm(f(v), axis=1)[None], 1e-12)
    got = {(r.query_id, r["rank"]): r.id for r in dense.search(queries, corpus_df, 7, metric).collect()}
    for i in range(4):
        order = sorted(range(60), key=lambda j: (-round(s[i, j], 9), str(j)))
        assert [got[i, k + 1] for k in range(7)] == order[:7]
    assert dense.search(queries, corpus_df, 100).count() == 240


def test_approximate_recall(spark, data):
    """The registered search itself, filter and all, against the exact top ten."""
    from relevance_spark.plans import dense as plans

    r = plans.ann_recall_vs_exact(spark, data).agg(F.avg("recall"), F.avg("filtered_recall")).first()
    exact = dense.search(plans.searched(spark, data), plans.vectors(spark, data).where("label < 5"), 10)
    hits = plans.ann_overfetch_postfilter(spark, data).join(exact, ["query_id", "id"], "left_semi").count()
    assert min(*r, hits / exact.count()) >= 0.9 and dense.OVERFETCH == 10


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate("abcde")], "query_id long, id string, rank int")
    rel = spark.createDataFrame([(1, x, 1.0) for x in "bdz"] + [(2, "q", 1.0), (3, "q", 0.0)], "query_id long, id string, rel double")
    at = lambda k: {r.query_id: r for r in evaluation.per_query(run, rel, k).collect()}
    assert at(2)[1].recall == pytest.approx(1 / 3) and at(4)[1].precision == pytest.approx(0.5)
    assert at(5)[1].mrr == pytest.approx(0.5) and at(5)[1].map == pytest.approx(1 / 3)
    assert at(5)[2].recall == 0 and 3 not in at(5)


def test_correlations(spark):
    same = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert evaluation.pearson(same, "x", "y").first().value == 0
    ties = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (2.0, 3.0), (4.0, 4.0)], "x double, y double")
    assert evaluation.spearman(ties, "x", "y").first().value == pytest.approx(0.9486833)


def test_greedy_batches():
    rng = np.random.default_rng(1)
    for size in (2, 3, 7):
        keys = [{("t", int(a)), ("t", int(b) + 50)} for a, b in rng.integers(0, 12, (100, 2))]
        want, batches = [], []
        for k in keys:
            b = next((i for i, (n, h) in enumerate(batches) if n < size and not h & k), len(batches))
            if b == len(batches):
                batches.append((0, set()))
            n, h = batches[b]
            want.append((b, n))
            batches[b] = (n + 1, h | k)
        assert batching.greedy(keys, size) == want


def test_chunks():
    assert chunking.chunks("") == [] and [len(x) for x in chunking.chunks("x" * 450, 200, 0)] == [200, 200, 50]
    text = "One two. Three four five.\n\nSix seven eight nine ten. " * 20
    cut = chunking.chunks(text, 100, 20)
    assert all(len(c) <= 100 for c in cut) and set(text.split()) <= set(" ".join(cut).split())


def test_router_by_hand(spark):
    r = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0])], "route string, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vec array<double>")
    for how, want in (("max", 1.0), ("mean", 0.5), ("centroid", 1 / math.sqrt(2))):
        assert agents.route_scores(q, r, how).first().score == pytest.approx(want)


def test_losses_by_hand(spark):
    good = spark.createDataFrame([(0, 1.0, 1.0), (0, 0.0, 0.0)], "batch long, score double, cosine double")
    bad = spark.createDataFrame([(0, 1.0, 0.0), (0, 0.0, 1.0)], "batch long, score double, cosine double")
    assert losses.cosent(good).first().loss < 1e-6 and losses.cosent(bad).first().loss == pytest.approx(math.log1p(math.exp(20)))
    with pytest.raises(ValueError):
        losses.build_loss("none")


def test_rejection_sweep(spark):
    rows = [(0.9, True, True), (0.8, True, True), (0.5, False, True), (0.4, True, True), (0.7, False, False), (0.3, False, False), (None, False, False)]
    df = spark.createDataFrame(rows, "score double, correct boolean, in_scope boolean")
    r = evaluation.sweep(df, 0.0).first()
    assert (r.threshold, r.above, r.coverage) == (0.7, True, 0.5)
    r = evaluation.sweep(df, 1 / 3).first()
    assert r.coverage == 1.0 and r.false_acceptance == pytest.approx(1 / 3)


def test_split_ignores_order(spark):
    rows = [(i, "xy"[i % 2], f"g{i // 4}{i % 2}") for i in range(16)]
    a = splitting.grouped_split(spark.createDataFrame(rows, "id long, label string, group string"), 0.25)
    b = splitting.grouped_split(spark.createDataFrame(rows[::-1], "id long, label string, group string"), 0.25)
    assert sorted(a.collect()) == sorted(b.collect()) and a.where("in_dev").count() == 2


def test_evidence_components(spark):
    """A chain of forty rows through positives, two rows of one text, rows without positives or text."""
    rows = [(i, f"t{i}", [f"p{i}", f"p{i + 1}"]) for i in range(10, 50)] + [(7, "t49", None), (3, "t30", []), (1, "p10", ["q"]), (2, None, None), (4, None, ["q", None])]
    df = spark.createDataFrame(rows, "id long, fingerprint string, positives array<string>")
    got = {r.id: r.component for r in splitting.evidence_components(df).collect()}
    assert got == dict.fromkeys([3, 7, *range(10, 50)], 3) | {1: 1, 4: 1, 2: 2}


def test_corpus_changes(spark):
    c = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    with pytest.raises(ValueError):
        corpus.add(c, c)
    assert corpus.add(c, spark.createDataFrame([("c", "z")], c.schema)).count() == 3
    left, gone = corpus.delete(c, spark.createDataFrame([("b",), ("q",)], "id string"))
    assert gone == 1 and left.count() == 1


def test_hashing_encoder_and_snapshot(spark, tmp_path):
    e = encoders.HashingEncoder(native_dim=32)
    docs = spark.createDataFrame([("a", "hello world"), ("b", "")], "id string, text string").withColumn("vec", e.vectors(F.col("text")))
    rows = {r.id: np.array(r.vec) for r in docs.collect()}
    assert np.linalg.norm(rows["a"]) == pytest.approx(1, abs=1e-6) and not rows["b"].any()
    path = f"file://{tmp_path}/snap"
    snapshots.save(docs, path, e.fingerprint(), 32)
    assert snapshots.load(spark, path, e.fingerprint())[0].count() == 2
    with pytest.raises(ValueError):
        snapshots.load(spark, path, "other")
    with pytest.raises(FileExistsError):
        snapshots.save(docs, path, e.fingerprint(), 32)


def test_readers(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"anchor": "q", "pos": "p", "neg": "n"}\n\n{"query": "q2", "positive": "p2", "negatives": ["a", "b"], "score": 0.5}\n')
    rows = sorted(readers.read_examples(spark, str(tmp_path / "e.jsonl")).collect(), key=lambda r: r.query)
    assert [(r.query, r.positive, r.negatives, r.score) for r in rows] == [("q", "p", ["n"], None), ("q2", "p2", ["a", "b"], 0.5)]
    beir = tmp_path / "beir"
    (beir / "qrels").mkdir(parents=True)
    (beir / "corpus.jsonl").write_text('{"_id": "1", "title": "T", "text": "x"}\n')
    (beir / "queries.jsonl").write_text('{"_id": "q", "text": "t"}\n{"_id": "r", "text": "u"}\n')
    (beir / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq\t1\t1\n")
    c, q, r = readers.read_beir(spark, str(beir))
    assert c.first().text == "T\nx" and q.count() == 1 and r.first().rel == 1.0
