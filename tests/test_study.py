"""Runs over a prepared split, thresholds bound to them, and the report that checks them."""

import pytest
from pyspark.sql import functions as F

from relevance_spark.operators import study
from relevance_spark.operators.encoders import HashingEncoder
from relevance_spark.operators.rerankers import EncoderReranker
from relevance_spark.sources import prepared

E = HashingEncoder(native_dim=64)
P = study.Protocol(k=3, cutoffs=(1, 3), depth=3, rerank_depth=2, false_acceptance=0.5, latency_queries=1)


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('study')}/p"
    corpus = [("d1", "lost card"), ("d2", "card arrival"), ("d3", "exchange rate"), ("d4", "top up limit")]
    asked = {"d1": "my card is lost", "d2": "arrival of the card", "d3": "rate of exchange", None: "weather in spring"}
    queries = [(s, f"{s}{i}", t) for s in ("dev", "test") for i, t in enumerate(asked.values())]
    judged = [(s, f"{s}{i}", d, 1.0 if d else None) for s in ("dev", "test") for i, d in enumerate(asked)]
    bundle = prepared.Bundle(spark.createDataFrame(corpus, "id string, text string"), spark.createDataFrame(queries, "split string, id string, text string"), spark.createDataFrame(judged, "split string, query_id string, id string, rel double"))
    prepared.write_prepared(bundle, path)
    return path, bundle


def test_study_and_report(spark, data, tmp_path):
    path, bundle = data
    runs = {m: f"file://{tmp_path}/{m}" for m in ("bm25", "dense", "hybrid", "rerank")}
    options = {"bm25": {}, "dense": {"encoder": E}, "hybrid": {"encoder": E}, "rerank": {"encoder": E, "reranker": EncoderReranker(E)}}
    found = {m: study.run_method(spark, path, "dev", m, P, runs[m], **options[m]) for m in runs}
    # Each lexical query shares two words with its own document and at most one with another.
    assert found["bm25"]["metrics"]["recall@1"] == 1.0 and found["bm25"]["queries"] == 4 and found["bm25"]["rankable"] == 3
    assert found["bm25"]["rejection"]["coverage"] == 1.0 and found["bm25"]["rejection"]["false_acceptance"] == 0.0
    # The reranker is the encoder of the first stage, so nothing moves.
    assert found["rerank"]["metrics"] == found["rerank"]["first_metrics"] == found["dense"]["metrics"] and found["dense"]["timing"]["latency"]["sample"] == 1
    with pytest.raises(FileExistsError):
        study.run_method(spark, path, "dev", "bm25", P, runs["bm25"])
    overlap = spark.createDataFrame([("dev0",)], "query_id string")
    out = study.report(spark, path, "dev", P, {m: runs[m] for m in ("bm25", "dense", "rerank")}, overlap)
    assert out["missing"] == ["hybrid"] and set(out["differences"]["bm25"].values()) == {0.0} and out["methods"]["bm25"]["without_overlap"]["recall@1"] == 1.0
    for other in ({"bm25": runs["dense"]}, {"dense": runs["rerank"]}):
        with pytest.raises(ValueError):
            study.report(spark, path, "dev", P, other)
    for part in (tmp_path / "dense" / "predictions").glob(".*.crc"):
        part.unlink()
    next((tmp_path / "dense" / "predictions").glob("part-*")).unlink()
    with pytest.raises(ValueError):
        study.report(spark, path, "dev", P, {"dense": runs["dense"]})


def test_sealed_test_split(spark, data, tmp_path):
    path, _ = data
    dev = study.run_method(spark, path, "dev", "bm25", P, f"file://{tmp_path}/dev")
    with pytest.raises(PermissionError):
        study.run_method(spark, path, "test", "bm25", P, f"file://{tmp_path}/t", threshold=dev)
    for wrong in (None, dev | {"method": "dense"}, dev | {"split": "test"}, dev | {"rejection": {"threshold": float("nan")}}, dev | {"manifest": "x"}):
        with pytest.raises(ValueError):
            study.run_method(spark, path, "test", "bm25", P, f"file://{tmp_path}/t", threshold=wrong, allow_test=True)
    test = study.run_method(spark, path, "test", "bm25", P, f"file://{tmp_path}/t", threshold=dev, allow_test=True)
    assert test["rejection"]["threshold"] == dev["rejection"]["threshold"]
    assert study.report(spark, path, "test", P, {"bm25": f"file://{tmp_path}/t"}, allow_test=True)["methods"]["bm25"]["rejection"] == test["rejection"]
    with pytest.raises(ValueError):
        study.Protocol(methods=("magic",))


def test_gallery(spark, data):
    _, bundle = data
    study.check_gallery(bundle.corpus.withColumn("extra", F.lit(1)), bundle)
    for other in (bundle.corpus.where("id <> 'd1'"), bundle.corpus.withColumn("text", F.upper("text")), bundle.corpus.union(bundle.corpus), bundle.corpus.drop("text")):
        with pytest.raises(ValueError):
            study.check_gallery(other, bundle)
