"""Studies over a prepared split: a method's run with metrics, timings and rejection, and a report that checks the runs.

A run is a folder with its predictions and a result; the result names the protocol, data and encoder it belongs to, so a
threshold or a report can't mix runs of different ones.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevance_spark.operators import bm25, dense, evaluation
from relevance_spark.operators.encoders import Encoder
from relevance_spark.operators.ranking import reciprocal_rank_fusion
from relevance_spark.operators.rerankers import Reranker
from relevance_spark.sources import prepared, readers
from relevance_spark.sources.readers import canonical_json, table_digest

METHODS = ("bm25", "dense", "hybrid", "rerank")


@dataclass(frozen=True)
class Protocol:
    """What is fixed before the test split is opened."""

    methods: tuple[str, ...] = METHODS
    k: int = 100
    cutoffs: tuple[int, ...] = (1, 10, 100)
    depth: int = 100
    constant: float = 60.0
    k1: float = 1.5
    b: float = 0.75
    rerank_depth: int = 20
    false_acceptance: float = 0.05
    latency_queries: int = 30

    def __post_init__(self):
        if odd := set(self.methods) - set(METHODS):
            raise ValueError(f"unknown methods: {sorted(odd)}")

    def identity(self) -> str:
        return hashlib.sha256(canonical_json(asdict(self)).encode()).hexdigest()


def manifest_identity(spark: SparkSession, path: str) -> str:
    return hashlib.sha256(canonical_json(prepared.read_manifest(spark, path)).encode()).hexdigest()


def _read(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/result").first().value)


def _searcher(method: str, corpus: DataFrame, protocol: Protocol, encoder: Encoder | None, work: str):
    """Build the tables of a method under ``work``; a function from queries (query_id, text) to a ranked run."""
    spark, lexical, near = corpus.sparkSession, None, None
    if method in ("bm25", "hybrid"):
        lexical = bm25.build(corpus).write(f"{work}/words")
    if method != "bm25":
        if encoder is None:
            raise ValueError(f"{method} needs an encoder")
        corpus.select("id", encoder.vectors(F.col("text")).alias("vec")).write.parquet(f"{work}/vectors")
        near = spark.read.parquet(f"{work}/vectors")

    def search(queries: DataFrame) -> DataFrame:
        deep = max(protocol.k, protocol.depth) if method == "hybrid" else protocol.k
        found = []
        if lexical is not None:
            found.append(bm25.search(lexical, queries, deep, k1=protocol.k1, b=protocol.b))
        if near is not None:
            found.append(dense.search(queries.select("query_id", encoder.vectors(F.col("text"), "query").alias("vec")), near, deep))
        run = found[0] if len(found) == 1 else reciprocal_rank_fusion(found, protocol.k, protocol.constant)
        return run.select("query_id", "id", "score", "rank")

    return search


def _keep(run: DataFrame, path: str) -> DataFrame:
    readers.write_predictions(run, path)
    return readers.read_predictions(run.sparkSession, path).select("query_id", "id", "score", "rank")


def reranked(run: DataFrame, corpus: DataFrame, queries: DataFrame, reranker: Reranker, depth: int) -> DataFrame:
    """The first ``depth`` hits of each query in the reranker's order, then the rest as they were."""
    head = run.where(F.col("rank") <= depth).join(corpus.select("id", "text"), "id")
    columns = ["query_id", "id", "score", "rank"]
    return reranker.rerank(head, queries).select(*columns).unionByName(run.where(F.col("rank") > depth).select(*columns))


def complete(run: DataFrame, queries: DataFrame) -> DataFrame:
    """The run with one row of nulls for each query without hits."""
    without = queries.select("query_id").join(run, "query_id", "left_anti")
    return run.select("query_id", "id", "score").unionByName(without, allowMissingColumns=True)


def answers(run: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Per query: the score of the first hit (null without hits), whether it is a positive, whether there is any."""
    good = qrels.where("rel > 0").select("query_id", "id")
    first = run.where("rank = 1").join(good.withColumn("correct", F.lit(True)), ["query_id", "id"], "left")
    known = good.select("query_id").distinct().withColumn("in_scope", F.lit(True))
    rows = queries.select("query_id").join(first.select("query_id", "score", "correct"), "query_id", "left").join(known, "query_id", "left")
    return rows.fillna(False, ["correct", "in_scope"])


def metrics_of(run: DataFrame, qrels: DataFrame, cutoffs) -> dict[str, float]:
    return {f"{r.metric}@{r.k}": r.value for r in evaluation.evaluate(run, qrels, list(cutoffs)).collect()}


def close(a: dict | None, b: dict | None) -> bool:
    """Same keys, and numbers that differ by no more than the order of their sums."""
    if a is None or b is None or set(a) != set(b):
        return a == b
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    return all(math.isclose(a[k], b[k], rel_tol=1e-9, abs_tol=1e-12) if number(a[k]) and number(b[k]) else a[k] == b[k] for k in a)


def sealed_threshold(record: dict, belongs: dict) -> float:
    """The threshold of a development run, if it belongs to the same protocol, data, method and encoder."""
    if record.get("split") != "dev":
        raise ValueError("a threshold is chosen on the dev split")
    for key, value in belongs.items():
        if record.get(key) != value:
            raise ValueError(f"the threshold belongs to a different {key}")
    value = (record.get("rejection") or {}).get("threshold")
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ValueError("the threshold is no finite number")
    return float(value)


def check_gallery(corpus: DataFrame, bundle: prepared.Bundle) -> None:
    """A corpus that is searched holds the prepared one whole: the same ids with the same texts (and labels, if any)."""
    columns = [c for c in ("id", "text", "label") if c in bundle.corpus.columns]
    if odd := [c for c in columns if c not in corpus.columns]:
        raise ValueError(f"missing columns: {odd}")
    ours, theirs = corpus.select(*columns), bundle.corpus.select(*columns)
    if not ours.exceptAll(theirs).isEmpty() or not theirs.exceptAll(ours).isEmpty():
        raise ValueError("not the prepared corpus")


def latencies(search, queries: DataFrame, n: int) -> dict:
    """Times of single warm searches for at most n queries, in the order of a hash of their ids."""
    sample = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(n).collect()
    times = []
    for k, row in enumerate([*sample[:1], *sample]):
        one = queries.sparkSession.createDataFrame([(row.query_id, row.text)], "query_id string, text string")
        began = time.perf_counter()
        search(one).collect()
        if k:  # the first one warms up
            times.append(time.perf_counter() - began)
    if not times:
        return {"sample": 0}
    return {"sample": len(times), "p50": float(np.quantile(times, 0.5)), "p95": float(np.quantile(times, 0.95))}


def run_method(spark: SparkSession, data: str, split: str, method: str, protocol: Protocol, out: str, encoder: Encoder | None = None, reranker: Reranker | None = None, threshold: dict | None = None, allow_test: bool = False) -> dict:
    """Search the corpus for every query of a split and publish predictions and result under ``out``.

    On dev, a threshold is chosen where some queries have no positive; on test, the record of such a run is required.
    """
    if method not in protocol.methods:
        raise ValueError(f"{method!r} is not in the protocol")
    if method == "rerank" and reranker is None:
        raise ValueError("rerank needs a reranker")
    store, target = prepared._fs(spark, out)
    if store.exists(target):
        raise FileExistsError(out)
    bundle = prepared.load_prepared(spark, data, split, allow_test)
    queries, qrels = bundle.queries.select(F.col("id").alias("query_id"), "text"), bundle.qrels
    belongs = {"protocol": protocol.identity(), "manifest": manifest_identity(spark, data), "method": method, "encoder": None if encoder is None or method == "bm25" else encoder.fingerprint()}
    n = queries.count()
    rejecting = 0 < qrels.where("rel > 0").select("query_id").distinct().count() < n
    if split == "test" and rejecting and threshold is None:
        raise ValueError("the test split needs the threshold of its development run")
    limit = sealed_threshold(threshold, belongs) if split == "test" and rejecting else None

    stage = f"{out.rstrip('/')}.{uuid.uuid4().hex}"
    marks = [time.perf_counter()]
    mark = lambda: marks.append(time.perf_counter()) or marks[-1] - marks[-2]
    search = _searcher(method, bundle.corpus, protocol, encoder, f"{stage}/work")
    timing = {"index": mark()}
    first = run = _keep(search(queries), f"{stage}/first" if method == "rerank" else f"{stage}/predictions")
    timing["retrieval"] = mark()
    timing["queries_per_second"] = n / timing["retrieval"]
    if method == "rerank":
        run = _keep(reranked(first, bundle.corpus, queries, reranker, protocol.rerank_depth), f"{stage}/predictions")
        timing["rerank"] = mark()
    timing["latency"] = latencies(search, queries, protocol.latency_queries)
    prepared.validate_predictions(bundle.queries, complete(run, queries), bundle.corpus)

    result = belongs | {"split": split, "queries": n, "rankable": qrels.where("rel > 0").select("query_id").distinct().count(), "documents": bundle.corpus.count(), "metrics": metrics_of(run, qrels, protocol.cutoffs), "timing": timing, "predictions": {"rows": run.count(), "digest": table_digest(run)}, "rejection": None}
    if method == "rerank":
        result["first_metrics"] = metrics_of(first, qrels, protocol.cutoffs)
        result["coverage"] = metrics_of(first, qrels, [protocol.rerank_depth])[f"recall@{protocol.rerank_depth}"]
    if rejecting:
        rows = answers(run, queries, qrels)
        if limit is None:
            best = evaluation.sweep(rows, protocol.false_acceptance).first()
            limit = None if best is None else evaluation.next_up(best.threshold) if best.above else best.threshold
        if limit is not None:
            result["rejection"] = {"threshold": limit} | evaluation.rejection(rows, limit).first().asDict()
    spark.createDataFrame([(canonical_json(result),)], "value string").coalesce(1).write.text(f"{stage}/result")
    store.delete(prepared._fs(spark, f"{stage}/work")[1], True)
    if not store.rename(prepared._fs(spark, stage)[1], target):
        raise OSError(f"could not publish {out}")
    return result


def report(spark: SparkSession, data: str, split: str, protocol: Protocol, runs: dict[str, str], overlap: DataFrame | None = None, allow_test: bool = False) -> dict:
    """Check the runs (method to folder) against their data and protocol and work their metrics out again.

    overlap (query_id): queries left out of a second set of metrics. Methods of the protocol without a run are listed,
    not passed over; differences are against the protocol's first method.
    """
    bundle = prepared.load_prepared(spark, data, split, allow_test)
    queries, qrels = bundle.queries.select(F.col("id").alias("query_id"), "text"), bundle.qrels
    manifest, methods = manifest_identity(spark, data), {}
    n = queries.count()
    for method in protocol.methods:
        if method not in runs:
            continue
        result = _read(spark, runs[method])
        for key, value in {"protocol": protocol.identity(), "manifest": manifest, "method": method, "split": split, "queries": n}.items():
            if result.get(key) != value:
                raise ValueError(f"{method}: the run belongs to a different {key}")
        run = readers.read_predictions(spark, f"{runs[method]}/predictions").select("query_id", "id", "score", "rank")
        if {"rows": run.count(), "digest": table_digest(run)} != result["predictions"]:
            raise ValueError(f"{method}: the predictions are not those of the run")
        prepared.validate_predictions(bundle.queries, complete(run, queries), bundle.corpus)
        if not close(metrics_of(run, qrels, protocol.cutoffs), result["metrics"]):
            raise ValueError(f"{method}: the metrics don't follow from the predictions")
        if result["rejection"] is not None:
            limit = result["rejection"]["threshold"]
            again = {"threshold": limit} | evaluation.rejection(answers(run, queries, qrels), limit).first().asDict()
            if not close(again, result["rejection"]):
                raise ValueError(f"{method}: the rejection doesn't follow from the predictions")
        methods[method] = {k: result.get(k) for k in ("metrics", "timing", "rejection", "coverage", "encoder", "rankable")}
        if overlap is not None:
            left = qrels.join(overlap.select("query_id"), "query_id", "left_anti")
            methods[method]["without_overlap"] = metrics_of(run, left, protocol.cutoffs)
    base = methods.get(protocol.methods[0])
    differences = {m: {k: v - base["metrics"][k] for k, v in found["metrics"].items()} for m, found in methods.items()} if base else {}
    return {"protocol": protocol.identity(), "manifest": manifest, "split": split, "queries": n, "methods": methods, "missing": [m for m in protocol.methods if m not in runs], "differences": differences}
