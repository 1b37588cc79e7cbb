"""Encoders, chunks, rerankers, objects, tools, requests, configuration and prepared data."""

import base64
import hashlib
import io
import json
import urllib.error
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from relevance_spark import config
from relevance_spark.operators import batching, chunking, corpus, dense, encoders, graph, rerankers, service, splitting, tools, transformers
from relevance_spark.operators.retrieval import HybridRetriever
from relevance_spark.plans import catalog
from relevance_spark.registry import Registry
from relevance_spark.sources import prepared, readers, snapshots

E = encoders.HashingEncoder(native_dim=32)


def embedded(text, dim):
    """The hashing encoder by its definition, one feature after the other."""
    v, words = np.zeros(dim), encoders.WORDS.findall((text or "").lower())
    found = Counter({"w:" + " ".join(words[i : i + n]): 0 for n in (1, 2) for i in range(len(words) - n + 1)})
    weights = [("w:" + " ".join(words[i : i + n]), 1.0) for n in (1, 2) for i in range(len(words) - n + 1)]
    weights += [("c:" + p[i : i + n], 0.5) for w in words for p in [f"<{w}>"] for n in (3, 4, 5) for i in range(len(p) - n + 1)]
    for f, x in weights:
        h = hashlib.blake2b(f.encode(), digest_size=8).digest()
        v[int.from_bytes(h[:4], "little") % dim] += x if h[4] % 2 else -x
    assert set(found) <= {f for f, _ in weights}
    v = np.sign(v) * np.log1p(np.abs(v))
    return v / max(np.linalg.norm(v), 1e-12)


def test_hash_embed_of_whole_texts(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = catalog.queries()["hash_embed"](spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert np.allclose(r.vec, embedded(texts[r.id], 128), atol=1e-5)


def test_chunks_of_whole_texts(spark, data):
    """Ids in order, sizes, and the rule itself on every step, for all texts."""
    texts = {str(r.doc_id): r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {}
    for r in catalog.queries()["chunk_documents"](spark, data).collect():
        got.setdefault(r.parent_id, {})[r.chunk] = r.text
    assert set(got) == {i for i, t in texts.items() if (t or "").strip()}
    for i, parts in got.items():
        assert sorted(parts) == list(range(len(parts)))
        pieces, now = iter(x for x in chunking.cut_down(texts[i].strip(), 1000) if x), None
        want = []
        for p in pieces:
            if now is not None and len(now) + 1 + len(p) <= 1000:
                now = now + "\n" + p
                continue
            if now is not None:
                want.append(now)
                tail = (now[-100:] + " " + p).strip()
                p = tail if len(tail) <= 1000 else p
            now = p
        assert [parts[k] for k in range(len(parts))] == [*want, now]


def test_chunk_borders():
    assert chunking.cut_down("a b.\n \nc. d" * 3, 5) == ["a b.", "c.", "da b.", "c.", "da b.", "c. d"]
    assert chunking.chunks(None) == [] and chunking.chunks("  x  ", 1, 0) == ["x"] and chunking.chunks("ab", 1, 0) == ["a", "b"]
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            chunking.chunks("x", *bad)


def test_batches_of_shared_keys_are_fast():
    import time

    keys = [{("t", i), ("t", "shared")} for i in range(4000)]
    began = time.process_time()
    assert batching.greedy(keys, 32) == [(i, 0) for i in range(4000)]
    assert time.process_time() - began < 0.5


def test_split_components_and_updates(spark):
    rows = spark.range(25).withColumnRenamed("id", "ord")
    a = {r.ord for r in splitting.shuffled_split(rows, 0.1, 1).where("in_dev").collect()}
    b = {r.ord for r in splitting.shuffled_split(rows.orderBy(F.desc("ord")), 0.1, 1).where("in_dev").collect()}
    assert a == b and len(a) == 2 and splitting.shuffled_split(rows.limit(0), 0.1).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(200, 100), (5, 5)], "a long, b long")
    assert {r.node: r.component for r in graph.connected(chain).collect()} == {**dict.fromkeys(range(71), 0), 100: 100, 200: 100}
    docs = spark.createDataFrame([("a", "x")], "id string, text string")
    with pytest.raises(ValueError):
        corpus.update(docs, spark.createDataFrame([("b", "y")], docs.schema))


def test_token_digest_folds(spark):
    from relevance_spark.functions.text import token_digest

    df = spark.createDataFrame([("Straße ﬁn ＡＢＣ",), ("abc, FIN STRASSE",), ("other",), (None,)], "t string").select(token_digest(F.col("t")).alias("d"))
    a, b, c, n = [r.d for r in df.collect()]
    assert a == b and len({a, c, n}) == 3 and n == hashlib.sha256(b"").hexdigest()


def test_hybrid_by_hand(spark):
    """Ranks of both branches add up; a document without a query word comes from its vector alone; filters cut both."""
    docs = spark.createDataFrame([("s", "zebra", [1.0, 0.0], 1), ("m", "other", [0.9, 0.1], 1), ("l", "query words", [0.0, 1.0], 2)], "id string, text string, vec array<double>, tenant int")
    q = spark.createDataFrame([(1, "query words", [1.0, 0.0])], "query_id long, text string, vec array<double>")
    rows = HybridRetriever(docs, constant=10).search(q, 3).orderBy("rank").collect()
    assert [r.id for r in rows] == ["l", "s", "m"] and rows[0].score == pytest.approx(1 / 11 + 1 / 13)
    assert [r.id for r in HybridRetriever(docs, constant=10).search(q, 3, {"tenant": 1}).orderBy("rank").collect()] == ["s", "m"]


def test_approximate_index_on_disk(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(200)], "id long, vec array<double>")
    q = rows.where("id < 5").withColumnRenamed("id", "query_id")
    index = dense.ApproximateIndex.build(rows, 8, 16, 3)
    index.save(f"file://{tmp_path}/ann", "f")
    again = dense.ApproximateIndex.load(spark, f"file://{tmp_path}/ann", "f")
    assert sorted(index.search(q, 5).collect()) == sorted(again.search(q, 5).collect())
    snapshots.save(rows, f"file://{tmp_path}/plain", "f", 8)
    with pytest.raises(ValueError):
        dense.ApproximateIndex.load(spark, f"file://{tmp_path}/plain")
    with pytest.raises(ValueError):
        snapshots.load(spark, f"file://{tmp_path}/plain", strict=True)


def test_remote_encoder_in_process():
    """Retries, the order of answers, lengths, and no way to another address."""
    waits, answers = [], [urllib.error.HTTPError("u", 429, "", {"Retry-After": "3"}, io.BytesIO()), urllib.error.HTTPError("u", 500, "", {}, io.BytesIO())]

    def send(body):
        if answers:
            raise answers.pop(0)
        n = len(json.loads(body)["input"])
        return {"data": [{"index": i, "embedding": [float(i), 1.0]} for i in reversed(range(n))]}

    e = encoders.RemoteEncoder(native_dim=2, send=send, pause=waits.append)
    assert e._encode(["a", "b"]).tolist() == [[0, 1], [1, 1]] and waits == [3.0, 2.0]
    with pytest.raises(ValueError):
        encoders.RemoteEncoder(native_dim=3, send=send)._encode(["a"])
    with pytest.raises(ValueError):
        encoders.RemoteEncoder(native_dim=2, send=lambda b: {"data": [{"index": 1, "embedding": [0, 0]}]})._encode(["a"])
    with pytest.raises(urllib.error.HTTPError):
        encoders.RemoteEncoder(native_dim=2, retries=0, send=lambda b: (_ for _ in ()).throw(urllib.error.HTTPError("u", 503, "", {}, io.BytesIO())))._encode(["a"])


def test_redirects_are_refused():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Away(BaseHTTPRequestHandler):
        def do_POST(self):
            self.send_response(307)
            self.send_header("Location", "http://127.0.0.1:1/other")
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Away)
    threading.Thread(target=server.handle_request, daemon=True).start()
    with pytest.raises(encoders.Refused):
        encoders.RemoteEncoder(native_dim=1, url=f"http://127.0.0.1:{server.server_port}/v1", retries=0)._encode(["a"])


def test_registry():
    r = Registry("thing", one=int)
    r.put("Lazy_One", "collections:Counter")
    r.alias("other", "lazy-one")
    assert r.get("ONE") is int and r.get(" other ") is Counter and "lazy_one" in r and "none" not in r and r.names() == ["lazy-one", "one"]
    for bad in (lambda: r.put("one", str), lambda: r.put("x", "nocolon"), lambda: r.get("none")):
        with pytest.raises((ValueError, KeyError)):
            bad()
    r.put("one", str, override=True)
    assert r.build("one", 3) == "3" and isinstance(encoders.load_encoder({"type": "Hashing", "native_dim": 8}), encoders.HashingEncoder)
    assert encoders.preset_of("intfloat/E5-base")["pooling"] == "mean" and encoders.preset_of("x", {"pooling": "last"})["pooling"] == "last"


def test_rerankers(spark):
    hits = spark.createDataFrame([(1, "a", "xx", 0.9, 1), (1, "b", "yyy", 0.8, 2), (1, "c", "zzz", 0.7, 3)], "query_id long, id string, text string, score double, rank int")
    q = spark.createDataFrame([(1, "q")], "query_id long, text string")
    by_size = rerankers.CallableReranker(lambda qs, ts: [float(len(t)) for t in ts])
    rows = by_size.rerank(hits, q, 2).orderBy("rank").collect()
    assert [(r.id, r.retrieval_score) for r in rows] == [("b", 0.8), ("c", 0.7)]
    assert by_size.ranked_documents(spark, "q", ["x", "zz", "yy"], 2) == [{"index": 1, "relevance_score": 2.0, "document": "zz"}, {"index": 2, "relevance_score": 2.0, "document": "yy"}]
    one = rerankers.cross_encoder(lambda model, qs, ts: [[model * len(t)] for t in ts], load=lambda: 1.0)
    assert one.ranked_documents(spark, "q", ["abc"])[0]["relevance_score"] == pytest.approx(1 / (1 + np.exp(-3)))
    assert rerankers.class_probability([[0.0, 0.0, np.log(2)]]) == pytest.approx([0.5])
    yes = rerankers.yes_no(lambda qs, ts: [[0.0, 1.0] for _ in ts])
    assert yes.ranked_documents(spark, "q", ["abc"])[0]["relevance_score"] == pytest.approx(np.e / (1 + np.e))
    same = rerankers.load_reranker("encoder:hashing").ranked_documents(spark, "red fox", ["blue sky", "red fox"])
    assert same[0]["document"] == "red fox" and same[0]["relevance_score"] == pytest.approx(1, abs=1e-5)
    with pytest.raises(ValueError):
        by_size.rerank(hits.drop("text"), q)
    with pytest.raises(KeyError):
        rerankers.load_reranker("none")


def test_corpus_and_memory_objects(spark, tmp_path):
    c = service.Corpus(spark, E)
    assert c.add(["red fox", "blue sky"], [{"t": 1}, {"t": 2}], ["a", "b"]) == ["a", "b"]
    for bad in (lambda: c.add(["x"], ids=["a"]), lambda: c.add(["x", "y"], ids=["z"]), lambda: c.update("none", "x"), lambda: c.search(["x"], rerank=True)):
        with pytest.raises(ValueError):
            bad()
    assert len(c) == 2 and "a" in c and "z" not in c and c.get("b")["text"] == "blue sky" and c.get("z") is None
    c.update("b", "green tree", {"t": 3})
    assert c.search(["green tree"], 1).first().id == "b" and c.get("b")["metadata"] == {"t": "3"} and c.search(["red"], 5, {"t": 3}).count() == 1
    assert c.vectors_of(["a"]).count() == 1 and c.delete(["b", "none"]) == 1 and c.ids() == ["a"]
    c.save(f"file://{tmp_path}/c")
    assert service.Corpus.load(spark, f"file://{tmp_path}/c", E).ids() == ["a"]
    with pytest.raises(ValueError):
        service.Corpus.load(spark, f"file://{tmp_path}/c", encoders.HashingEncoder(native_dim=16))
    m = service.Memory(service.Corpus(spark, E), half_life=100.0, clock=lambda: 1000.0)
    old, new = m.remember("likes tea", created=0.0), m.remember("likes tea much")
    rows = m.recall("likes tea", 2).orderBy("rank").collect()
    assert [r.id for r in rows] == [new, old] and rows[1].score < 0.01 and m.recall("likes tea", 2, min_score=0.1).count() == 1
    m.save(f"file://{tmp_path}/m")
    kept = service.Memory.load(spark, f"file://{tmp_path}/m", E, clock=lambda: 1000.0)
    assert kept.half_life == 100.0 and kept.forget_older_than(500.0) == 1 and kept.forget([new]) == 1 and len(kept.store) == 0
    with pytest.raises(ValueError):
        service.Memory.load(spark, f"file://{tmp_path}/c", E)


def test_router_object(spark):
    r = service.Router(spark, E, threshold=0.4)
    r.add_route("refund", ["money back please", "refund my order"])
    r.add_route("twin", ["money back please"], threshold=0.99)
    assert r.route("money back please") == "refund" and [n for n, _ in r.shortlist("money back please", 2)] == ["refund", "twin"]
    assert r.route("zzz qqq") is None and r.route("  ") is None
    r.remove_route("refund")
    assert r.route("money back please") == "twin" and r.route("money back now") is None
    for bad in (lambda: r.add_route("twin", ["x"]), lambda: r.add_route("none", [" "]), lambda: r.remove_route("none")):
        with pytest.raises((ValueError, KeyError)):
            bad()


def test_tools(spark):
    c = service.Corpus(spark, E)
    c.add(["red fox"], [{"kind": "x"}], ["a"])
    r = service.Router(spark, E, threshold=0.1)
    r.add_route("foxes", ["red fox"])
    kit = tools.search_tools(c, writable=True) + tools.memory_tools(service.Memory(service.Corpus(spark, E))) + tools.route_tools(r)
    assert kit.names() == ["knowledge_search", "knowledge_add", "memory_remember", "memory_recall", "route_request"] and len(kit) == 5
    assert kit.call("knowledge_search", '{"query": "red fox", "k": 1}')[0] == {"id": "a", "score": 1.0, "text": "red fox", "metadata": {"metadata": {"kind": "x"}}}
    new = kit.call("knowledge_add", {"text": "blue sky"})["id"]
    assert new in c and kit.call("memory_remember", {"text": "tea"})["id"] and kit.call("memory_recall", {"query": "tea"})[0]["text"] == "tea"
    assert kit.call("route_request", {"request": "red fox"})["match"] == "foxes"
    assert {t["name"] for t in kit.described()} == set(kit.names()) and kit.described("openai")[0]["function"]["parameters"]["required"] == ["query"]
    for bad in ({}, {"query": 1}, {"query": "x", "k": 0}, {"query": "x", "k": True}, {"query": "x", "more": 1}, "{", [1], {"query": "x" * 20_001}):
        with pytest.raises(tools.ToolError):
            kit.call("knowledge_search", bad)
    with pytest.raises(tools.ToolError):
        kit.call("none")
    with pytest.raises(ValueError):
        kit + tools.search_tools(c)


def test_requests(spark):
    c = service.Corpus(spark, E)
    s = service.Service(E, spark, c, rerankers.EncoderReranker(E), key="k", writable=True, most_texts=2, longest=20)
    assert s.add_documents(["red fox", "blue sky"], ["a", "b"]) == {"ids": ["a", "b"], "count": 2}
    assert s.search("red fox", 1)["data"][0]["id"] == "a" and s.delete_documents(["b"]) == {"deleted": 1, "count": 1}
    plain, coded = s.embeddings("abcdefgh"), s.embeddings(["abcdefgh"], "base64")
    assert np.allclose(np.frombuffer(base64.b64decode(coded["data"][0]["embedding"]), "<f4"), plain["data"][0]["embedding"]) and plain["usage"]["total_tokens"] == 2
    assert len(s.embeddings("x", dimensions=8)["data"][0]["embedding"]) == 8 and s.rerank("red", ["blue", "red"], 1)["results"][0]["index"] == 1
    assert s.health()["documents"] == 1 and s.models()["data"][0]["id"] == "default"
    s.authorise("Bearer k")
    bare = service.Service(E, spark)
    for status, call in [(401, lambda: s.authorise("Bearer x")), (401, lambda: s.authorise(None)), (422, lambda: s.embeddings([])), (413, lambda: s.embeddings(["a"] * 3)), (413, lambda: s.embeddings("a" * 21)), (422, lambda: s.search("x", 101)), (404, lambda: bare.search("x")), (403, lambda: bare.add_documents(["x"])), (404, lambda: bare.rerank("x", ["y"])), (422, lambda: s.add_documents(["x"], ["a"])), (422, lambda: s.embeddings("x", dimensions=33))]:
        with pytest.raises(service.RequestError) as e:
            call()
        assert e.value.status == status


def test_transformers(spark):
    df = spark.createDataFrame([("red fox",)], "text string")
    assert len(transformers.TextEmbedder(E).transform(df).first().vec) == 32 and transformers.TextEmbedder(E, as_vector=True).transform(df).first().vec.size == 32
    e = transformers.Embeddings(spark, E)
    assert e.embed_documents(["red fox", "x"])[0] == pytest.approx(e.embed_query("red fox")) and e.embed_documents([]) == []


def test_configuration(tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}')
    (tmp_path / "b.json").write_text("[1]")
    assert config.load_config(tmp_path / "a.json") == {"x": 1} and config.parsed("3") == 3 and config.parsed("x") == "x" and config.version_numbers("4.51.3.dev0") == (4, 51, 3)
    assert [list(x) for x in config.slices([1, 2, 3], 2)] == [[1, 2], [3]]
    for bad in (tmp_path / "b.json", tmp_path / "c.txt"):
        with pytest.raises(ValueError):
            config.load_config(bad)
    config.write_json(tmp_path / "d" / "x.json", {"a": "é"})
    assert json.loads((tmp_path / "d" / "x.json").read_text()) == {"a": "é"} and len(list((tmp_path / "d").iterdir())) == 1
    assert config.without_secrets({"token": True, "api_key": None, "key_variable": "K", "base_url": "https://h/v1"})
    for bad in ({"api_key": "x"}, {"a": [{"Access-Token": "x"}]}, {"base_url": "https://u:p@h"}, {"base_url": "https://h?k=1"}, {"headers": {"x": 1}}):
        with pytest.raises(ValueError):
            config.without_secrets(bad)
    with pytest.raises(ImportError):
        config.needed("no_such_package_here")


def bundle(spark):
    c = spark.createDataFrame([("d1", "x"), ("d2", "y")], "id string, text string")
    q = spark.createDataFrame([("dev", "q1", "a", None), ("test", "q2", "b", "l")], "split string, id string, text string, label string")
    j = spark.createDataFrame([("dev", "q1", "d1", 1.0), ("test", "q2", None, None)], "split string, query_id string, id string, rel double")
    return prepared.Bundle(c, q, j)


def test_prepared_data(spark, tmp_path):
    b, path = bundle(spark), f"file://{tmp_path}/p"
    first = prepared.write_prepared(b, path)
    assert prepared.write_prepared(b, path) == first
    assert prepared.load_prepared(spark, path).queries.first().id == "q1" and prepared.load_prepared(spark, path, "test", allow_test=True).qrels.first().id is None
    with pytest.raises(PermissionError):
        prepared.load_prepared(spark, path, "test")
    with pytest.raises(ValueError):
        prepared.write_prepared(prepared.Bundle(b.corpus.where("id = 'd1'"), b.queries, b.qrels), path)
    for part in (tmp_path / "p" / "corpus").glob("part-*"):
        part.write_text(part.read_text().replace('"x"', '"z"'))
    for crc in (tmp_path / "p" / "corpus").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError):
        prepared.load_prepared(spark, path)


def test_bundles_and_predictions_are_checked(spark):
    b = bundle(spark)
    prepared.validate_bundle(b)
    row = lambda *v: spark.createDataFrame([v], b.qrels.schema)
    for c, q, j in [
        (b.corpus.union(b.corpus), b.queries, b.qrels), (b.corpus, b.queries.union(b.queries), b.qrels), (b.corpus, b.queries, b.qrels.where("id IS NOT NULL")),
        (b.corpus, b.queries, b.qrels.union(row("dev", "q1", "d9", 1.0))), (b.corpus, b.queries, b.qrels.union(row("dev", "q1", "d2", -1.0))), (b.corpus, b.queries, b.qrels.union(row("dev", "q1", "d2", float("nan")))), (b.corpus, b.queries, b.qrels.union(row("dev", "q9", "d1", 1.0))),
    ]:
        with pytest.raises(ValueError):
            prepared.validate_bundle(prepared.Bundle(c, q, j))
    run = lambda *rows: spark.createDataFrame(rows, "query_id string, id string, score double")
    prepared.validate_predictions(b.queries, run(("q1", "d1", 1.0), ("q1", "d2", 0.5), ("q2", None, None)), b.corpus)
    for bad in (run(("q1", "d1", 1.0)), run(("q1", "d1", 1.0), ("q1", "d1", 1.0), ("q2", None, None)), run(("q1", "d9", 1.0), ("q2", None, None)), run(("q1", "d1", float("inf")), ("q2", None, None)), run(("q1", "d1", 1.0), ("q2", None, None), ("q3", None, None))):
        with pytest.raises(ValueError):
            prepared.validate_predictions(b.queries, bad, b.corpus)


def test_source_formats(spark, tmp_path):
    (tmp_path / "train.csv").write_text('text,category\n"a ""b"", c",x\n' + "".join(f"train {i} text,{'xy'[i % 2]}\n" for i in range(40)))
    (tmp_path / "test.csv").write_text("text,category\nhello,x\nbye,z\n")
    b = prepared.read_banking77(spark, str(tmp_path), 0.2)
    prepared.validate_bundle(b)
    assert b.queries.where("split = 'dev'").count() == 8 and b.corpus.where(F.col("text") == 'a "b", c').count() + b.queries.where(F.col("text") == 'a "b", c').count() == 1
    assert b.qrels.join(b.queries.where("text = 'bye'"), F.col("query_id") == b.queries["id"]).first()["rel"] is None
    (tmp_path / "c.json").write_text(json.dumps({"train": [[f"t {i}", "ab"[i % 2]] for i in range(20)], "test": [["u", "a"]], "oos_test": [["v", "oos"]], "oos_train": []}))
    c = prepared.read_clinc150(spark, str(tmp_path / "c.json"))
    prepared.validate_bundle(c)
    assert c.qrels.where("split = 'test' AND rel IS NULL").count() == 1
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "1", "title": "T", "text": "x"}\n{"_id": "2", "title": "", "text": " "}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "5", "text": "q"}\n{"_id": "6", "text": "r"}\n')
    for name, q in (("train", 5), ("test", 6)):
        (tmp_path / "qrels" / f"{name}.tsv").write_text(f"query-id\tcorpus-id\tscore\n{q}\t1\t1\n")
    s = prepared.read_scifact(spark, str(tmp_path))
    prepared.validate_bundle(s)
    assert s.corpus.first().text == "T x" and s.corpus.count() == 1 and s.queries.count() == 2


def test_readers_round_trip(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\n\n b \n")
    assert readers.read_texts(spark, str(tmp_path / "t.txt")).count() == 2
    (tmp_path / "d.jsonl").write_text('{"id": 1, "text": "x", "tag": "t"}\n{"id": 2, "text": "y"}\n')
    assert readers.read_documents(spark, str(tmp_path / "d.jsonl")).columns == ["id", "text", "tag"]
    (tmp_path / "e.jsonl").write_text('{"id": 1, "text": "x"}\n{"text": "y"}\n')
    with pytest.raises(ValueError):
        readers.read_documents(spark, str(tmp_path / "e.jsonl"))
    run = spark.createDataFrame([("q", "b", 0.5, 2), ("q", "a", 0.9, 1)], "query_id string, id string, score double, rank int")
    readers.write_predictions(run, f"{tmp_path}/run")
    assert [(r.id, r["rank"]) for r in readers.read_predictions(spark, f"{tmp_path}/run").orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\nq\ta\t1\nq\ta\t2\n")
    with pytest.raises(ValueError):
        readers.read_qrels(spark, str(tmp_path / "q.tsv"))


def test_examples_as_a_list_and_bad_lines(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"query": "a", "pos": "b", "neg": ["c", "d"]},\n {"anchor": "e", "document": "f", "score": 0.5}]')
    rows = sorted(readers.read_examples(spark, str(tmp_path / "l.json")).collect(), key=lambda r: r.query)
    assert [(r.query, r.positive, r.negatives, r.score) for r in rows] == [("a", "b", ["c", "d"], None), ("e", "f", [], 0.5)]
    good = '{"query": "a", "positive": "b"}\n'
    for k, (text, line) in enumerate([(good + "\n" + good + "{oops\n", 4), (good + '{"query": "a"}\n' + "", 2), (good + '["a", "b"]\n', 2), (good * 2 + "3\n", 3)]):
        (tmp_path / f"bad{k}.jsonl").write_text(text)
        with pytest.raises(ValueError, match=f"bad{k}.jsonl:{line}: "):
            readers.read_examples(spark, str(tmp_path / f"bad{k}.jsonl"))
    (tmp_path / "empty.json").write_text("[ ]")
    assert readers.read_examples(spark, str(tmp_path / "empty.json")).count() == 0
    (tmp_path / "cut.json").write_text('[{"query": "a"')
    with pytest.raises(ValueError, match="not a JSON list"):
        readers.read_examples(spark, str(tmp_path / "cut.json"))


def test_ingest_stream_appends_new_rows_once(spark, tmp_path):
    from relevance_spark.streaming.ingest import ingest, read_stream

    source, target, notes = (f"{tmp_path}/{n}" for n in ("in", "out", "notes"))
    put = lambda lo, hi: spark.range(lo, hi).selectExpr("id", "cast(id AS string) AS text").write.mode("append").parquet(source)
    take = lambda: ingest(read_stream(spark, source, "id long, text string"), lambda d: d.withColumn("n", F.length("text")), target, notes).awaitTermination(60)
    put(0, 5)
    assert take()
    put(5, 12)
    assert take() and take()
    rows = spark.read.parquet(target)
    assert rows.count() == 12 and rows.select("id").distinct().count() == 12 and rows.where("n = 2").count() == 2
