"""Searchable corpora, memories and routers as objects over immutable tables, and the shapes of requests to them.

An object holds a table; a change makes a new one and checks it first, so a change that fails leaves the old one. These
are for interactive use and small writes; bulk work goes to the functions on tables.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevance_spark.operators import agents, corpus
from relevance_spark.operators.encoders import Encoder, same_encoder
from relevance_spark.operators.ranking import where_metadata
from relevance_spark.operators.rerankers import Reranker
from relevance_spark.operators.retrieval import Retriever
from relevance_spark.sources import snapshots

SCHEMA = "id string, text string, metadata map<string,string>, vec array<float>"


def asked(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, text string")


@dataclass
class Corpus:
    """Documents (id, text, metadata, vec) under one encoder."""

    spark: SparkSession
    encoder: Encoder
    rows: DataFrame | None = None
    reranker: Reranker | None = None
    fingerprint: str | None = None

    def __post_init__(self):
        self.rows = self.spark.createDataFrame([], SCHEMA) if self.rows is None else self.rows
        self.fingerprint = self.fingerprint or self.encoder.fingerprint()

    def __len__(self) -> int:
        return self.rows.count()

    def __contains__(self, item: str) -> bool:
        return not self.rows.where(F.col("id") == item).isEmpty()

    def ids(self) -> list[str]:
        """All ids, in order; for corpora that a caller can hold."""
        return [r.id for r in self.rows.select("id").orderBy("id").collect()]

    def get(self, item: str) -> dict | None:
        found = self.rows.where(F.col("id") == item).drop("vec").first()
        return found.asDict() if found else None

    def vectors_of(self, items: list[str]) -> DataFrame:
        """(id, vec) of known ids; an unknown one raises."""
        wanted = self.spark.createDataFrame([(i,) for i in items], "id string")
        if not wanted.join(self.rows, "id", "left_anti").isEmpty():
            raise KeyError("an id is not there")
        return self.rows.join(wanted, "id", "left_semi").select("id", "vec")

    def add(self, texts: list[str], metadata: list[dict] | None = None, ids: list[str] | None = None) -> list[str]:
        """Ids of the new rows. Faults in any of them leave the corpus as it is."""
        ids = ids or [uuid.uuid4().hex for _ in texts]
        metadata = metadata or [{} for _ in texts]
        if not len(texts) == len(ids) == len(metadata) or any(not isinstance(t, str) for t in texts) or any(not i for i in ids) or any(not isinstance(m, dict) for m in metadata):
            raise ValueError("as many texts, ids and metadata; ids are not empty")
        same_encoder({"fingerprint": self.fingerprint}, self.encoder, len(self))
        new = self.spark.createDataFrame([(i, t, {k: str(v) for k, v in m.items()}) for i, t, m in zip(ids, texts, metadata, strict=True)], "id string, text string, metadata map<string,string>")
        self.rows = corpus.add(self.rows, new.withColumn("vec", self.encoder.vectors(F.col("text"))))
        self.fingerprint = self.encoder.fingerprint()
        return ids

    def update(self, item: str, text: str, metadata: dict | None = None) -> None:
        new = corpus.update(self.rows.drop("vec"), self.spark.createDataFrame([(item, text)], "id string, text string"))
        changed = new.where(F.col("id") == item).withColumn("vec", self.encoder.vectors(F.col("text")))
        if metadata is not None:
            changed = changed.withColumn("metadata", F.lit(json.dumps({k: str(v) for k, v in metadata.items()}))).withColumn("metadata", F.from_json("metadata", "map<string,string>"))
        self.rows = self.rows.where(F.col("id") != item).unionByName(changed.select(*self.rows.columns))

    def delete(self, items: list[str]) -> int:
        """How many were there; unknown ids are ignored."""
        self.rows, gone = corpus.delete(self.rows, self.spark.createDataFrame([(i,) for i in items], "id string"))
        return gone

    def search(self, texts: list[str], k: int = 5, where: dict | None = None, min_score: float | None = None, rerank: bool | None = None, instruction: str | None = None) -> DataFrame:
        """Ranked rows per query ("0", "1", ...); reranked where there is a reranker, unless told otherwise."""
        if rerank and self.reranker is None:
            raise ValueError("there is no reranker")
        rows = where_metadata(self.rows, None)
        for name, value in (where or {}).items():
            rows = rows.where(F.col("metadata")[name].eqNullSafe(F.lit(None if value is None else str(value))))
        queries = asked(self.spark, texts)
        again = self.reranker if rerank is not False else None
        told = None if instruction is None else F.lit(instruction)
        found = Retriever(rows, self.encoder).search(queries, 4 * k if again else k, instruction=told)
        found = again.rerank(found, queries, k) if again else found
        return found if min_score is None else found.where(F.col("score") >= min_score)

    def save(self, path: str, extra: dict | None = None) -> None:
        snapshots.save(self.rows, path, self.fingerprint, self.encoder.output_dim or self.encoder.native_dim, extra)

    @classmethod
    def load(cls, spark: SparkSession, path: str, encoder: Encoder, reranker: Reranker | None = None) -> Corpus:
        rows, _ = snapshots.load(spark, path, encoder.fingerprint())
        return cls(spark, encoder, rows, reranker)


@dataclass
class Memory:
    """What was said when: recall by likeness, older things counting less where there is a half-life."""

    store: Corpus
    half_life: float | None = None
    pool: int = 4
    clock: object = time.time

    def remember(self, text: str, tags: dict | None = None, created: float | None = None) -> str:
        return self.remember_many([text], [tags or {}], created)[0]

    def remember_many(self, texts: list[str], tags: list[dict] | None = None, created: float | None = None) -> list[str]:
        when = repr(float(self.clock() if created is None else created))
        return self.store.add(texts, [{**t, "created_at": when} for t in tags or [{} for _ in texts]])

    def forget(self, items: list[str]) -> int:
        return self.store.delete(items)

    def forget_older_than(self, seconds: float) -> int:
        timed = self.store.rows.withColumn("created_at", F.col("metadata")["created_at"].cast("double"))
        kept, stale = agents.expire(timed, float(self.clock()), seconds)
        gone = stale.count()
        self.store.rows = kept.drop("created_at")
        return gone

    def recall(self, text: str, k: int = 5, min_score: float | None = None, where: dict | None = None) -> DataFrame:
        """Without a half-life the nearest k; else the k best of pool * k after decay. min_score comes last."""
        found = self.store.search([text], k * self.pool if self.half_life else k, where).withColumn("created_at", F.col("metadata")["created_at"].cast("double"))
        if self.half_life:
            return agents.decayed(found, float(self.clock()), self.half_life, k, min_score=min_score)
        return found if min_score is None else found.where(F.col("score") >= min_score)

    def save(self, path: str) -> None:
        self.store.save(path, {"memory": {"half_life": self.half_life, "pool": self.pool}})

    @classmethod
    def load(cls, spark: SparkSession, path: str, encoder: Encoder, clock=time.time) -> Memory:
        rows, meta = snapshots.load(spark, path, encoder.fingerprint())
        if "memory" not in meta["extra"]:
            raise ValueError("this snapshot holds no memory")
        return cls(Corpus(spark, encoder, rows), clock=clock, **meta["extra"]["memory"])


@dataclass
class Router:
    """Named routes, each with example requests, a description and a threshold of its own."""

    spark: SparkSession
    encoder: Encoder
    how: str = "max"
    threshold: float = 0.5
    routes: dict = field(default_factory=dict)

    def add_route(self, name: str, examples: list[str], description: str = "", threshold: float | None = None) -> None:
        """The examples and the description are what requests are compared with."""
        texts = [t for t in [*examples, description] if t.strip()]
        if name in self.routes:
            raise ValueError(f"there is a route {name!r} already")
        if not texts:
            raise ValueError("a route needs an example or a description")
        self.routes[name] = (texts, threshold)

    def remove_route(self, name: str) -> None:
        if name not in self.routes:
            raise KeyError(name)
        del self.routes[name]

    def _scores(self, request: str) -> DataFrame:
        if not self.routes:
            raise ValueError("there are no routes")
        order = {name: i for i, name in enumerate(self.routes)}
        rows = self.spark.createDataFrame([(f"{order[n]:09d}", t) for n, (texts, _) in self.routes.items() for t in texts], "route string, text string")
        queries = asked(self.spark, [request]).withColumn("vec", self.encoder.vectors(F.col("text"), "query"))
        return agents.route_scores(queries, rows.withColumn("vec", self.encoder.vectors(F.col("text"))), self.how)

    def shortlist(self, request: str, k: int = 3) -> list[tuple[str, float]]:
        """Best first, ties in the order of adding."""
        names = list(self.routes)
        return [(names[int(r.route)], r.score) for r in agents.shortlist(self._scores(request), k).orderBy("rank").collect()]

    def route(self, request: str) -> str | None:
        """The best route if it reaches its threshold; a runner-up never stands in for it."""
        if not request.strip():
            return None
        (name, score), *_ = self.shortlist(request, 1)
        own = self.routes[name][1]
        return name if round(score, 9) >= (self.threshold if own is None else own) else None


class RequestError(Exception):
    """A refusal with the status that a server would answer."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


@dataclass
class Service:
    """Requests and answers of the usual embeddings, search and rerank addresses, as plain functions without a server."""

    encoder: Encoder
    spark: SparkSession
    corpus: Corpus | None = None
    reranker: Reranker | None = None
    key: str | None = None
    writable: bool = False
    most_texts: int = 256
    longest: int = 32_768
    most_k: int = 100
    model: str = "default"

    def authorise(self, header: str | None) -> None:
        import hmac

        kind, _, token = (header or "").partition(" ")
        if self.key is not None and not (kind.lower() == "bearer" and hmac.compare_digest(token.encode(), self.key.encode())):
            raise RequestError(401, "a valid key is needed")

    def _texts(self, texts: list[str]) -> list[str]:
        if not texts:
            raise RequestError(422, "there is no input")
        if len(texts) > self.most_texts or max(map(len, texts)) > self.longest:
            raise RequestError(413, f"at most {self.most_texts} inputs of {self.longest} characters")
        return texts

    def _corpus(self, write: bool = False) -> Corpus:
        if write and not self.writable:
            raise RequestError(403, "writing is off")
        if self.corpus is None:
            raise RequestError(404, "there is no index")
        return self.corpus

    def health(self) -> dict:
        return {"status": "ok", "model": self.model, "dim": self.encoder.output_dim or self.encoder.native_dim, "documents": None if self.corpus is None else len(self.corpus), "reranker": getattr(self.reranker, "name", None)}

    def models(self) -> dict:
        return {"object": "list", "data": [{"id": self.model, "object": "model", "owned_by": __package__.partition(".")[0]}]}

    def embeddings(self, input, encoding_format: str = "float", dimensions: int | None = None, input_type: str = "document", instruction: str | None = None) -> dict:  # noqa: A002
        from relevance_spark.functions.text import usage
        from relevance_spark.operators.encoders import as_base64

        texts = self._texts([input] if isinstance(input, str) else list(input))
        if dimensions is not None and not 1 <= dimensions <= self.encoder.native_dim:
            raise RequestError(422, f"dimensions are 1 to {self.encoder.native_dim}")
        if encoding_format not in ("float", "base64") or input_type not in ("query", "document"):
            raise RequestError(422, "unknown format or kind of input")
        rows = asked(self.spark, texts).withColumn("v", self.encoder.vectors(F.col("text"), input_type, None if instruction is None else F.lit(instruction), dimensions))
        rows = rows.withColumn("v", as_base64(F.col("v"))) if encoding_format == "base64" else rows
        found = rows.select(F.col("query_id").cast("int").alias("i"), "v", usage(F.col("text")).alias("u")).orderBy("i").collect()
        total = sum(r.u for r in found)
        return {"object": "list", "data": [{"object": "embedding", "index": r.i, "embedding": r.v} for r in found], "model": self.model, "usage": {"prompt_tokens": total, "total_tokens": total}}

    def search(self, query: str, k: int = 5, filter: dict | None = None, instruction: str | None = None, rerank: bool | None = None) -> dict:  # noqa: A002
        found = self._corpus()
        if not query or not 1 <= k <= self.most_k:
            raise RequestError(422, f"a query, and k from 1 to {self.most_k}")
        self._texts([query])
        if rerank and found.reranker is None:
            raise RequestError(422, "there is no reranker")
        rows = found.search([query], k, filter, rerank=rerank, instruction=instruction).orderBy("rank").collect()
        return {"object": "list", "data": [{"id": r.id, "score": r.score, "text": r.text, "metadata": r.metadata} for r in rows]}

    def add_documents(self, texts: list[str], ids: list[str] | None = None, metadata: list[dict] | None = None) -> dict:
        found = self._corpus(write=True)
        try:
            new = found.add(self._texts(texts), metadata, ids)
        except ValueError as e:
            raise RequestError(422, str(e)) from e
        return {"ids": new, "count": len(found)}

    def delete_documents(self, ids: list[str]) -> dict:
        found = self._corpus(write=True)
        if not 1 <= len(ids) <= 10_000:
            raise RequestError(422, "1 to 10000 ids")
        return {"deleted": found.delete(ids), "count": len(found)}

    def rerank(self, query: str, documents: list[str], top_n: int | None = None) -> dict:
        if self.reranker is None:
            raise RequestError(404, "there is no reranker")
        if top_n is not None and top_n < 1:
            raise RequestError(422, "top_n is at least 1")
        return {"model": self.reranker.name, "results": self.reranker.ranked_documents(self.spark, query, self._texts(documents), top_n)}
