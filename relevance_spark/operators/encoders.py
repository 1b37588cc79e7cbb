"""Text encoders as Arrow functions: feature hashing, given vectors, remote services, and a registry of names."""

from __future__ import annotations

import base64
import fnmatch
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relevance_spark.functions import vectors as V
from relevance_spark.functions.text import prompt, tokens, word_ngrams
from relevance_spark.registry import Registry

#: What a word is.
WORDS = re.compile(r"\w+")


@dataclass
class Encoder:
    """What every encoder has; ``_encode`` runs in workers on lists of texts."""

    native_dim: int = 0
    query_template: str = "{text}"
    document_template: str = "{text}"
    output_dim: int | None = None
    normalize: bool = True

    def _encode(self, texts: list[str]) -> np.ndarray:
        raise NotImplementedError

    def formatted(self, text: Column, kind: str, instruction: Column | None = None) -> Column:
        return prompt(self.query_template if kind == "query" else self.document_template, text, instruction)

    def vectors(self, text: Column, kind: str = "document", instruction: Column | None = None, dim: int | None = None) -> Column:
        """An array<float> column: checked, cut to dim, of unit length."""
        own, size = self, dim or self.output_dim

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                out = np.asarray(own._encode(list(texts)), np.float32)
                if out.shape != (len(texts), own.native_dim) or not np.isfinite(out).all():
                    raise ValueError("an encoder returned a wrong shape or numbers that are not finite")
                out = out[:, :size] if size else out
                if own.normalize:
                    out = out / np.maximum(np.linalg.norm(out.astype(float), axis=1, keepdims=True), V.FLOOR)
                yield pd.Series(list(out.astype(np.float32)))

        return run(self.formatted(text, kind, instruction))

    def fingerprint(self) -> str:
        return "v2:" + hashlib.sha256(json.dumps({"class": type(self).__name__} | self.__dict__, sort_keys=True, default=str).encode()).hexdigest()


def hashed_places(features: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of each feature: of its eight-byte BLAKE2b digest, read as little-endian, the low half modulo dim
    is the bucket, and the next bit tells the sign."""
    digests = np.frombuffer(b"".join([hashlib.blake2b(f.encode(), digest_size=8).digest() for f in features]), "<u8")
    return (digests & 0xFFFFFFFF).astype(np.int64) % dim, np.where(digests >> np.uint64(32) & np.uint64(1), 1.0, -1.0)


def windows(items, n: int):
    """All runs of n neighbours, as n copies that are shifted against one another."""
    return zip(*(items[i:] for i in range(n)), strict=False)


#: Words that are hashed at once, and distinct words whose features are kept from one batch to the next.
AT_ONCE, KEPT_WORDS = 50_000, 60_000


@dataclass
class HashingEncoder(Encoder):
    """Signed feature hashing of word n-grams (weight 1) and n-grams of characters of words in angle brackets (weight 0.5).

    Words go through in pieces of a fixed number, whatever the texts' sizes: a long text is in several, each with the
    words before it that its n-grams begin with. All weights are halves, so the order of the sums does not matter.
    """

    native_dim: int = 256
    words: tuple[int, int] = (1, 2)
    characters: tuple[int, int] | None = (3, 5)

    def _word_parts(self, word: str) -> list[str]:
        sizes = range(self.characters[0], self.characters[1] + 1) if self.characters else ()
        whole = f"<{word}>"
        return ["c:" + whole[i : i + n] for n in sizes for i in range(len(whole) - n + 1)]

    def _pieces(self, texts: list[str]) -> Iterator[list[tuple[int, list[str], list[str]]]]:
        """Lists of (row, words before, words) with AT_ONCE words at most."""
        piece, left, back = [], AT_ONCE, self.words[1] - 1
        for row, text in enumerate(texts):
            found, before = (m.group() for m in WORDS.finditer((text or "").lower())), []
            while words := list(islice(found, left)):
                piece.append((row, before, words))
                left -= len(words)
                before = (before + words)[-back:] if back > 0 else []
                if not left:
                    yield piece
                    piece, left = [], AT_ONCE
        if piece:
            yield piece

    def _encode(self, texts: list[str]) -> np.ndarray:
        out, parts = np.zeros((len(texts), self.native_dim)), {}
        flat = out.reshape(-1)
        sizes = range(self.words[0], self.words[1] + 1)
        for piece in self._pieces(texts):
            grams = [[" ".join(g) for n in sizes for g in windows([*before[len(before) - n + 1 :], *words] if n > 1 else words, n)] for _, before, words in piece]
            rows = np.array([row for row, *_ in piece])
            codes, distinct = pd.factorize(np.array(list(chain.from_iterable(grams)), dtype=object))
            if len(distinct):
                bucket, weight = hashed_places(["w:" + g for g in distinct], self.native_dim)
                at = np.repeat(rows, list(map(len, grams))) * self.native_dim + bucket[codes]
                np.add.at(flat, at, weight[codes])
            if self.characters:
                if len(parts) > KEPT_WORDS:
                    parts.clear()
                codes, distinct = pd.factorize(np.array(list(chain.from_iterable(words for *_, words in piece)), dtype=object))
                new = {w: self._word_parts(w) for w in distinct if w not in parts}
                if new:
                    known, features = pd.factorize(np.array(list(chain.from_iterable(new.values())), dtype=object))
                    bucket, sign = hashed_places(features, self.native_dim)
                    at = 0
                    for w, p in new.items():
                        own = known[at : (at := at + len(p))]
                        parts[w] = bucket[own], sign[own] * 0.5
                # Each word of a row once, with the number of its occurrences.
                pairs, times = np.unique(np.repeat(rows, [len(words) for *_, words in piece]) * len(distinct) + codes, return_counts=True)
                row, code = np.divmod(pairs, len(distinct))
                own = [parts[w] for w in distinct]
                long = np.array([len(b) for b, _ in own])
                ends = np.cumsum(long)
                each = long[code]
                place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat((ends - long)[code], each)
                bucket, weight = (np.concatenate(x) for x in zip(*own, strict=True))
                np.add.at(flat, np.repeat(row * self.native_dim, each) + bucket[place], weight[place] * np.repeat(times, each))
        return np.sign(out) * np.log1p(np.abs(out))


@dataclass
class PrecomputedEncoder(Encoder):
    """Vectors given for texts beforehand; an unknown text is an error."""

    table: dict = field(default_factory=dict, repr=False)

    def _encode(self, texts: list[str]) -> np.ndarray:
        missing = [t for t in texts if t not in self.table]
        if missing:
            raise KeyError(f"no vector is given for {missing[0]!r}")
        return np.array([self.table[t] for t in texts], float).reshape(len(texts), -1)


def sql_hash_vectors(docs: DataFrame, dim: int = 64) -> DataFrame:
    """(id, text) to (id, bucket, value) in SQL alone: unigrams and bigrams, hashed by SHA-256; for checks in any engine."""
    words = docs.select("id", tokens(F.col("text")).alias("w"))
    grams = words.select("id", F.explode(F.concat("w", word_ngrams(F.col("w"), 2))).alias("g")).withColumn("h", F.sha2(F.concat(F.lit("w:"), "g"), 256))
    number = lambda a, n: F.conv(F.substring("h", a, n), 16, 10).cast("long")
    sign = F.when(number(9, 1) % 2 == 1, 1.0).otherwise(-1.0)
    sums = grams.groupBy("id", (number(1, 8) % dim).cast("int").alias("bucket")).agg(F.sum(sign).alias("s"))
    return sums.where("s <> 0").select("id", "bucket", (F.signum("s") * F.log1p(F.abs("s"))).alias("value"))


class Refused(Exception):
    """A service sent the request elsewhere; the key stays here."""


def _post(url: str, body: bytes, headers: dict, timeout: float):
    """One request that follows no redirect."""
    import urllib.request

    class Stay(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, req, fp, code, msg, hdrs, newurl):
            raise Refused(f"the service redirects ({code})")

    with urllib.request.build_opener(Stay).open(urllib.request.Request(url, body, headers), timeout=timeout) as r:
        return json.load(r)


@dataclass
class RemoteEncoder(Encoder):
    """An embeddings service with the common JSON request; the key is read in the workers' environment only.

    Busy and failing answers (408, 409, 429, 5xx) are asked again after what Retry-After says, or ever longer.
    """

    url: str = ""
    model: str = ""
    key_variable: str = "EMBEDDINGS_API_KEY"
    retries: int = 4
    batch: int = 128
    timeout: float = 60.0
    send: Callable | None = field(default=None, repr=False)
    pause: Callable | None = field(default=None, repr=False)

    def _ask(self, texts: list[str]) -> list:
        import os
        import time
        import urllib.error

        body = json.dumps({"model": self.model, "input": texts, "encoding_format": "float"}).encode()
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(self.key_variable, '')}"}
        for attempt in range(self.retries + 1):
            try:
                answer = self.send(body) if self.send else _post(self.url, body, headers, self.timeout)
                break
            except urllib.error.HTTPError as e:
                if attempt == self.retries or not (e.code in (408, 409, 429) or e.code >= 500):
                    raise
                told = (e.headers or {}).get("Retry-After", "")
                (self.pause or time.sleep)(min(30.0, float(told) if told.replace(".", "", 1).isdigit() else 2.0**attempt))
        rows = sorted(answer["data"], key=lambda x: x["index"])
        if [x["index"] for x in rows] != list(range(len(texts))):
            raise ValueError("the service did not answer every text once")
        found = [x["embedding"] for x in rows]
        if {len(x) for x in found} != {self.native_dim}:
            raise ValueError(f"the service answered vectors that are not of {self.native_dim} numbers")
        return found

    def _encode(self, texts: list[str]) -> np.ndarray:
        return np.array([v for at in range(0, len(texts), self.batch) for v in self._ask(texts[at : at + self.batch])], float).reshape(len(texts), -1)


def as_base64(v: Column) -> Column:
    """Little-endian float32 bytes in base64, a whole batch of equal lengths from one buffer."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        sizes = s.map(len).to_numpy()
        data = memoryview(np.concatenate(s.to_list()).astype("<f4").tobytes()) if len(s) else b""
        ends = np.cumsum(sizes) * 4
        return pd.Series([base64.b64encode(data[e - 4 * n : e]).decode() for n, e in zip(sizes, ends, strict=True)], dtype=object)

    return run(v)


ENCODERS = Registry("encoder", hashing=HashingEncoder, precomputed=PrecomputedEncoder, remote=RemoteEncoder)
ENCODERS.alias("openai", "remote")


def load_encoder(spec: str | dict | Encoder) -> Encoder:
    """An encoder, its name, or a dictionary of ``type`` and options."""
    if isinstance(spec, Encoder):
        return spec
    spec = {"type": spec} if isinstance(spec, str) else dict(spec)
    return ENCODERS.get(spec.pop("type"))(**spec)


def first_match(name: str, patterns: list[tuple[str, object]]):
    """The first preset whose glob fits the name, without regard to case."""
    return next((p for glob, p in patterns if fnmatch.fnmatchcase(name.lower(), glob.lower())), None)


#: Presets by glob, in order: templates and pooling of model families. Fixed values.
PRESETS = [
    ("*qwen3-embedding*", {"query_template": "Instruct: {instruction}\nQuery:{text}", "pooling": "last"}),
    ("*e5-mistral*", {"query_template": "Instruct: {instruction}\nQuery: {text}", "pooling": "last"}),
    ("*e5-*", {"query_template": "query: {text}", "document_template": "passage: {text}", "pooling": "mean"}),
    ("*bge-*-en*", {"query_template": "Represent this sentence for searching relevant passages: {text}", "pooling": "first"}),
    ("*", {"pooling": "mean"}),
]


def preset_of(name: str, checkpoint: dict | None = None) -> dict:
    """The first preset whose glob fits; what a checkpoint says of itself comes first."""
    return first_match(name, PRESETS) | (checkpoint or {})


def same_encoder(meta: dict, encoder: Encoder, rows: int) -> None:
    """Refuse to write vectors of another encoder beside those that are there."""
    if rows and meta.get("fingerprint") != encoder.fingerprint():
        raise ValueError("the vectors that are there were made by another encoder")
