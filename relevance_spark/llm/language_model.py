"""Interpolated modified Kneser-Ney bigram model, counted over all training texts.

Blocks of documents count their distinct word pairs; pairs meet in buckets that are ranges of the first word's hash. The
pairs of a first word so frequent that it would fill a bucket (the begin of a text, an article) are dealt over several by
their second word; which words these are is read off a sample, and decides nothing but where pairs meet. A second
exchange adds up, for each word, its count, what follows it and how many different words precede it. The model is one set
of sorted hash arrays per bucket in the shared folder; workers map them and look up the sorted distinct pairs of a
batch. What is counted grows with the corpus; only the totals, the discounts, a bit per bucket and file, and at most
MOST_HOT frequent words come to the driver.

p(w | v) = (c(vw) - D(c)) / c(v) + g(v) p(w),  p(w) = (m(w) - D'(m)) / M + g' / (V + 1)

c: counts, m: different predecessors, M their sum, V: distinct tokens; an unseen v leaves p(w), an unseen w the last
term. A text is its words and one end; the begin of a text precedes its first token and is never predicted.
Null and empty texts are one end. Hashes have 64 bits for first words and 48 for second ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevance_spark.llm import arrays, blocks, files
from relevance_spark.llm.arrays import U
from relevance_spark.llm.shared import Workspace

#: A first word with more than this share of a bucket's pairs is dealt over several; at most so many words are.
HOT, MOST_HOT = 0.5, 4096
BEGIN, END = U(0x1B873593CC9E2D51), U(0x2545F4914F6CDD1D)
#: Hash ranges of the model; each has a few arrays.
_LOW48 = U((1 << 48) - 1)
#: What each word's row holds: tokens; predecessors; tokens that follow; followers seen once, twice, more often.
STATS = np.dtype([("h", U), ("c", np.int64), ("m", np.int64), ("out", np.int64), ("f1", np.int32), ("f2", np.int32), ("f3", np.int32)])
PAIRS = np.dtype([("a", U), ("b", U), ("n", np.uint32)])


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Previous token, token, and offsets: each text's words and its end."""
    h, off = arrays.hash_words(texts, fold=True)
    n = np.diff(off) + 1
    ends = np.cumsum(n)
    tok = np.full(int(ends[-1]) if len(ends) else 0, END, U)
    inner = np.ones(len(tok), bool)
    inner[ends - 1] = False
    tok[inner] = h
    prev = np.empty_like(tok)
    prev[1:] = tok[:-1]
    prev[ends - n] = BEGIN
    return prev, tok, np.concatenate(([0], ends))


def distinct_pairs(prev: np.ndarray, tok: np.ndarray) -> np.ndarray:
    """Sorted distinct pairs with counts."""
    va, ia = np.unique(prev, return_inverse=True)
    vb, ib = np.unique(tok & _LOW48, return_inverse=True)
    key, n = np.unique((ia.astype(U) << U(32)) | ib.astype(U), return_counts=True)
    out = np.empty(len(key), PAIRS)
    out["a"], out["b"], out["n"] = va[(key >> U(32)).astype(np.int64)], vb[(key & U(0xFFFFFFFF)).astype(np.int64)], n
    return out


def pack(pairs: np.ndarray) -> bytes:
    """First words once each with their number of followers, followers in six bytes, counts in one (255: four more follow at the end)."""
    start, size = arrays.runs(pairs["a"])
    small = np.minimum(pairs["n"], 255).astype(np.uint8)
    big = pairs["n"][pairs["n"] >= 255]
    six = np.ascontiguousarray(pairs["b"]).view(np.uint8).reshape(-1, 8)[:, :6]
    head = np.array([len(start), len(pairs)], np.int64)
    return b"".join(x.tobytes() for x in (head, pairs["a"][start], size.astype(np.uint32), six, small, big))


def unpack(data: bytes) -> np.ndarray:
    n, m = np.frombuffer(data, np.int64, 2)
    a = np.frombuffer(data, U, n, 16)
    size = np.frombuffer(data, np.uint32, n, 16 + 8 * n)
    at = 16 + 12 * n
    six = np.zeros((m, 8), np.uint8)
    six[:, :6] = np.frombuffer(data, np.uint8, 6 * m, at).reshape(-1, 6)
    small = np.frombuffer(data, np.uint8, m, at + 6 * m).astype(np.uint32)
    big = small == 255
    small[big] = np.frombuffer(data, np.uint32, int(big.sum()), at + 7 * m)
    out = np.empty(m, PAIRS)
    out["a"], out["b"], out["n"] = np.repeat(a, size), six.view(U).ravel(), small
    return out


def merged(parts: list[np.ndarray]) -> np.ndarray:
    """Pairs of several blocks added up."""
    every = np.concatenate(parts)
    va, ia = np.unique(every["a"], return_inverse=True)
    vb, ib = np.unique(every["b"], return_inverse=True)
    key = (ia.astype(U) << U(32)) | ib.astype(U)
    order = np.argsort(key)
    start, _ = arrays.runs(key[order])
    key = key[order][start]
    out = np.empty(len(key), PAIRS)
    out["a"], out["b"], out["n"] = va[(key >> U(32)).astype(np.int64)], vb[(key & U(0xFFFFFFFF)).astype(np.int64)], np.add.reduceat(every["n"][order].astype(np.int64), start) if len(start) else 0
    return out


#: Bytes of text that are counted together, and that are scored together; memory is some thirty times that.
COUNTED, SCORED = 12_000_000, 3_500_000


def _gathered(batches):
    """Texts of several batches at a time."""
    out, size = [], 0
    for batch in arrays.pieces(batches, 2_000_000):
        texts = arrays.encode_texts(batch.column("text"))
        out += texts
        size += sum(map(len, texts))
        if size > COUNTED:
            yield out
            out, size = [], 0
    if out:
        yield out


def frequent_first_words(texts: DataFrame, n: int) -> np.ndarray:
    """Sorted hashes of first words with more than HOT of a bucket's share of pairs, and how many buckets each is dealt over.

    From a sample of about one block. Counts only steer where pairs meet.
    """

    def seen(batches):
        for batch in arrays.pieces(batches, 2_000_000):
            h, c = np.unique(tokens(arrays.encode_texts(batch.column("text")))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c, pa.int64())], ["h", "c"])

    counts = texts.sample(1.0 / n, seed=5).select(F.col("text").cast("string")).mapInArrow(seen, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    share = F.col("c") / F.col("total")
    found = counts.join(F.broadcast(counts.agg(F.sum("c").alias("total")))).where(share * n > HOT).orderBy(F.col("c").desc(), "h").limit(MOST_HOT).select("h", F.least(F.lit(n), F.ceil(2 * share * n)).cast("long").alias("parts")).collect()
    out = np.empty(len(found), [("h", U), ("parts", np.int64)])
    out["h"], out["parts"] = np.array([r.h for r in found], np.int64).view(U), [r.parts for r in found]
    return np.sort(out, order="h")


def pair_buckets(a: np.ndarray, b: np.ndarray, n: int, hot: np.ndarray) -> np.ndarray:
    """Where a pair is counted: the range of its first word, or one of several after it for a frequent one."""
    out = blocks.bucket_of(a, n)
    if len(hot) and len(a):
        at = np.minimum(np.searchsorted(hot["h"], a), len(hot) - 1)
        parts = np.where(hot["h"][at] == a, hot["parts"][at], 1)
        out = (out + (arrays.mix(b & _LOW48) >> U(33)).astype(np.int64) % parts) % n
    return out


def _count(n: int, hot: np.ndarray):
    def run(batches):
        for texts in _gathered(batches):
            prev, tok, _ = tokens(texts)
            pairs = distinct_pairs(prev, tok)
            bucket = pair_buckets(pairs["a"], pairs["b"], n, hot)
            order = np.argsort(bucket, kind="stable")
            out = [(b, pack(pairs[order[i:j]])) for b, i, j in blocks.in_runs(bucket[order])]
            # Tokens as such, for their full hashes and counts.
            h, c = np.unique(tok, return_counts=True)
            words = np.empty(len(h), [("h", U), ("c", np.int64)])
            words["h"], words["c"] = h, c
            out += [(b + n, words[i:j].tobytes()) for b, i, j in blocks.by_bucket(h, n)]
            yield from blocks.rows(["bucket", "data"], [pa.int64(), pa.binary()], out).to_batches()

    return run


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of a pair, for the sorted array that is searched; 48 bits of the second word tell it apart."""
    return arrays.mix(a * U(0x9E3779B97F4A7C15) + (b & _LOW48))


def _reduce(n: int, uri: str):
    """A bucket of pairs becomes files and rows of predecessors; a bucket of tokens is added up."""

    def run(key, table):
        bucket = key[0].as_py()
        data = table.column("data").to_pylist()
        if bucket >= n:
            every = np.concatenate([np.frombuffer(x, [("h", U), ("c", np.int64)]) for x in data])
            order = np.argsort(every["h"])
            start, _ = arrays.runs(every["h"][order])
            out = np.empty(len(start), [("h", U), ("c", np.int64)])
            out["h"], out["c"] = every["h"][order][start], np.add.reduceat(every["c"][order], start)
            return blocks.rows(["bucket", "kind", "data", "n1", "n2", "n3", "n4"], _REDUCED, [(bucket - n, "tokens", out.tobytes(), 0, 0, 0, 0)])
        pairs = merged([unpack(x) for x in data])
        k = _key(pairs["a"], pairs["b"])
        order = np.argsort(k)
        files.write_array(uri, f"pair-{bucket:05d}", k[order])
        files.write_array(uri, f"count-{bucket:05d}", pairs["n"][order])
        start, size = arrays.runs(pairs["a"])
        stats = np.zeros(len(start), STATS)
        stats["h"] = pairs["a"][start]
        for name, x in (("out", pairs["n"]), ("f1", pairs["n"] == 1), ("f2", pairs["n"] == 2), ("f3", pairs["n"] > 2)):
            stats[name] = np.add.reduceat(x.astype(np.int64), start) if len(start) else 0
        out = [(bucket, "pairs", b"", *[int((pairs["n"] == i).sum()) for i in (1, 2, 3, 4)])]
        # What follows a frequent word is known in parts, which meet in the range of its hash.
        out += [(b, "context", stats[i:j].tobytes(), 0, 0, 0, 0) for b, i, j in blocks.by_bucket(stats["h"], n)]
        # Different predecessors of each follower within this bucket; 48 bits of a hash order as the bits do, so a range
        # of the lower bits deals them out.
        h, m = np.unique(pairs["b"], return_counts=True)
        six = np.empty(len(h), [("h", U), ("m", np.uint32)])
        six["h"], six["m"] = h, m
        out += [(b, "before", six[i:j].tobytes(), 0, 0, 0, 0) for b, i, j in blocks.by_bucket(h << U(16), n)]
        return blocks.rows(["bucket", "kind", "data", "n1", "n2", "n3", "n4"], _REDUCED, out)

    return run


_REDUCED = [pa.int64(), pa.string(), pa.binary(), *[pa.int64()] * 4]


def _low_order(uri: str):
    """Predecessors of the followers in one range of their lower 48 bits, as a file; and their counts of counts."""

    def run(key, table):
        every = np.concatenate([np.frombuffer(x, [("h", U), ("m", np.uint32)]) for x in table.column("data").to_pylist()])
        order = np.argsort(every["h"])
        start, _ = arrays.runs(every["h"][order])
        m = np.add.reduceat(every["m"][order].astype(np.int64), start)
        bucket = key[0].as_py()
        files.write_array(uri, f"low-{bucket:05d}", every["h"][order][start])
        files.write_array(uri, f"before-{bucket:05d}", m)
        return pa.table({"tokens": [0], "words": [0], "m": [int(m.sum())]} | {f"n{i}": [int((m == i).sum())] for i in (1, 2, 3, 4)})

    return run


def _store(uri: str):
    """Token counts and what follows each word, as files."""

    def run(key, table):
        bucket, n, follow = key[0].as_py(), [0, 0], []
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
            if kind == "tokens":
                x = np.frombuffer(data, [("h", U), ("c", np.int64)])
                files.write_array(uri, f"word-{bucket:05d}", x["h"])
                files.write_array(uri, f"tokens-{bucket:05d}", x["c"])
                n = [int(x["c"].sum()), len(x)]
            else:
                follow.append(np.frombuffer(data, STATS))
        if follow:
            every = np.concatenate(follow)
            h, inverse = np.unique(every["h"], return_inverse=True)
            stats = np.zeros(len(h), STATS)
            stats["h"] = h
            for name in ("out", "f1", "f2", "f3"):
                np.add.at(stats[name], inverse, every[name])
            files.write_array(uri, f"context-{bucket:05d}", h)
            files.write_array(uri, f"stats-{bucket:05d}", stats)
        return pa.table({"tokens": [n[0]], "words": [n[1]], "m": [0], "n1": [0], "n2": [0], "n3": [0], "n4": [0]})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; 0.5 each where these are too few."""
    if min(n1, n2, n3) == 0:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    out = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.01), k - 0.01) for k, d in enumerate(out, 1))


def _present(rows: DataFrame, kind: str, n: int) -> np.ndarray:
    """Which of n buckets have rows of a kind: a bit each."""
    words = rows.where(F.col("kind") == kind).select(F.floor(F.col("bucket") / 32).alias("w"), F.expr("shiftleft(1L, cast(bucket % 32 as int))").alias("bit"))
    out = np.zeros(n, bool)
    for r in words.groupBy("w").agg(F.bit_or("bit").alias("bits")).collect():
        out[[32 * r.w + k for k in range(32) if r.bits >> k & 1]] = True
    return out


def train(texts: DataFrame, ws: Workspace) -> dict:
    """Count a table with a column ``text``; the returned model is a few numbers and the folder of its files."""
    n, uri = blocks.n_blocks(texts), f"{ws.uri}/model"
    hot = frequent_first_words(texts, n)
    counted = texts.select(F.col("text").cast("string")).mapInArrow(_count(n, hot), "bucket long, data binary")
    first = ws.save(counted.groupBy("bucket").applyInArrow(_reduce(n, uri), "bucket long, kind string, data binary, n1 long, n2 long, n3 long, n4 long"), "reduced")
    shape = "tokens long, words long, m long, n1 long, n2 long, n3 long, n4 long"
    high = first.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in (1, 2, 3, 4)]).first()
    low = first.where("kind = 'before'").select("bucket", "data").groupBy("bucket").applyInArrow(_low_order(uri), shape)
    low = low.agg(F.coalesce(F.sum("m"), F.lit(0)), *[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in (1, 2, 3, 4)]).first()
    totals = first.where("kind IN ('tokens', 'context')").select("bucket", "kind", "data").groupBy("bucket").applyInArrow(_store(uri), shape)
    totals = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    has = {name: _present(first, kind, n) for name, kind in (("pair", "pairs"), ("context", "context"), ("word", "tokens"), ("low", "before"))}
    ws.drop("reduced")
    return {"hot": hot, "has": has, "uri": uri, "n": n, "tokens": totals[0], "words": totals[1], "before": low[0], "high": discounts(*high), "low": discounts(*low[1:]), "low_n": tuple(low[1:])}


def _lookup(model: dict, name: str, value: str, dtype, h: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Values of sorted distinct hashes in the files of their ranges; 0 where a hash is absent."""
    out = np.zeros(len(h), dtype)
    for b, i, j in blocks.by_bucket(by, model["n"]):
        if model["has"][name][b]:
            keys = files.map_array(model["uri"], f"{name}-{b:05d}", U)
            at = np.searchsorted(keys, h[i:j])
            at[at == len(keys)] = 0
            hit = keys[at] == h[i:j]
            out[i:j][hit] = files.map_array(model["uri"], f"{value}-{b:05d}", dtype)[at[hit]]
    return out


def log_probabilities(model: dict, prev: np.ndarray, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 p(token | previous) and the training count of each token."""
    w, iw = np.unique(tok, return_inverse=True)
    count = _lookup(model, "word", "tokens", np.int64, w, w)
    low, il = np.unique(w & _LOW48, return_inverse=True)
    m = _lookup(model, "low", "before", np.int64, low, low << U(16))[il].astype(float)
    # Lowest order: predecessors, interpolated with an even share of the vocabulary and one unseen word.
    d = np.array([0.0, *model["low"]])
    even = 1.0 / (model["words"] + 1)
    n1, n2, n3, _ = model["low_n"]
    total = max(model["before"], 1)
    seen = model["words"]
    rest = (d[1] * n1 + d[2] * n2 + d[3] * max(seen - n1 - n2, 0)) / total if model["before"] else 1.0
    p_low = np.maximum(m - d[np.minimum(m, 3).astype(int)], 0) / total + rest * even
    # Contexts, then pairs, each distinct one once and in order of its hash.
    v, iv = np.unique(prev, return_inverse=True)
    stats = _lookup(model, "context", "stats", STATS, v, v)
    key, ik = np.unique((iv.astype(U) << U(32)) | iw.astype(U), return_inverse=True)
    pv, pw = (key >> U(32)).astype(np.int64), (key & U(0xFFFFFFFF)).astype(np.int64)
    c = np.zeros(len(key))
    q, bucket = _key(v[pv], w[pw]), pair_buckets(v[pv], w[pw], model["n"], model["hot"])
    order = np.lexsort((q, bucket))
    for b, i, j in blocks.in_runs(bucket[order]):
        if model["has"]["pair"][b]:
            keys, mine = files.map_array(model["uri"], f"pair-{b:05d}", U), order[i:j]
            at = np.searchsorted(keys, q[mine])
            at[at == len(keys)] = 0
            hit = keys[at] == q[mine]
            c[mine[hit]] = files.map_array(model["uri"], f"count-{b:05d}", np.uint32)[at[hit]]
    d = np.array([0.0, *model["high"]])
    s = stats[pv]
    out = np.maximum(s["out"], 1)
    back = np.where(s["out"] > 0, (d[1] * s["f1"] + d[2] * s["f2"] + d[3] * s["f3"]) / out, 1.0)
    p = np.maximum(c - d[np.minimum(c, 3).astype(int)], 0) / out * (s["out"] > 0) + back * p_low[pw]
    return np.log10(p)[ik], count[iw]


def _scorer(model: dict):
    def score(ids: list, texts: list[bytes]):
        prev, tok, off = tokens(texts)
        logs, count = log_probabilities(model, prev, tok)
        base = np.log10((count + 0.1) / (model["tokens"] + 0.1 * (model["words"] + 1)))
        first = off[:-1]
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()),
            pa.array(np.diff(off), pa.int64()),
            pa.array(np.add.reduceat((count > 0).astype(np.int64), first), pa.int64()),
            pa.array(np.add.reduceat(base, first)),
            pa.array(np.add.reduceat(logs, first)),
        ], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    def run(batches):
        for batch in arrays.pieces(batches, SCORED):
            if batch.num_rows:
                yield score(batch.column("doc_id").to_pylist(), arrays.encode_texts(batch.column("text")))

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, text) to (doc_id, n_tokens, n_known, base_score, score, perplexity)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.mapInArrow(_scorer(model), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


#: Residue classes of crc32(doc_id) that are not learned from.
FOLDS = 10


def held_out(folds: int = FOLDS):
    """Whether crc32 of the doc_id as text is divisible by folds; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(~held_out()).select("text"), Workspace(spark, "language-model"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
