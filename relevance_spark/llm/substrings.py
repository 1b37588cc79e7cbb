"""Removal of repeated passages: windows of consecutive words whose sequence starts anywhere else as well.

Anchors are the hashes of shorter windows at those positions of a text that a difference cover holds modulo its
period. Two equal long windows at any two places share an anchor at the same distance from their starts, because for
every difference of places the cover has two elements that differ by it. Anchors seen twice mark where long windows
may repeat; only these are hashed whole (128 bits) and compared, which extends a match word by word in both
directions. Texts are dealt out once and read from there three times.

Null and short texts have no windows and lose nothing; repeated rows repeat each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevance_spark.llm import arrays, blocks
from relevance_spark.llm.arrays import U

#: Perfect difference sets: every residue is the difference of two elements. Fixed values.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
_SECOND = U(0xC2B2AE3D27D4EB4F)


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of at least a third of the window."""
    fit = [p for p in COVERS if window - p + 1 >= max(4, window // 3)]
    return (max(fit), COVERS[max(fit)]) if fit else (1, (0,))


def word_starts(offsets: np.ndarray, width: int) -> np.ndarray:
    """Positions, over the words of all texts, where a window of width words lies within one text."""
    return arrays.ragged(offsets[:-1], np.maximum(np.diff(offsets) - width + 1, 0))


def anchors(h: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors."""
    period, cover = cover_for(window)
    width = window - period + 1
    long_enough = np.diff(offsets) >= window
    starts = arrays.ragged(offsets[:-1], np.where(long_enough, np.diff(offsets) - width + 1, 0))
    first = np.repeat(offsets[:-1], np.where(long_enough, np.diff(offsets) - width + 1, 0))
    on = np.zeros(period, bool)
    on[list(cover)] = True
    at = starts[on[(starts - first) % period]]
    return at, (arrays.window_hashes(h, width)[at] if len(at) else np.empty(0, U))


def _at_most_twice(sorted_values: np.ndarray) -> np.ndarray:
    start, size = arrays.runs(sorted_values)
    return np.repeat(sorted_values[start], np.minimum(size, 2))


_TYPES = [pa.int64(), pa.int64(), pa.binary()]


def _anchor_rows(window: int, n: int):
    def run(batches):
        # What leaves a slice of a block is distinct within it.
        for batch in arrays.pieces(batches, 8_000_000):
            if not batch.num_rows:
                continue
            block = batch.column("block").to_numpy()
            h, off = arrays.hash_words(arrays.encode_texts(batch.column("text")), fold=False)
            at, a = anchors(h, off, window)
            owner = block[np.searchsorted(off, at, side="right") - 1]
            out = []
            for k in np.unique(block):
                mine = _at_most_twice(np.sort(a[owner == k]))
                out += [(b, int(k), mine[i:j].tobytes()) for b, i, j in blocks.by_bucket(mine, n)]
            yield from blocks.rows(["bucket", "block", "h"], _TYPES, out).to_batches()

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Of one bucket: for each block the hashes it sent that were sent twice or more in all."""
    parts = [np.frombuffer(x, U) for x in table.column("h").to_pylist()]
    every = np.sort(np.concatenate(parts))
    start, size = arrays.runs(every)
    twice = every[start[size > 1]]
    out = []
    for k, p in zip(table.column("block").to_pylist(), parts, strict=True):
        hit = np.unique(p[arrays.contains(twice, p)])
        if len(hit):
            out.append((k, hit.tobytes()))
    return blocks.rows(["block", "h"], _TYPES[1:], out)


def _joined(table: pa.Table, dtype) -> np.ndarray:
    parts = [np.frombuffer(x, dtype) for x in table.column("h").to_pylist()]
    return np.sort(np.concatenate(parts)) if parts else np.empty(0, dtype)


#: A window's hash: two words of 64 bits, compared in that order.
PAIR = np.dtype([("x", U), ("y", U)])


def _pairs(h: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return arrays.window_hashes(h, window)[at], arrays.window_hashes(h, window, _SECOND)[at]


def _window_rows(window: int, n: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            period, _ = cover_for(window)
            block = left.column("block")[0].as_py()
            h, off = arrays.hash_words(arrays.encode_texts(left.column("text").combine_chunks()), fold=False)
            at, a = anchors(h, off, window)
            at = at[arrays.contains(_joined(right, U), a)]
            # Every long window that holds a repeated anchor starts up to period - 1 words before it.
            mark = np.zeros(len(h) + 1, np.int64)
            np.add.at(mark, np.maximum(at - period + 1, 0), 1)
            np.add.at(mark, at + 1, -1)
            starts = word_starts(off, window)
            starts = starts[np.cumsum(mark)[starts] > 0]
            x, y = _pairs(h, starts, window)
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            same = np.zeros(len(x), bool)
            same[1:] = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
            third = same.copy()
            third[1:] &= same[:-1]
            both = np.empty(len(x) - int(third.sum()), PAIR)
            both["x"], both["y"] = x[~third], y[~third]
            out = [(b, block, both[i:j].tobytes()) for b, i, j in blocks.by_bucket(both["x"], n)]
        return blocks.rows(["bucket", "block", "h"], _TYPES, out)

    return run


def _repeated_pairs(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, PAIR) for x in table.column("h").to_pylist()]
    every = np.concatenate(parts)
    owner = np.repeat(np.array(table.column("block").to_pylist()), [len(p) for p in parts])
    order = np.lexsort((every["y"], every["x"]))
    every, owner = every[order], owner[order]
    same = np.zeros(len(every) + 1, bool)
    same[1:-1] = (every["x"][1:] == every["x"][:-1]) & (every["y"][1:] == every["y"][:-1])
    twice = same[1:] | same[:-1]
    every, owner = every[twice], owner[twice]
    order = np.argsort(owner, kind="stable")
    every, owner = every[order], owner[order]
    start, size = arrays.runs(owner)
    return blocks.rows(["block", "h"], _TYPES[1:], [(int(owner[a]), every[a : a + m].tobytes()) for a, m in zip(start, size, strict=True)])


def _removed(h: np.ndarray, off: np.ndarray, repeated: np.ndarray, window: int) -> np.ndarray:
    """Which words a repeated window covers."""
    starts = word_starts(off, window)
    mark = np.zeros(len(h) + 1, np.int64)
    if len(repeated) and len(starts):
        x, y = _pairs(h, starts, window)
        order = np.lexsort((repeated["y"], repeated["x"]))
        rx, ry = repeated["x"][order], repeated["y"][order]
        at = np.searchsorted(rx, x)
        at[at == len(rx)] = 0
        hit = (rx[at] == x) & (ry[at] == y)
        np.add.at(mark, starts[hit], 1)
        np.add.at(mark, starts[hit] + window, -1)
    return np.cumsum(mark)[:-1] > 0


def _kept_rows(window: int, with_text: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * with_text
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in types], names)
        texts = arrays.encode_texts(left.column("text").combine_chunks())
        h, off = arrays.hash_words(texts, fold=False)
        gone = _removed(h, off, np.concatenate([np.frombuffer(x, PAIR) for x in right.column("h").to_pylist()]) if right.num_rows else np.empty(0, PAIR), window)
        lost = np.concatenate(([0], np.cumsum(gone)))
        out = []
        for i, (doc_id, text) in enumerate(zip(left.column("doc_id").to_pylist(), texts, strict=True)):
            words, a, b = text.split(), off[i], off[i + 1]
            n = int(lost[b] - lost[a])
            if n:
                words = [w for w, g in zip(words, gone[a:b].tolist(), strict=True) if not g]
            kept = b" ".join(words)
            out.append((doc_id, int(b - a), n, hashlib.sha256(kept).hexdigest(), *[kept.decode()] * with_text))
        return blocks.rows(names, types, out)

    return run


def without_repeats(docs: DataFrame, window: int = 35, with_text: bool = False) -> DataFrame:
    """(doc_id, text) to (doc_id, n_words, n_removed, kept_sha256[, kept_text]), one row per row of docs."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = blocks.n_blocks(texts)
    dealt = blocks.in_blocks(texts, n)
    sent = dealt.mapInArrow(_anchor_rows(window, n), "bucket long, block long, h binary")
    repeated = sent.groupBy("bucket").applyInArrow(_repeated, "block long, h binary")
    windows = dealt.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(_window_rows(window, n), "bucket long, block long, h binary")
    answers = windows.groupBy("bucket").applyInArrow(_repeated_pairs, "block long, h binary")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_kept_rows(window, with_text), schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs)


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM twice, range(0, 35) t(o)),
kept AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) ANTI JOIN gone USING (doc_id, i)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM kept GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
