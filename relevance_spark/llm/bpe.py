"""Token counts by byte-pair merging with a heap and a linked list.

The vocabulary is a public SentencePiece BPE model, given by its path on every worker (a parameter) or by its bytes.
Characters are the first symbols; a character outside the vocabulary counts as its UTF-8 bytes. The adjacent pair
whose joined piece has the lowest rank is merged first, the leftmost of equals; the count is symbols less merges, and
no identifiers are made. No piece holds a word start after another character, so every text falls apart, before each
first word start, into segments that never merge with one another; equal segments of a worker are merged once.
"""

from __future__ import annotations

import heapq
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevance_spark.llm import arrays

#: Where the vocabulary files of public tokenizers lie.
MODEL = "piece_bpe_32k.model"
#: SentencePiece writes a space as this character.
START = "▁"
#: Segments that a worker keeps the counts of.
KEPT = 1_000_000
LIMIT = 4096


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def ranks_of(path: str) -> dict[str, float]:
    """Rank of every ordinary piece: lower is merged first."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i): -sp.get_score(i) for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    if any(re.search(f"[^{START}]{START}", p) for p in pieces):
        raise ValueError("a piece spans a word start: texts cannot be cut there")
    return pieces


def symbols_left(segment: str, ranks: dict[str, float]) -> int:
    """Number of tokens of one segment."""
    n = len(segment)
    count = sum(1 if c in ranks else len(c.encode()) for c in segment)
    if n < 2:
        return count
    piece, before, after = list(segment), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(ranks[p], i, p) for i in range(n - 1) if (p := segment[i : i + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, p = heapq.heappop(heap)
        j = after[i] if piece[i] else n
        if j >= n or piece[i] + piece[j] != p:
            continue  # one of the two has merged meanwhile
        piece[i], piece[j] = p, ""
        after[i] = j = after[j]
        count -= 1
        if j < n:
            before[j] = i
            if (q := p + piece[j]) in ranks:
                heapq.heappush(heap, (ranks[q], i, q))
        if (h := before[i]) >= 0 and (q := piece[h] + p) in ranks:
            heapq.heappush(heap, (ranks[q], h, q))
    return count


class Counts(dict):
    """Counts of segments, made when first asked for."""

    def __init__(self, ranks: dict[str, float]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, segment: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        n = symbols_left(START + segment if segment[:1] != START else segment, self.ranks)
        if len(segment) <= 64:
            self[segment] = n
        return n


@cache
def counts_of(path: str) -> Counts:
    return Counts(ranks_of(path))


#: Anything but plain single spaces between words takes the general way of cutting.
_PLAIN = re.compile(f"  |{START}")
_CUT = re.compile(f"{START}+[^{START}]*|[^{START}]+")


def count_tokens(text: str, counts: Counts) -> int:
    """Tokens of one text; an empty one has none."""
    if not text:
        return 0
    if text[0] != " " and text[-1] != " " and not _PLAIN.search(text):
        return sum(map(counts.__getitem__, text.split(" ")))
    # A word start stands before the text and for each space.
    return sum(map(counts.__getitem__, _CUT.findall(START + text.replace(" ", START))))


def _counter(path: str):
    def run(batches):
        counts = counts_of(path)
        for batch in arrays.pieces(batches):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            n = np.fromiter((count_tokens(x, counts) for x in texts), np.int64, len(texts))
            size = np.fromiter((len(x) for x in arrays.encode_texts(batch.column("text"))), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, text) to (doc_id, n_bytes, n_tokens, over_limit), row by row; null texts count as empty."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.mapInArrow(_counter(path or model_path()), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
