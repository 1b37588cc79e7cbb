"""SentencePiece encoding by a relational lattice, and decoding.

A text, with a word start before it and for each space, falls into segments: before word starts, and between a letter
and an ASCII character that no piece joins to a letter, where every path has a boundary. The
distinct segments of all texts are exploded into their substrings up to the longest piece, these are joined with the
piece table, the edges are grouped by segment, and a higher-order aggregate folds them into the best path: the largest
sum of piece scores, the longest last piece among equals. A character without a piece falls back to its bytes. The
segments' pieces, as sorted hash arrays in the shared folder, are mapped by workers that write out whole texts.

The fold keeps the last places in two short arrays and lays finished ones aside, so a step costs the same however long
the segment is. Null and empty texts have no pieces. Decoding joins the pieces; a text that holds the word-start
character itself comes back with spaces in its place, and ``restored`` is then false.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relevance_spark.llm import arrays, blocks, files
from relevance_spark.llm.arrays import U
from relevance_spark.llm.bpe import START, model_path
from relevance_spark.llm.shared import Workspace, let, text_or_empty

#: Places of a segment that are folded, and cut out of it, together; no piece may be longer.
SPAN = 64
#: How much less than the lowest score a character without a piece counts.
UNKNOWN = 10.0


def _joined_pairs(pieces: list[str]) -> np.ndarray:
    """Which kinds of characters stand side by side in any piece: a letter and each ASCII character, both ways.

    Kinds are bytes of UTF-8 with all letters a-z and A-Z as one; whatever is not ASCII counts as joined.
    """
    out = np.zeros((256, 256), bool)
    out[128:], out[:, 128:] = True, True
    for p in pieces:
        k = _KIND[np.frombuffer(p.replace(START, " ").encode(), np.uint8)]
        out[k[:-1], k[1:]] = True
    return out


def _kinds() -> np.ndarray:
    k = np.arange(256, dtype=np.uint8)
    k[65:91] = k[97:123] = 97
    return k


_KIND = _kinds()


@cache
def pieces_of(path: str) -> dict:
    """Pieces with id and score, the id of the first byte piece, the longest piece, the score of an unknown character."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.vocab_size())
    plain = [(sp.id_to_piece(i), i, float(sp.get_score(i))) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    return {
        "rows": plain,
        "byte0": sp.piece_to_id("<0x00>"),
        "pairs": _joined_pairs([p for p, *_ in plain]),
        "longest": max(len(p) for p, *_ in plain),
        "unknown": min(s for *_, s in plain) - UNKNOWN,
        "bytes": [bytes([i - sp.piece_to_id("<0x00>")]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i).replace(START, " ").encode() for i in ids],
    }


#: Before word starts; a run of these stays together.
WORD_STARTS = f"(?<!{START})(?={START})"


def cut_pattern(table: dict) -> str:
    """Where a word is cut: between a letter and a character that no piece joins to one."""
    written = lambda codes: "".join(f"\\x{{{c:x}}}" for c in codes)
    ascii_ = [c for c in range(128) if c != 32 and _KIND[c] == c and c != 97]
    after = written(c for c in ascii_ if not table["pairs"][97, c])
    before = written(c for c in ascii_ if not table["pairs"][c, 97])
    cuts = [f"(?<=[a-zA-Z])(?=[{after}])"] if after else []
    cuts += [f"(?<=[{before}])(?=[a-zA-Z])"] if before else []
    return "|".join(cuts) or "(?!)"


def cuts_between(table: dict) -> np.ndarray:
    """The same rule over pairs of bytes, spaces standing for word starts."""
    out = np.zeros((256, 256), bool)
    letters = np.flatnonzero((_KIND == 97))
    for c in range(128):
        if c != 32 and c not in letters:
            out[letters, c] = not table["pairs"][97, c]
            out[c, letters] = not table["pairs"][c, 97]
    out[:, 32] = True
    out[32, 32] = False
    return out


def marked_words(text: Column) -> Column:
    """Array of the distinct words of one text; those without a mark have a word start of one space before them.

    Where words stand between single spaces, these part them; other texts are marked and cut before word starts.
    """
    plain = ~(F.contains(text, F.lit("  ")) | F.contains(text, F.lit(START)) | F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" ")))
    marked = F.concat(F.lit(START), F.replace(text, F.lit(" "), F.lit(START)))
    found = F.when(plain, F.split(text, " ", -1)).otherwise(F.split(marked, WORD_STARTS, -1))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(found))


def distinct_segments(docs: DataFrame, table: dict) -> DataFrame:
    """``word``: the distinct segments of all texts. Distinct words are looked for first, and only these cut further."""
    words = docs.select(F.explode(marked_words(text_or_empty())).alias("word")).groupBy("word").agg(F.lit(1).alias("one"))
    whole = F.when(F.startswith("word", F.lit(START)), F.col("word")).otherwise(F.concat(F.lit(START), "word"))
    parts = words.select(F.explode(F.split(whole, cut_pattern(table), -1)).alias("word"))
    return parts.groupBy("word").agg(F.lit(1).alias("one")).select("word")


#: Segments of one task of the lattice, about.
TASK_WORDS = 12_000
#: An edge in one number: end, what its length lacks of LACK, and piece. Numbers from UNKNOWN_CHAR on are characters
#: without a piece, by code point. In order of this number edges go by end, the longest first.
_LENGTH, _END, _UNKNOWN_CHAR, LACK = 1 << 24, 1 << 32, 1 << 23, 255


def lattice(words: DataFrame, table: dict) -> DataFrame:
    """``word``, ``k1`` and ``k2`` to one row per edge: k1, k2, word, edge, score, start, end.

    The keys stand for the segment, which only its first edge carries, so that a long one isn't copied to every row.
    Explodes of number sequences stay in generated code; substrings are taken from spans of bounded length. Every
    place has a single-character edge.
    """
    pieces = words.sparkSession.createDataFrame(table["rows"], "piece string, id int, score double")
    longest = table["longest"]
    if longest > SPAN:
        raise ValueError("a piece is longer than a span")
    spans = words.select("k1", "k2", "word", F.explode(F.sequence(F.lit(0), F.floor((F.length("word") - 1) / SPAN).cast("int"))).alias("s"))
    first = F.greatest(F.lit(0), F.col("s") * SPAN + 1 - longest)
    spans = spans.select("k1", "k2", F.when(F.col("s") == 0, F.col("word")).alias("word"), first.alias("first"), F.substring("word", first + 1, F.col("s") * SPAN + SPAN - first).alias("span"), (F.col("s") * SPAN).alias("base"))
    ends = spans.select("*", F.explode(F.sequence(F.col("base") + 1, F.col("first") + F.length("span"))).alias("end"))
    edges = ends.select("k1", "k2", F.when(F.col("end") == 1, F.col("word")).alias("word"), "first", "span", "end", F.explode(F.sequence(F.greatest(F.lit(0), F.col("end") - longest), F.col("end") - 1)).alias("start"))
    edges = edges.select("k1", "k2", "word", "end", "start", F.substring("span", F.col("start") - F.col("first") + 1, F.col("end") - F.col("start")).alias("part"))
    # The piece table has as many rows as the vocabulary, whatever the input.
    joined = edges.join(F.broadcast(pieces), edges.part == pieces.piece, "left").where("id IS NOT NULL OR start = end - 1")
    lack = (F.lit(LACK) - F.col("end") + F.col("start")).cast("long")
    edge = F.col("end").cast("long") * _END + lack * _LENGTH + F.coalesce(F.col("id"), F.ascii("part") + _UNKNOWN_CHAR)
    return joined.select("k1", "k2", "word", edge.alias("edge"), F.coalesce("score", F.lit(table["unknown"])).alias("score"), "start", "end")


def viterbi(edges: Column) -> Column:
    """Edges of the best path over an array of (edge, score, start, end).

    A place is its best sum and the edge that leads there. The state holds the place at ``end``, to which edges are
    still coming, the places from ``base`` up to it, SPAN of them at most, the SPAN places before these, and all
    earlier ones as arrays laid aside. Edges come in order of their end, so each betters the place or begins the next.
    """
    places = "array<struct<best:double,way:bigint>>"

    def state(end: Column, best: Column, way: Column, here: Column, far: Column) -> Column:
        return F.struct(end.alias("end"), best.alias("best"), way.alias("way"), here.alias("here"), far.alias("far"))

    def behind(base: Column, last: Column, done: Column) -> Column:
        return F.struct(base.alias("base"), last.alias("last"), done.alias("done"))

    none = F.array().cast(places)
    begin = state(F.lit(0), F.lit(0.0), F.lit(-1).cast("long"), none, behind(F.lit(0), none, F.array().cast(f"array<{places}>")))
    pending = lambda acc: F.struct(acc["best"].alias("best"), acc["way"].alias("way"))

    def step(acc: Column, e: Column) -> Column:
        far, back = acc["far"], e["start"] - acc["far"]["base"]
        before = F.when(e["start"] == acc["end"], acc["best"]).when(back >= 0, acc["here"][back]["best"]).otherwise(far["last"][back + SPAN]["best"])
        score = before + e["score"]
        same = F.when(score > acc["best"], state(acc["end"], score, e["edge"], acc["here"], far)).otherwise(acc)
        more = state(e["end"], score, e["edge"], F.array_append(acc["here"], pending(acc)), far)
        full = state(e["end"], score, e["edge"], F.array(pending(acc)), behind(far["base"] + SPAN, acc["here"], F.array_append(far["done"], acc["here"])))
        return F.when(e["end"] == acc["end"], same).when(acc["end"] - far["base"] < SPAN, more).otherwise(full)

    def back_over(path: Column, span: Column) -> Column:
        """Along the best edges through one span of places, from its last place on."""

        def back(own: Column, p: Column) -> Column:
            length = F.lit(LACK) - (F.shiftright(p["way"], 24) % 256).cast("int")
            taken = F.struct((own["at"] - length).alias("at"), F.concat(F.array(p["way"]), own["edges"]).alias("edges"))
            return F.when(own["at"] == F.shiftright(p["way"], 32), taken).otherwise(own)

        start = F.struct(path["at"].alias("at"), F.array().cast("array<bigint>").alias("edges"))
        own = F.aggregate(F.reverse(span), start, back)
        return let(own, lambda o: F.struct(o["at"].alias("at"), F.concat(F.array(o["edges"]), path["parts"]).alias("parts")))

    def trace(acc: Column) -> Column:
        spans = F.array_append(acc["far"]["done"], F.array_append(acc["here"], pending(acc)))
        whole = F.struct(acc["end"].alias("at"), F.array().cast("array<array<bigint>>").alias("parts"))
        return F.flatten(F.aggregate(F.reverse(spans), whole, back_over)["parts"])

    return F.aggregate(F.sort_array(edges), begin, step, trace)


def ids_of_path(edges: Column, byte0: int) -> Column:
    """Piece numbers along a path; a character without a piece gives those of its bytes in UTF-8."""

    def of(e: Column) -> Column:
        number = (e % _LENGTH).cast("int")
        c = number - _UNKNOWN_CHAR
        tail = lambda shift: (F.shiftright(c, shift) % 64) + (128 + byte0)
        coded = F.when(c < 0x80, F.array(c + byte0)).when(c < 0x800, F.array(F.shiftright(c, 6) + (0xC0 + byte0), tail(0)))
        coded = coded.when(c < 0x10000, F.array(F.shiftright(c, 12) + (0xE0 + byte0), tail(6), tail(0))).otherwise(F.array(F.shiftright(c, 18) + (0xF0 + byte0), tail(12), tail(6), tail(0)))
        return F.when(number < _UNKNOWN_CHAR, F.array(number)).otherwise(coded)

    return F.flatten(F.transform(edges, of))


def encoded_segments(docs: DataFrame, path: str, ws: Workspace) -> DataFrame:
    """(word, ids) for every distinct segment of all texts."""
    table = pieces_of(path)
    words = ws.save(distinct_segments(docs, table), "words")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-words.count() // TASK_WORDS))
    # Dealt out by key, a segment's edges never leave the task that makes them; in order of the key, the aggregate's
    # sort, to which it goes over after its first groups and which may spill, finds its rows sorted.
    keyed = words.select(F.xxhash64("word").alias("k1"), F.xxhash64("word", F.lit(1)).alias("k2"), "word").repartition(parts, "k1").sortWithinPartitions("k1", "k2")
    grouped = lattice(keyed, table).groupBy("k1", "k2").agg(F.max("word").alias("word"), F.collect_list(F.struct("edge", "score", "start", "end")).alias("edges"))
    return grouped.select("word", ids_of_path(viterbi(F.col("edges")), table["byte0"]).alias("ids"))


def hash_segments(texts: list[bytes], cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the segments of all texts, and the offsets of each text's; word starts are spaces here."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < arrays.CHUNK):
            size += len(texts[end]) + 1
            end += 1
        part = [b" " + x if x else b"" for x in texts[at:end]]
        buf = np.frombuffer(b"".join(part), np.uint8)
        bounds = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))
        if len(buf):
            first = np.ones(len(buf), bool)
            first[1:] = cuts[buf[:-1], buf[1:]]
            first[bounds[:-1][bounds[:-1] < len(buf)]] = True
            starts = np.flatnonzero(first)
            ends = np.append(starts[1:], len(buf))
            hashes.append(arrays.span_hashes(buf, starts, ends))
            counts[at:end] = np.diff(np.searchsorted(starts, bounds), prepend=0)
        at = end
    return np.concatenate(hashes) if hashes else np.empty(0, U), np.concatenate(([0], np.cumsum(counts)))


def plain_spaces(text: bytes) -> bytes:
    return text.replace(START.encode(), b" ")


def _store(uri: str, n: int):
    def run(key, table):
        h = arrays.span_hashes(*_spans([plain_spaces(w.encode()) for w in table.column("word").to_pylist()]))
        order = np.argsort(h)
        ids = table.column("ids").combine_chunks()
        lengths = np.diff(ids.offsets.to_numpy())
        flat = ids.values.to_numpy()[arrays.ragged(ids.offsets.to_numpy()[:-1][order].astype(np.int64), lengths[order].astype(np.int64))]
        b = key[0].as_py()
        files.write_array(uri, f"hash-{b:05d}", h[order])
        files.write_array(uri, f"offset-{b:05d}", np.concatenate(([0], np.cumsum(lengths[order]))).astype(np.int64))
        files.write_array(uri, f"ids-{b:05d}", flat.astype(np.int32))
        return pa.table({"bucket": [b], "words": [len(h)]})

    return run


def _spans(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(words), np.uint8), ends - sizes, ends


def _bucketed(n: int):
    """Adds the bucket of each word's hash, and leaves the rest as it is."""

    def run(batches):
        for batch in batches:
            words = [plain_spaces(w.encode()) for w in batch.column("word").to_pylist()]
            h = arrays.span_hashes(*_spans(words)) if words else np.empty(0, U)
            bucket = blocks.bucket_of(h, n)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column("word"), batch.column("ids")], ["bucket", "word", "ids"])

    return run


def build_dictionary(docs: DataFrame, path: str, ws: Workspace) -> dict:
    """Encode all distinct segments and leave them as arrays in the shared folder."""
    n, uri = blocks.n_blocks(docs, 40_000_000), f"{ws.uri}/segments"
    encoded = encoded_segments(docs, path, ws).mapInArrow(_bucketed(n), "bucket long, word string, ids array<int>")
    words = encoded.groupBy("bucket").applyInArrow(_store(uri, n), "bucket long, words long").agg(F.sum("words")).first()[0]
    ws.drop("words")
    return {"uri": uri, "n": n, "words": words or 0}


def ids_of(h: np.ndarray, dictionary: dict) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all segments one after the other, and how many each has."""
    w, inverse = np.unique(h, return_inverse=True)
    bucket = blocks.bucket_of(w, dictionary["n"])
    flats, lengths, starts, base = [], np.zeros(len(w), np.int64), np.zeros(len(w), np.int64), 0
    for b in np.unique(bucket):
        i, j = np.searchsorted(bucket, [b, b + 1])
        keys = files.map_array(dictionary["uri"], f"hash-{b:05d}", U)
        at = np.searchsorted(keys, w[i:j])
        if not len(keys) or (at == len(keys)).any() or (keys[at] != w[i:j]).any():
            raise ValueError("a segment is not in the dictionary of these texts")
        offset = files.map_array(dictionary["uri"], f"offset-{b:05d}", np.int64)
        lengths[i:j] = offset[at + 1] - offset[at]
        part = files.map_array(dictionary["uri"], f"ids-{b:05d}", np.int32)[arrays.ragged(offset[at], lengths[i:j])]
        starts[i:j] = base + np.cumsum(lengths[i:j]) - lengths[i:j]
        base += len(part)
        flats.append(part)
    flat = np.concatenate(flats) if flats else np.empty(0, np.int32)
    return flat[arrays.ragged(starts[inverse], lengths[inverse])], lengths[inverse]


@cache
def _piece_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _spans(pieces_of(path)["bytes"])


def decoded(ids: np.ndarray, path: str) -> bytes:
    """Text of a sequence of pieces, without the space before it."""
    flat, first, end = _piece_bytes(path)
    return flat[arrays.ragged(first[ids], end[ids] - first[ids])].tobytes()[1:]


def _encoder(path: str, dictionary: dict, with_ids: bool):
    cuts = cuts_between(pieces_of(path))

    def encode(batch):
        texts = arrays.encode_texts(batch.column("text"))
        plain = [plain_spaces(x) for x in texts]
        h, off = hash_segments(plain, cuts)
        ids, sizes = ids_of(h, dictionary)
        bounds = np.concatenate(([0], np.cumsum(sizes)))[off]
        counts, digests, same = [], [], []
        for i, text in enumerate(texts):
            mine = ids[bounds[i] : bounds[i + 1]]
            counts.append(len(mine))
            digests.append(hashlib.sha256(mine.astype("<i4").tobytes()).hexdigest())
            same.append(decoded(mine, path) == text)
        out = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_())]
        if with_ids:
            out.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())))
        return pa.RecordBatch.from_arrays(out, ["doc_id", "n_pieces", "ids_sha256", "restored"] + ["ids"] * with_ids)

    def run(batches):
        for batch in arrays.pieces(batches, 1_000_000):
            yield encode(batch)

    return run


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = True, ws: Workspace | None = None) -> DataFrame:
    """(doc_id, text) to (doc_id, n_pieces, ids_sha256, restored[, ids]), one row per row of docs.

    ids_sha256 is of the ids as little-endian 32-bit numbers; restored tells that decoding the ids gives the text.
    """
    path = path or model_path()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dictionary = build_dictionary(texts, path, ws or Workspace(docs.sparkSession, "sentencepiece"))
    schema = "doc_id long, n_pieces long, ids_sha256 string, restored boolean" + ", ids array<int>" * with_ids
    return texts.mapInArrow(_encoder(path, dictionary, with_ids), schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, with_ids=False)
