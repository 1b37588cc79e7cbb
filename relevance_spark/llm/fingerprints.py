"""Exact fingerprints of canonical texts, and groups of equal ones that are compared byte by byte.

Canonical: NFKC, case folding, runs of white space as one space, none at the ends. The fingerprint is the 128-bit
xxhash of the canonical UTF-8 bytes. It tells equal from different and nothing in between: two likenesses are 1 or 0.
Null texts are empty; rows with equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevance_spark.llm import blocks
from relevance_spark.llm.shared import Workspace, maybe_broadcast, text_or_empty


#: Rows of one bucket that are compared with its first row in one place.
PART = 256
#: Characters of text in a range of rows, about.
RANGE_CHARS = 32_000_000


def canonical(text: str) -> bytes:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def fingerprint(text: str) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(canonical(text))


def likeness(a: str, b: str) -> float:
    return float(a == b)


def _printer(batches):
    for batch in batches:
        texts = [x or "" for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names if c != "text"], pa.array([fingerprint(x) for x in texts], pa.string())], [*[c for c in batch.schema.names if c != "text"], "fingerprint"])


def _canonical_rows(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fingerprint"), pa.array([canonical(x or "") for x in batch.column("text").to_pylist()], pa.binary())], ["doc_id", "fingerprint", "bytes"])


def equal_groups(docs: DataFrame, prints: DataFrame, ws: Workspace) -> DataFrame:
    """(doc_id, fingerprint) of docs to (doc_id, fingerprint, group_id): the smallest doc_id with the same bytes.

    Only fingerprints that occur twice are looked at. Each such row's bytes are compared with those of the bucket's
    first row; rows that differ from it, should a digest ever collide, form groups of their own by their bytes. The rows
    of a large bucket are dealt into parts of about PART, to each of which a copy of the first row goes.
    """
    buckets = ws.save(prints.where("doc_id IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = ws.save(prints.join(maybe_broadcast(buckets, buckets.count()), "fingerprint").select("doc_id", "fingerprint", "first").dropDuplicates(["doc_id", "fingerprint"]), "shared")
    few = shared.count()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    sizes = shared.groupBy("fingerprint").agg(F.ceil(F.count("*") / F.lit(PART)).cast("long").alias("parts"))
    members = texts.join(maybe_broadcast(shared, few), "doc_id").mapInArrow(_canonical_rows, "doc_id long, fingerprint string, bytes binary")
    members = members.join(maybe_broadcast(sizes, few), "fingerprint").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).drop("parts")
    heads = texts.join(maybe_broadcast(shared.where("doc_id = first"), buckets.count()), "doc_id").select("doc_id", "fingerprint", "text").mapInArrow(_canonical_rows, "doc_id long, fingerprint string, bytes binary")
    heads = heads.groupBy("fingerprint").agg(F.min("bytes").alias("head"), F.min("doc_id").alias("first"))
    heads = heads.join(maybe_broadcast(sizes, few), "fingerprint").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    same = members.join(heads, ["fingerprint", "part"]).select("doc_id", "fingerprint", "first", (F.col("bytes") == F.col("head")).alias("equal"), F.sha2("bytes", 256).alias("sha"))
    same = ws.save(same, "compared")
    odd = same.where(~F.col("equal"))
    own = odd.groupBy("fingerprint", "sha").agg(F.min("doc_id").alias("group_id"))
    found = same.where("equal").select("doc_id", "fingerprint", F.col("first").alias("group_id")).union(odd.join(own, ["fingerprint", "sha"]).select("doc_id", "fingerprint", "group_id"))
    return found.groupBy("doc_id", "fingerprint").agg(F.min("group_id").alias("group_id"))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning of the following one."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _result(doc_id, text: str, own: str, following: str, theirs: str) -> tuple:
    changed = edited(text, following)
    other = fingerprint(changed)
    return (1, doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, other, likeness(own, other), likeness(own, theirs), None, None)


_FIELDS = [("kind", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("text", pa.string())]
_SCHEMA = "kind int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, text string"


def _paired(batches):
    """Rows in order: each with the one after it. The first and the last text of a partition leave it, to be paired outside."""
    held, part = None, None

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_FIELDS)], [n for n, _ in _FIELDS])

    for batch in batches:
        out = []
        for doc_id, text, p in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("part").to_pylist(), strict=True):
            text = text or ""
            own = fingerprint(text)
            if held is None:
                part = p
                out.append((0, doc_id, None, None, own, None, None, None, p, text))
            else:
                out.append(_result(*held, text, own))
            held = (doc_id, text, own)
        if out:
            yield batch_of(out)
    if held is not None:
        yield batch_of([(2, held[0], None, None, held[2], None, None, None, part, held[1])])


def _finished(batches):
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("doc_id", "text", "fingerprint", "next_text", "next_print")]
        rows = [_result(*r) for r in zip(*cols, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_FIELDS)], [n for n, _ in _FIELDS])


def compared(docs: DataFrame, ws: Workspace) -> DataFrame:
    """Fingerprints of texts and of their edited versions; the following row is the one with the next lower doc_id.

    Rows are ranged by doc_id, downwards, nulls last and equal ids by text; neighbours meet inside a partition, and only
    the first and last row of each partition meet in a second small step, whose size is the number of partitions.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("h", F.xxhash64("text"))
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks.n_blocks(texts, RANGE_CHARS))
    ranged = texts.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    made = ws.save(ranged.mapInArrow(_paired, _SCHEMA), "paired")
    ends = made.where("kind <> 1").select("kind", "part", "doc_id", "fingerprint", "text")
    parts = [r[0] for r in ends.where("kind = 0").select("part").orderBy("part").collect()]  # one number a partition
    follows = docs.sparkSession.createDataFrame([(p, q) for p, q in zip(parts, parts[1:] + parts[:1], strict=True)], "part int, next_part int")
    heads = ends.where("kind = 0").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    last = ends.where("kind = 2").join(follows, "part").join(heads, "next_part").select("doc_id", "text", "fingerprint", "next_text", "next_print").mapInArrow(_finished, _SCHEMA)
    return made.where("kind = 1").union(last).drop("kind", "part", "text")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ws = Workspace(spark, "fingerprints")
    rows = ws.save(compared(docs, ws), "rows")
    ws.drop("paired")
    groups = ws.save(equal_groups(docs, rows.select("doc_id", "fingerprint"), ws), "groups")
    out = rows.join(maybe_broadcast(groups, groups.count()), ["doc_id", "fingerprint"], "left")
    return out.withColumn("group_id", F.coalesce("group_id", "doc_id"))
