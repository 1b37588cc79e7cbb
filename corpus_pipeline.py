"""The corpus pipeline: documents through five stages, each written and read again as the next one's input.

Quality rules drop what they reject; of each group of near duplicates one document stays; secrets are masked; sources
are taken as often as their target weights ask; what is left is encoded into pieces.
"""

from __future__ import annotations

from relevance_spark.llm import minhash, mixing, quality_rules, secret_scan, sentencepiece_lattice
from relevance_spark.llm.shared import Workspace
from relevance_spark.session import ship_package


def rules(spark, docs, sf_dir):
    """The documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group with 0.8 of their five-word shingles in common."""
    ship_package(spark)
    return minhash.keep_first(docs, width=5, percent=80)


def secrets(spark, docs, sf_dir):
    """The documents with their secrets masked."""
    return secret_scan.mask_secrets(docs)


def mixture(spark, docs, sf_dir):
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def pieces(spark, docs, sf_dir):
    """doc_id, n_pieces, ids_sha256, restored and ids of every document."""
    ship_package(spark)
    return sentencepiece_lattice.encode(docs)


STAGES = [("quality_rules", rules), ("minhash_dedup", near_dedup), ("secret_scan", secrets), ("mix_sources", mixture), ("sentencepiece", pieces)]

#: The last stage's pieces can't be made in SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = ws.save(docs, name)
    return docs
