"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Query name to the module of this subpackage with its ``query`` and, where SQL can express it, ``ORACLE_SQL``.
MODULES = {
    "op1_quality_rules": "quality_rules",
    "op2_mix_sources": "mixing",
    "op3_quality_classifier": "quality_classifier",
    "op4_secret_scan": "secret_scan",
    "op5_minhash_dedup": "minhash",
    "op6_token_counts": "bpe",
    "op7_sentencepiece": "sentencepiece_lattice",
    "op8_fingerprints": "fingerprints",
    "op9_lm_scoring": "language_model",
    "op10_substring_dedup": "substrings",
}


def queries() -> dict:
    return {name: import_module(f"relevance_spark.llm.{m}").query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"relevance_spark.llm.{m}"), "ORACLE_SQL", None) for name, m in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
