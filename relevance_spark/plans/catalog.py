"""Registry of the runnable queries and of the SQL that checks them."""

from __future__ import annotations

from relevance_spark.plans import agents, dense, lexical, objectives, preparation, quality

_PARTS = (lexical, dense, quality, preparation, agents, objectives)


def queries() -> dict:
    return {name: fn for part in _PARTS for name, (fn, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}
