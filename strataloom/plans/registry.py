"""All core queries and their SQL."""

from __future__ import annotations

from strataloom.plans import core_queries, pipeline_queries, reference_queries

_MODULES = [core_queries, pipeline_queries, reference_queries]
FLAGSHIP = core_queries.hybrid_rerank


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in _MODULES for k, q in m.SQL.items()}
