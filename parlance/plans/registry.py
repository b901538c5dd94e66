"""Every query of the library with its SQL counterpart."""

from __future__ import annotations

from parlance.plans import align_queries, change_queries, segment_queries, source_queries, stream_queries, text_queries

FLAGSHIP = "w4_top_candidates"
MODULES = [segment_queries, text_queries, change_queries, align_queries, stream_queries, source_queries]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
