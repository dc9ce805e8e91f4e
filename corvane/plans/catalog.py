"""All named queries of the core and their SQL."""

from __future__ import annotations

from . import brief_queries, corpus_queries, graph_queries, io_queries, kernel_queries, probe_queries, structure_queries

_MODULES = (structure_queries, corpus_queries, graph_queries, io_queries, kernel_queries, probe_queries, brief_queries)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in getattr(m, "SQL", {}).items()}
