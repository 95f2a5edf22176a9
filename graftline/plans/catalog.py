"""All core queries and their SQL."""

from __future__ import annotations

from graftline.plans import agreement_queries, core_queries, gold_queries, io_queries, log_queries, record_queries, text_queries, tree_queries

_MODULES = (core_queries, agreement_queries, text_queries, tree_queries, log_queries, io_queries, record_queries, gold_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
