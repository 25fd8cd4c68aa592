"""The catalogue of queries by name, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from loomstone.plans import corpus_queries, search_queries, upkeep_queries

QUERIES: dict = {}
SQL: dict[str, str] = {}
for module in (search_queries, corpus_queries, upkeep_queries):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
