"""All queries over the driver's tables, and their SQL where it can express them."""

from __future__ import annotations

from lattica.plans import graph_queries, source_queries, table_queries, text_queries

_ALL = {**text_queries.QUERIES, **graph_queries.QUERIES, **table_queries.QUERIES, **source_queries.QUERIES}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
