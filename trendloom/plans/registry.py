"""Registered queries and their oracles."""

from __future__ import annotations

from trendloom.plans import function_queries, language_queries, relational_queries, stream_queries, text_queries  # noqa: F401  (all but the relational ones add to those of text_queries)

QUERIES: dict = relational_queries.QUERIES | text_queries.QUERIES
ORACLE_SQL: dict[str, str] = relational_queries.ORACLE_SQL | text_queries.ORACLE_SQL
