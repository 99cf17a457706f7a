"""All queries of the engine by name, and the SQL that states the same rows."""

from __future__ import annotations

from quire.plans import article_queries, file_queries, page_queries, rule_queries, stitch_queries, stream_queries, style_queries, text_queries

_MODULES = (text_queries, page_queries, article_queries, rule_queries, stitch_queries, style_queries, file_queries, stream_queries)
QUERIES: dict = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
