"""The library's queries over the given tables, by name, and DuckDB SQL for those that SQL can state."""

from __future__ import annotations

from kbspark.plans import admin_queries, chat_queries, kb_queries
from kbspark.streaming import queries as streaming_queries

_PARTS = (kb_queries, chat_queries, admin_queries, streaming_queries)
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
