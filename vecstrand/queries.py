"""Registry of the core queries and their SQL."""

from __future__ import annotations

from vecstrand.catalog import corpus, display, graph, rank, signal, streams, worker

_PARTS = (corpus, rank, graph, signal, streams, display, worker)
QUERIES: dict = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for p in _PARTS for k, v in p.SQL.items()}
