"""Named queries of the core engine and their SQL counterparts."""

from __future__ import annotations

from folioforge.plans import ingestion, markup, reports, search, storage, texts

_parts = (search, texts, ingestion, markup, reports, storage)
QUERIES: dict = {name: query for part in _parts for name, query in part.QUERIES.items()}
ORACLE: dict = {name: sql for part in _parts for name, sql in part.ORACLE.items()}
