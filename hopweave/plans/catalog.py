"""The registered queries and their SQL counterparts."""

from __future__ import annotations

from hopweave.plans import engine_queries, keyword_queries, qa_queries, storage_queries, text_queries, vector_queries

QUERIES: dict = {**vector_queries.QUERIES, **text_queries.QUERIES, **qa_queries.QUERIES, **engine_queries.QUERIES, **storage_queries.QUERIES, **keyword_queries.QUERIES}
ORACLES: dict[str, str] = {**vector_queries.ORACLES, **text_queries.ORACLES, **qa_queries.ORACLES, **engine_queries.ORACLES, **storage_queries.ORACLES, **keyword_queries.ORACLES}
