"""All registered queries and their DuckDB twins."""

from __future__ import annotations

from seqmodel.plans import ingest_queries, model_queries, stack_queries

_PARTS = (ingest_queries, model_queries, stack_queries)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
