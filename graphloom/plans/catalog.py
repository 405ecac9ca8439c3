"""All queries of the library by name, each with its SQL."""

from __future__ import annotations

from . import corpus_queries, eval_queries, file_queries, vector_queries

FLAGSHIP = "iterative_late_interaction"
_PARTS = (vector_queries, corpus_queries, eval_queries, file_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
