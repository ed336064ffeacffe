"""All core queries and their DuckDB counterparts."""

from __future__ import annotations

from docustrata.operators import training
from docustrata.plans import corpus_queries, pipeline_queries, service_queries, text_queries, training_sql

FLAGSHIP = "lexical_search_topk"
QUERIES = {**text_queries.QUERIES, **corpus_queries.QUERIES, **pipeline_queries.QUERIES, **service_queries.QUERIES, **training.QUERIES}
ORACLES: dict[str, str] = {**text_queries.ORACLES, **corpus_queries.ORACLES, **pipeline_queries.ORACLES, **service_queries.ORACLES, **training_sql.ORACLES}
