"""The opN_ queries, the pipeline and their SQL."""

from __future__ import annotations

import corpus_pipeline

from factloom.llm import queries

QUERIES = {**queries.QUERIES, "pipeline": corpus_pipeline.run}
ORACLES = {**queries.ORACLES, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
