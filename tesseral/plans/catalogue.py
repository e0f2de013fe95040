"""All queries of the core and their SQL counterparts."""

from __future__ import annotations

from tesseral.plans import aggregate_queries, evidence_queries, filter_queries, formula_queries, join_queries, model_queries, record_queries, scalar_queries, source_queries, survey_queries

_MODULES = (record_queries, survey_queries, scalar_queries, filter_queries, join_queries, aggregate_queries, formula_queries, model_queries, evidence_queries, source_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: q for m in _MODULES for k, q in m.ORACLE.items()}
