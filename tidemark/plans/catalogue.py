"""The registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from tidemark.plans import alert_queries, baseline_queries, corpus_queries, feature_queries, ingest_queries, source_queries, vector_queries  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
