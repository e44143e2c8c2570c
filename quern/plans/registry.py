"""All queries of the engine by name, with the SQL each must agree with."""

from __future__ import annotations

from quern.plans import metric_queries, text_queries, vector_queries

PARTS = (text_queries, metric_queries, vector_queries)


def queries() -> dict:
    return {k: v for part in PARTS for k, v in part.queries().items()}


def oracle_sql() -> dict:
    return {k: v for part in PARTS for k, v in part.oracle_sql().items()}
