"""Every named query and its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kgspark.plans import design_queries, document_queries, graph_queries, index_queries, mining_queries, retrieval_queries, review_queries, stream_queries, text_queries

_PLANS = (graph_queries, text_queries, retrieval_queries, index_queries, stream_queries, document_queries, mining_queries, review_queries, design_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for plan in _PLANS for name, sql in plan.SQL.items()}
