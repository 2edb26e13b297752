"""Registered queries of the engine and the SQL that states the same over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from causeway.plans import catalog_queries, graph_queries, metric_queries, retrieval_queries

MODULES = (graph_queries, retrieval_queries, catalog_queries, metric_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
