"""All queries of the mapping engine by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cloud_queries, estimation_queries, geo_queries, graph_queries, motion_queries, neighbour_queries, rule_queries, stream_queries, time_queries

MODULES = (cloud_queries, time_queries, neighbour_queries, motion_queries, graph_queries, geo_queries, estimation_queries, rule_queries, stream_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
