"""Registry of the engine's named queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fluvia.plans import grid_queries, mesh_queries, source_queries, table_queries

FLAGSHIP = "river_network_carved_terrain"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (grid_queries, table_queries, mesh_queries, source_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
