"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import recovery_queries, session_queries, source_queries, trip_queries

_MODULES = (recovery_queries, trip_queries, source_queries, session_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery_queries.recover_linear_by_gap(spark, sf_dir)
