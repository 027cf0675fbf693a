"""Registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(queries.Q)
ORACLE_SQL: dict[str, str] = dict(queries.SQL)
