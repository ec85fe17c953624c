"""Queries of the catalog, search, validation and intake operators with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import catalog, files, intake, pages, rules, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (search, catalog, rules, pages, intake, files):
    QUERIES |= {name: run for name, (run, _) in _module.QUERIES.items()}
    ORACLE_SQL |= {name: sql for name, (_, sql) in _module.QUERIES.items() if sql}
