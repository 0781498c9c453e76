"""All queries of the library by name, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from askmill.jobs import cache_jobs, ingest_jobs, search_jobs

FLAGSHIP = "hybrid_search"
#: Modules of queries; each has QUERIES and ORACLE_SQL.
MODULES = [ingest_jobs, search_jobs, cache_jobs]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
