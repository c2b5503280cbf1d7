"""The registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str]]:
    from gleaner.queries import compiling, dense, evaluation, ingest, retrieval, text

    found: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for module in (ingest, text, retrieval, compiling, dense, evaluation):
        found |= module.QUERIES
        sql |= module.ORACLE_SQL
    return found, sql
