"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talefold.plans import checks, ingest, results, retrieval, texts

Query = Callable[[SparkSession, str], DataFrame]
_PARTS = (retrieval, texts, ingest, checks, results)


def queries() -> dict[str, Query]:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for part in _PARTS for name, text in part.ORACLE.items()}
