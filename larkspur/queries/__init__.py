"""Registered queries of the core and their SQL for the side-by-side check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.queries import companies, details, extract, history, scoring

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {**history.QUERIES, **companies.QUERIES, **extract.QUERIES, **scoring.QUERIES, **details.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**history.SQL, **companies.SQL, **extract.SQL, **scoring.SQL, **details.SQL}
