"""Registered queries of the layout engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import document_queries, engine_queries, text_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return text_queries.QUERIES | document_queries.QUERIES | engine_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return text_queries.ORACLES | document_queries.ORACLES | engine_queries.ORACLES
