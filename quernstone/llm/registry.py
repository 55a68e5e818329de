"""All registered queries of the subpackage, with their SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import queries_alike, queries_names, queries_personal, queries_reading, queries_text

MODULES = [queries_alike, queries_names, queries_personal, queries_reading, queries_text]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
