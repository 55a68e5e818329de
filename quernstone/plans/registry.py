"""All registered queries of the core, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.plans import deciders, evaluation, ingest, links, profile, textual, training_core

MODULES = [training_core, ingest, profile, evaluation, textual, links, deciders]
FLAGSHIP = "frontier"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
