"""Queries for personal information in narratives (p6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.llm.personal import find, propose, redact, train
from quernstone.plans.session import checkpointed, table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "complaints").select("complaint_id", "narrative"), "complaint_id", "narrative")[0]


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every complaint's narrative with typed placeholders."""
    rows = table(spark, sf_dir, "complaints").select("complaint_id", "narrative")
    return redact(rows, "narrative", train(checkpointed(propose(rows, "complaint_id", "narrative"))))


def p6_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many details of each kind, and in how many complaints."""
    return p6_found(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n_details"), F.countDistinct("complaint_id").alias("n_complaints"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p6_found": p6_found, "p6_redacted": p6_redacted, "p6_summary": p6_summary}
ORACLES: dict[str, str] = {}
