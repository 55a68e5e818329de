"""Queries for names typed by people (p2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.llm.names import link
from quernstone.plans.session import table


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.regexp_replace(F.upper("company"), "[^A-Z0-9]+", "").alias("own")
    rows = table(spark, sf_dir, "complaints").select("complaint_id", "narrative", own)
    return link(rows, "complaint_id", "narrative", "own", table(spark, sf_dir, "companies"), "company_id", "name", "aliases")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir).select("complaint_id", "company_id")


def p2_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every star: the spellings linked to a respondent, with how often they occur and whether its aliases hold them."""
    known = table(spark, sf_dir, "companies").select("company_id", F.transform("aliases", lambda a: F.lower(F.trim(a))).alias("known"))
    stars = _linked(spark, sf_dir).groupBy("company_id", F.lower("spelling").alias("spelling")).agg(F.count("*").alias("n"))
    return stars.join(known, "company_id", "left").select("company_id", "spelling", "n", F.coalesce(F.array_contains("known", F.col("spelling")), F.lit(False)).alias("is_alias"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p2_variants": p2_variants}
ORACLES: dict[str, str] = {}
