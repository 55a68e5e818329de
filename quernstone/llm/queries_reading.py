"""Queries for the reading level of documents (p10)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.llm.reading import fit, score
from quernstone.plans.session import table

#: White space, as texts are cut into words for the least length.
_SPACE = r"(?U)\s+"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit(table(spark, sf_dir, "level_examples"), "text", "reading_level")
    english = table(spark, sf_dir, "documents").where(F.col("lang") == "en").select("doc_id", "text", "doc_kind")
    n_words = F.size(F.filter(F.split("text", _SPACE), lambda w: w != ""))
    return score(english.withColumn("n_words", n_words), "text", model)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents of at least 60 words with their level."""
    return _scored(spark, sf_dir).where((F.col("n_words") >= 60) & F.col("reading_level").isNotNull()).select("doc_id", "reading_level")


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by kind of document and level: documents, words, mean share of each level."""
    shares = [F.round(F.avg(F.element_at("level_shares", i + 1)), 6).alias(f"share_{i + 1}") for i in range(3)]
    return _scored(spark, sf_dir).groupBy("doc_kind", "reading_level").agg(F.count("*").alias("n"), F.sum("n_words").alias("n_words"), *shares)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p10_found": p10_found, "p10_profile": p10_profile}
ORACLES: dict[str, str] = {}
