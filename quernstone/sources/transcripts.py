"""Recorded episodes: one JSON line each, replayed without asking anybody again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.functions.expressions import clamp
from quernstone.sources.files import read_jsonl, write_jsonl

#: An episode: the answers' text blocks in order, and an error if it broke off.
SCHEMA = "complaint_id string, responses array<string>, error string"
#: What a text block must hold to be a decision.
DECISION = "disposition string, confidence double"


def write(episodes: DataFrame, path: str) -> None:
    write_jsonl(episodes.select("complaint_id", "responses", "error"), path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Episodes; blank lines are skipped, a corrupt line ends the job."""
    return read_jsonl(spark, path, spark.createDataFrame([], SCHEMA).schema)


def decisions(episodes: DataFrame) -> DataFrame:
    """(complaint_id, disposition, confidence, rejection): the first block that parses to an object with a disposition.

    Confidence is clamped to [0, 1]. An episode without such a block is undecided: disposition none, confidence 0, rejection
    no_decision. One that broke off has rejection api_error and counts in no metric.
    """
    parsed = F.filter(F.transform("responses", lambda b: F.from_json(b, DECISION)), lambda d: d["disposition"].isNotNull())
    first = F.try_element_at(parsed, F.lit(1))
    rows = episodes.withColumn("d", first)
    rejection = F.when(F.col("error").isNotNull(), "api_error").when(F.col("d").isNull(), "no_decision")
    return rows.select("complaint_id", F.coalesce("d.disposition", F.lit("none")).alias("disposition"), F.coalesce(clamp(F.col("d.confidence")), F.lit(0.0)).alias("confidence"), rejection.alias("rejection"))


def scorable(decided: DataFrame) -> DataFrame:
    """Without episodes that broke off. Null-safe: most rows have no rejection."""
    return decided.where(~F.col("rejection").eqNullSafe("api_error"))
