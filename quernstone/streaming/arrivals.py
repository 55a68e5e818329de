"""Records as they arrive: the same typing and de-duplication on a stream, and counts by day of receipt.

The reference results have no streaming operator; this is the batch logic on ``readStream``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quernstone.operators.delivery import blank_to_null
from quernstone.operators.records import typed


def first_deliveries(stream: DataFrame, ident: str, at: str, late: str = "2 days") -> DataFrame:
    """One delivery of each identifier within ``late`` of event time; blank identifiers are left out.

    State holds identifiers only until the watermark passes them, so it doesn't grow with the stream.
    """
    keyed = stream.withColumn("__id", blank_to_null(F.col(ident))).where("__id is not null").withColumn("__at", F.col(at).cast("timestamp"))
    return keyed.withWatermark("__at", late).dropDuplicatesWithinWatermark(["__id"]).drop("__id", "__at")


def typed_stream(stream: DataFrame) -> DataFrame:
    """Typed rows of a stream; rows that can't be typed carry their problem."""
    return typed(stream)


def windowed_counts(stream: DataFrame, at: str, width: str, by: list[str], late: str = "2 days") -> DataFrame:
    """Rows per window of event time and ``by``; a window is final when the watermark has passed it."""
    timed = stream.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    out = timed.groupBy(F.window("__at", width).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n")
