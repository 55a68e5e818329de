"""As-of figures: what was known of an entity before the day of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Least number of earlier cases before a rate is stated.
LEAST_PRIOR = 30


def as_of(df: DataFrame, entity: str, day: str, counted: dict[str, Column]) -> DataFrame:
    """``df`` with sums of ``counted`` over the entity's rows of strictly earlier days.

    Rows are first summed per (entity, day) with map-side combining, and the running sum goes over days: an entity with a third of
    all rows still has few days, so no task holds its rows. Rows with a null entity or day get nulls and count for nobody.
    """
    daily = df.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).groupBy(entity, day).agg(*[F.sum(c).alias(n) for n, c in counted.items()])
    before = Window.partitionBy(entity).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    known = daily.select(F.col(entity).alias("__e"), F.col(day).alias("__d"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in counted])
    return df.join(known, (F.col(entity) == F.col("__e")) & (F.col(day) == F.col("__d")), "left").drop("__e", "__d")


def rate(numerator: Column, denominator: Column, least: int = LEAST_PRIOR) -> Column:
    """Null below ``least`` cases."""
    return F.when(denominator >= least, numerator / denominator)
