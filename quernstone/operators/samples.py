"""Samples that any engine with MD5 can draw again: order is a seeded hash of the id, never a random stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def shuffled(seed: str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key))


def stratified(df: DataFrame, stratum: str, key: str, per_stratum: int, seed: str) -> DataFrame:
    """``per_stratum`` rows of each stratum (a small one whole) with ``weight``: rows of the stratum over rows taken.

    The rank is bounded by a constant, so every task first cuts its own rows to as many (window group limit) and no stratum is
    gathered. Null strata are a stratum of their own; ties of the hash go by id.
    """
    w = Window.partitionBy(stratum).orderBy(shuffled(seed, F.col(key)), key)
    taken = df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= per_stratum).drop("__rank")
    sizes = df.groupBy(F.col(stratum).alias("__s")).agg(F.count("*").alias("__n"))
    joined = taken.join(sizes, F.col(stratum).eqNullSafe(F.col("__s")))
    return joined.withColumn("weight", F.col("__n") / F.least(F.col("__n"), F.lit(per_stratum))).drop("__s", "__n")


def first_per_cell(df: DataFrame, cells: Column, key: str, order: Column, per_cell: int) -> DataFrame:
    """Keys of rows that are among the first ``per_cell`` of any of their cells (an array of strings)."""
    each = df.select(key, order.alias("__o"), F.explode(cells).alias("__cell"))
    rank = F.row_number().over(Window.partitionBy("__cell").orderBy("__o"))
    return each.withColumn("__r", rank).where(F.col("__r") <= per_cell).select(key).distinct()


def filled(df: DataFrame, chosen: DataFrame, key: str, target: int, seed: str) -> DataFrame:
    """Rows of ``chosen`` keys, and of the others as many in seeded order as are missing to ``target``."""
    have = chosen.count()
    rest = df.join(chosen, key, "left_anti").orderBy(shuffled(seed, F.col(key)), key).limit(max(0, target - have))
    return df.join(chosen, key, "left_semi").unionByName(rest)
