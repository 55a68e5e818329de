"""A sample with given shares per category, by systematic sampling with unequal probabilities.

Rows are put in random order (a seeded hash) within sorted categories. The inclusion probability of a row is its category's
wanted number over the rows there are, one at most. The running sum of these probabilities over the whole order is had
from counts per (category, hash bucket) and a row's rank in its bucket; from one random start, each row over which the sum
passes an integer is taken. Categories that stayed under their floor are then filled up from their next rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quernstone.plans.session import checkpointed

#: Rows that share a hash bucket, on average; one task ranks them together.
BUCKET_ROWS = 50_000


def _unit(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) from a seeded hash."""
    return (F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit((1 << 53) - 1))).cast("double") / float(1 << 53)


def systematic_sample(df: DataFrame, targets: DataFrame, stratum: str, category: str, key: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``(sample, report)`` for ``targets(stratum, category, target_share, min_rows, sample_fraction)``.

    sample: rows of ``df`` with ``sampled_by`` (systematic or floor). report: one row per target with ``n_rows`` (there are),
    ``n_stratum``, ``wanted`` (target_share * sample_fraction * n_stratum, unrounded), ``n_sampled``, ``target_met`` (false where
    the draw took all rows of the cell and still has fewer than wanted), ``floor_met``. Rows whose (stratum, category) has no target, null ones too, are never drawn but
    count in ``n_stratum``; rows with a null stratum belong to no stratum. ``key`` orders ties of the hash; equal keys hash
    alike, so repeated rows are ranked side by side. Targets are a small table of parameters: they are collected, and two
    for one cell raise. Empty tables give an empty sample and a report of zeros. A column named sampled_by, or starting
    with two underscores, raises.
    """
    if clash := {c for c in df.columns if c.startswith("__")} | {"sampled_by"} & {*df.columns}:
        raise ValueError(f"column names in the way: {sorted(clash)}")
    spark = df.sparkSession
    counts = df.groupBy(F.col(stratum).alias("s"), F.col(category).alias("c")).agg(F.count("*").alias("n"))
    goals = targets.select(F.col(stratum).alias("s"), F.col(category).alias("c"), F.col("target_share").cast("double").alias("share"), F.coalesce(F.col("min_rows"), F.lit(0)).cast("long").alias("floor"), F.col("sample_fraction").cast("double").alias("fraction"))
    per_stratum = counts.groupBy("s").agg(F.sum("n").alias("n_stratum"))
    cells = goals.join(counts, ["s", "c"], "left").join(per_stratum, "s", "left").na.fill(0, ["n", "n_stratum"])
    cells = sorted(cells.collect(), key=lambda r: (r["s"] is None, r["s"] or "", r["c"] is None, r["c"] or ""))
    if len({(r["s"], r["c"]) for r in cells}) < len(cells):
        raise ValueError("two targets for one cell")
    # one row per target: wanted number, inclusion probability, sum of probabilities before the cell
    plan, before = [], 0.0
    for i, r in enumerate(cells):
        wanted = (r["share"] or 0.0) * (r["fraction"] or 0.0) * r["n_stratum"]
        p = min(1.0, wanted / r["n"]) if r["n"] else 0.0
        plan.append((r["s"], r["c"], i, p, before, min(r["floor"], r["n"]), r["n"], r["n_stratum"], wanted, r["floor"]))
        before += p * r["n"]
    kind = dict(df.dtypes)
    dim = spark.createDataFrame(plan, f"__s {kind[stratum]}, __c {kind[category]}, __cell int, __p double, __before double, __floor long, __n long, __n_stratum long, __wanted double, __min long")
    start = spark.range(1).select(_unit(seed, F.lit("start")).alias("u")).first()["u"]
    total = sum(r["n"] for r in cells)
    buckets = max(1, -(-total // BUCKET_ROWS))

    rows = df.join(F.broadcast(dim.select("__s", "__c", "__cell", "__p", "__before", "__floor")), (F.col(stratum) == F.col("__s")) & (F.col(category) == F.col("__c"))).drop("__s", "__c")
    rows = rows.withColumn("__h", _unit(seed, F.col(key))).withColumn("__bucket", F.floor(F.col("__h") * buckets).cast("int"))
    sizes = rows.groupBy("__cell", "__bucket").agg(F.count("*").alias("__size"))
    running = Window.partitionBy("__cell").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__cell", "__bucket", F.coalesce(F.sum("__size").over(running), F.lit(0)).alias("__offset"))
    rank = F.row_number().over(Window.partitionBy("__cell", "__bucket").orderBy("__h", key))
    ranked = rows.withColumn("__rank", rank).join(offsets, ["__cell", "__bucket"]).withColumn("__rank", F.col("__rank") + F.col("__offset"))
    # both ends are computed alike, so that the end of a row is the beginning of the next and no integer is passed twice
    at = lambda k: F.floor(F.col("__before") + F.col("__p") * k + F.lit(start))
    drawn = ranked.withColumn("__taken", (F.col("__p") >= 1) | (at(F.col("__rank")) > at(F.col("__rank") - 1)))
    drawn = checkpointed(drawn.drop("__offset", "__bucket", "__before", "__p", "__h"))

    got = {r["__cell"]: r["n"] for r in drawn.where("__taken").groupBy("__cell").agg(F.count("*").alias("n")).collect()}
    short = {p[2]: p[5] - got.get(p[2], 0) for p in plan if p[5] > got.get(p[2], 0)}
    sample = drawn.where("__taken").withColumn("sampled_by", F.lit("systematic"))
    if short:
        need = F.create_map(*[F.lit(x) for pair in short.items() for x in pair])
        # the k-th row left over has at most k + (rows drawn) as its rank, so only the first ranks are looked at
        reach = {c: k + got.get(c, 0) for c, k in short.items()}
        near = F.create_map(*[F.lit(x) for pair in reach.items() for x in pair])
        spare = drawn.where(~F.col("__taken") & F.col("__cell").isin([*short])).where(F.col("__rank") <= F.try_element_at(near, F.col("__cell")))
        nth = F.row_number().over(Window.partitionBy("__cell").orderBy("__rank"))
        filled = spare.withColumn("__nth", nth).where(F.col("__nth") <= F.try_element_at(need, F.col("__cell"))).drop("__nth")
        sample = sample.unionAll(filled.withColumn("sampled_by", F.lit("floor")))
    sample = sample.select(*df.columns, "sampled_by")

    drawn_counts = sample.groupBy(F.col(stratum).alias("__s"), F.col(category).alias("__c")).agg(F.count("*").alias("n_sampled"))
    got = F.coalesce("n_sampled", F.lit(0))
    report = dim.join(drawn_counts, ["__s", "__c"], "left").select(
        F.col("__s").alias(stratum), F.col("__c").alias(category), F.col("__n").alias("n_rows"), F.col("__n_stratum").alias("n_stratum"), F.col("__wanted").alias("wanted"),
        F.coalesce("n_sampled", F.lit(0)).alias("n_sampled"), ((got >= F.col("__wanted")) | (got < F.col("__n"))).alias("target_met"), (got >= F.col("__min")).alias("floor_met"),
    )
    return sample, report
