"""Measuring any decider that states a confidence: error-budget frontier, calibration, ranking, bootstrap.

Every function takes rows with a confidence, an outcome (1 where an unattended decision would have been wrong) and, where given, a
weight. Equal confidences are collapsed first, so ordered steps run over distinct confidences, not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ONE = F.lit


def _collapsed(df: DataFrame, c: str, y: Column, w: Column, by: list[str]) -> DataFrame:
    return df.groupBy(*by, c).agg(F.sum(w).alias("w"), F.sum(w * y).alias("wy"))


def frontier(df: DataFrame, c: str = "c", y: str = "y", w: str | None = None, by: list[str] | None = None) -> DataFrame:
    """(tau, n_auto, n_false) at every distinct confidence: weight decided at or above it, and of that the wrong weight.

    Rows with a null confidence or outcome are left out. No rows give no points. ``by``: a frontier for each group.

    Without groups the running sum is had in two steps: within hash-free ranges of the confidence, and over their totals, so it
    doesn't go through one task.
    """
    by = by or []
    points = _collapsed(df.where(F.col(c).isNotNull() & F.col(y).isNotNull()), c, F.col(y), F.col(w) if w else F.lit(1), by)
    slot = F.floor(F.greatest(F.least(F.col(c), F.lit(1.0)), F.lit(0.0)) * 64).cast("int")
    points = points.withColumn("__slot", slot)
    inside = Window.partitionBy(*by, "__slot").orderBy(F.col(c).desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = points.withColumns({"__w": F.sum("w").over(inside), "__y": F.sum("wy").over(inside)})
    totals = points.groupBy(*by, "__slot").agg(F.sum("w").alias("tw"), F.sum("wy").alias("ty"))
    # 65 slots at most in each group
    above = Window.partitionBy(*by, *([] if by else [F.lit(0)])).orderBy(F.col("__slot").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__slot", F.coalesce(F.sum("tw").over(above), F.lit(0)).alias("ow"), F.coalesce(F.sum("ty").over(above), F.lit(0)).alias("oy"))
    joined = run.join(F.broadcast(offsets) if not by else offsets, [*by, "__slot"])
    return joined.select(*by, F.col(c).alias("tau"), (F.col("__w") + F.col("ow")).alias("n_auto"), (F.col("__y") + F.col("oy")).alias("n_false"))


def rates(n_auto: Column, n_false: Column, total: Column) -> tuple[Column, Column]:
    """Share decided unattended, and share of that which is wrong; 0 where nothing is divided by."""
    return F.coalesce(F.try_divide(n_auto, total), F.lit(0.0)), F.coalesce(F.try_divide(n_false, n_auto), F.lit(0.0))


def best_at(points: DataFrame, targets: list[float], total: float) -> DataFrame:
    """For each budget the point that decides most within it, among all points; nulls where none does."""
    wanted = points.sparkSession.createDataFrame([(t,) for t in targets], "target double")
    # targets are a short list of parameters
    within = points.join(F.broadcast(wanted), F.col("n_false") <= F.col("target") * F.col("n_auto"))
    best = within.groupBy("target").agg(F.max(F.struct("n_auto", "tau", "n_false")).alias("p"))
    arr, frr = rates(F.col("p.n_auto"), F.col("p.n_false"), F.lit(float(total)))
    out = wanted.join(best, "target", "left")
    return out.select("target", F.col("p.tau").alias("tau"), F.col("p.n_auto").alias("n_auto"), F.col("p.n_false").alias("n_false"), F.when(F.col("p").isNotNull(), arr).alias("arr"), F.when(F.col("p").isNotNull(), frr).alias("frr"))


def bin_of(c: Column, bins: int) -> Column:
    """Equal bins, closed on the right; 0 belongs to the first."""
    return F.least(F.greatest(F.ceil(F.round(c * bins, 9)).cast("int") - 1, F.lit(0)), F.lit(bins - 1))


def reliability(df: DataFrame, c: str = "c", y: str = "y", w: str | None = None, bins: int = 10) -> DataFrame:
    """(bin, n, stated, observed): stated is the mean confidence, observed the share that was right."""
    weight = F.col(w) if w else F.lit(1)
    rows = df.where(F.col(c).isNotNull() & F.col(y).isNotNull()).groupBy(bin_of(F.col(c), bins).alias("bin"))
    sums = rows.agg(F.sum(weight).alias("n"), F.sum(weight * F.col(c)).alias("sc"), F.sum(weight * (1 - F.col(y))).alias("sr"))
    return sums.select("bin", "n", (F.col("sc") / F.col("n")).alias("stated"), (F.col("sr") / F.col("n")).alias("observed"))


def ece(df: DataFrame, c: str = "c", y: str = "y", w: str | None = None, bins: int = 10) -> DataFrame:
    """One row: expected calibration error; 0 for no rows."""
    table = reliability(df, c, y, w, bins)
    gap = F.sum(F.col("n") * F.abs(F.col("stated") - F.col("observed"))) / F.sum("n")
    return table.agg(F.coalesce(gap, F.lit(0.0)).alias("ece"))


def ranking(df: DataFrame, score: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve (ties count half), average precision and Brier score of P(y = 1) = ``score``; one row a group.

    With one outcome only the area is null.
    """
    by = by or []
    rows = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    brier = rows.groupBy(*by).agg(F.avg(F.pow(F.col(score) - F.col(y), 2)).alias("brier"))
    # distinct scores only; within a group their running sums go over what grouping left
    points = frontier(rows, score, y, by=by)
    w = Window.partitionBy(*by, *([] if by else [F.lit(0)])).orderBy(F.col("tau").desc())
    step = points.withColumns({"pos": F.col("n_false") - F.coalesce(F.lag("n_false").over(w), F.lit(0)), "all": F.col("n_auto") - F.coalesce(F.lag("n_auto").over(w), F.lit(0))})
    step = step.withColumns({"neg": F.col("all") - F.col("pos"), "neg_below": F.col("n_auto") - F.col("n_false")})
    sums = step.groupBy(*by).agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("pos") * (F.col("neg_below") - F.col("neg") / 2)).alias("lost"), F.sum(F.col("pos") * F.col("n_false") / F.col("n_auto")).alias("ap")
    )
    out = sums.select(*by, F.when((F.col("p") > 0) & (F.col("n") > 0), 1 - F.col("lost") / (F.col("p") * F.col("n"))).alias("auc"), F.try_divide("ap", "p").alias("average_precision"))
    return out.join(brier, by) if by else out.crossJoin(F.broadcast(brier))  # one row each


def draw_index(seed: str, draw: Column, i: Column, n: int) -> Column:
    """Index in [0, n) of the i-th pick of a draw; the same in any engine with MD5."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), draw.cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(n))


def resampled(df: DataFrame, order: list[str], draws: int, seed: str) -> DataFrame:
    """``draws`` samples with replacement, as ``draw`` and a multiplicity ``k`` for each row that was picked.

    Rows are numbered by ``order``. The numbering sorts (evaluation sets are numbered, not corpora); picks are grouped per
    (draw, index) before they meet the rows, so what is shuffled is at most draws * n narrow rows.
    """
    spark = df.sparkSession
    n = df.count()
    numbered = df.withColumn("__i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1)
    picks = spark.range(draws * n).select(F.expr(f"id div {max(n, 1)}").alias("draw"), F.expr(f"id % {max(n, 1)}").alias("i"))
    picks = picks.select("draw", draw_index(seed, F.col("draw"), F.col("i"), max(n, 1)).alias("__i")).groupBy("draw", "__i").agg(F.count("*").alias("k"))
    return picks.join(numbered, "__i").drop("__i")


def envelope(points: DataFrame, total: float, budgets: int = 301, widest: float = 0.30) -> DataFrame:
    """(budget, arr): the largest share decided at or under each of equally spaced budgets.

    Each point is put into the first budget that admits it; the envelope is then a running maximum over the budgets.
    """
    grid = points.sparkSession.range(budgets).select(F.col("id").cast("int").alias("b"), (F.col("id") * widest / (budgets - 1)).alias("budget"))
    frr = F.coalesce(F.try_divide("n_false", "n_auto"), F.lit(0.0))
    first = F.ceil(F.round(frr * (budgets - 1) / widest, 9)).cast("int")
    best = points.select(first.alias("b"), "n_auto").groupBy("b").agg(F.max("n_auto").alias("n_auto"))
    upto = Window.partitionBy(F.lit(0)).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)  # one row a budget
    return grid.join(best, "b", "left").select("budget", F.round(F.coalesce(F.max("n_auto").over(upto), F.lit(0)) / F.lit(float(total)), 9).alias("arr"))


def sweep(df: DataFrame, c: str = "c", y: str = "y", stops: int = 400) -> DataFrame:
    """(tau, n_auto, n_false) at equally spaced thresholds from 1 to 0, by counting into the stop at which a row first passes."""
    taus = df.sparkSession.range(stops).select(F.col("id").cast("int").alias("s"), F.round(1 - F.col("id") / (stops - 1), 6).alias("tau"))
    near = F.greatest(F.ceil((1 - F.col(c)) * (stops - 1) - 1e-3).cast("int") - 1, F.lit(0))
    tau_at = lambda k: F.round(1 - k / (stops - 1), 6)
    first = F.when(F.col(c) >= tau_at(near), near).when(F.col(c) >= tau_at(near + 1), near + 1).otherwise(near + 2)
    counts = df.where(F.col(c).isNotNull()).groupBy(first.alias("s")).agg(F.count("*").alias("n"), F.sum(y).alias("f"))
    upto = Window.partitionBy(F.lit(0)).orderBy("s").rowsBetween(Window.unboundedPreceding, 0)  # one row a stop
    return taus.join(counts, "s", "left").select("tau", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n_auto"), F.coalesce(F.sum("f").over(upto), F.lit(0)).alias("n_false"))
