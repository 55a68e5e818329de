"""Filling containers of fixed capacity, with a bound that certifies how few containers suffice.

Items are spread over groups of bounded size and each group is packed best fit decreasing. Dual feasible functions give a
lower bound on a group's containers; a group that meets its bound is certified and final. Groups with a gap keep their
well filled containers and give up the documents of the others; those are pooled, spread anew and packed again. The pool shrinks
from round to round until one group, or the last round, packs the rest. What is left open is reported: every group with its
containers, its bound and the gap, and the same for all items together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quernstone.plans.session import checkpointed

#: Items packed together in one task.
GROUP_ITEMS = 40_000
#: A group with a gap gives up its containers that have more than this share of the capacity free.
LOOSE = 0.01
ROUNDS = 4


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that any packing of ``sizes`` needs: the best of the bounds by dual feasible functions."""
    return bound_of(np.bincount(sizes, minlength=capacity + 1), capacity)


def bound_of(count: np.ndarray, capacity: int) -> int:
    """The same from how many items there are of each size from 0 to ``capacity``."""
    count, x = count.astype(np.int64), np.arange(capacity + 1)
    if not count[1:].any():
        return 0
    total = int((count * x).sum())
    best = -(-total // capacity)
    # sizes above capacity - e count whole, those below e not at all
    below, above = np.cumsum(count * x), np.cumsum(count[::-1])[::-1]
    for e in np.flatnonzero(count[: capacity // 2 + 1]):
        if e:
            whole = int(above[capacity - e + 1]) if e <= capacity else 0
            middle = int(below[capacity - e] - below[e - 1])
            best = max(best, whole - (-middle // capacity))
    # steps of 1 / k: x counts floor((k + 1) x) / k, and itself where (k + 1) x is whole
    for k in range(1, 33):
        scaled = (k + 1) * x
        whole = scaled % capacity == 0
        part = int((count * np.where(whole, 0, scaled // capacity)).sum()) * capacity + int((count * np.where(whole, x, 0)).sum()) * k
        best = max(best, -(-part // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item. Largest first, each into the fullest container that has room for it."""
    out = np.empty(len(sizes), np.int64)
    with_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0  # bit f of mask: some container has f free
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = mask >> s
        if fits:
            free = s + (fits & -fits).bit_length() - 1
            b = with_free[free].pop()
            if not with_free[free]:
                mask &= ~(1 << free)
        else:
            free, b = capacity, bins
            bins += 1
        out[i] = b
        if free > s:
            with_free[free - s].append(b)
            mask |= 1 << (free - s)
    return out


def _pack_group(items: pd.DataFrame, capacity: int) -> pd.DataFrame:
    items = items.sort_values(["row"], kind="stable").reset_index(drop=True)  # a retried task gives the same containers
    sizes = items["size"].to_numpy(np.int64)
    bins = best_fit_decreasing(sizes, capacity)
    n, bound = int(bins.max()) + 1, lower_bound(sizes, capacity)
    fill = np.bincount(bins, weights=sizes, minlength=n)
    final = np.full(n, n <= bound) | (fill >= capacity * (1 - LOOSE))
    return items.assign(bin=bins, final=final[bins], bound=bound)


@dataclass(frozen=True)
class Packed:
    """``placements``: key, part, n_parts, size, container. ``groups``: one row for every group packed in any round, see ``pack``.
    ``whole``: one row for all containers, with the bound by all sizes together."""

    placements: DataFrame
    groups: DataFrame
    whole: DataFrame


def pack(df: DataFrame, key: str, size: str, capacity: int) -> Packed:
    """Placements (``key, part, n_parts, size, container``) and what certifies them.

    groups: ``round, grp, n_items, containers, bound, gap`` (containers beyond the bound), ``kept`` (containers that are final; the
    items of the others went on to the next round), ``unused`` (share of the capacity of all its containers left free). A group
    without gap is certified: no packing of its items needs fewer. whole: ``containers, bound, gap, unused`` over all items.

    Only an item larger than ``capacity`` is split: into full containers of its own (part 0, 1, ...) and a rest that is
    placed like any item. An item of size 0 or null takes no room and has no container (null, part 0, n_parts 0). A negative
    size raises. ``key`` should be unique; rows that repeat are items of their own. Keys may be null. Container ids
    are unique, not dense. Further columns of ``df`` are left out. An empty table gives no rows, and zeros as a whole.
    """
    whole = F.coalesce(F.col(size).cast("long"), F.lit(0))
    base = df.select(F.col(key).alias("item"), F.when(whole < 0, F.raise_error(F.lit("negative size")).cast("long")).otherwise(whole).alias("whole"))
    # rows are numbered once, in the checkpoint; later reads and retries see the same numbers
    base = checkpointed(base.withColumn("row", F.monotonically_increasing_id()))
    base = base.withColumn("n_parts", F.ceil(F.col("whole") / capacity).cast("int"))
    pieces = base.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_parts") - 1, F.lit(0)))))
    pieces = pieces.withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("whole") - F.col("part") * capacity)).drop("whole")
    result = ["item", "part", "n_parts", "size", "container"]
    placed = pieces.where(F.col("size") == 0).withColumn("container", F.lit(None).cast("string")).select(result)
    placed = placed.unionAll(pieces.where(F.col("size") == capacity).withColumn("container", F.concat_ws("-", F.lit("full"), "row", "part")).select(result))
    pool = pieces.where((F.col("size") > 0) & (F.col("size") < capacity))
    fields = ", ".join(f"{c} {kind}" for c, kind in pool.dtypes) + ", grp int, bin long, final boolean, bound long"
    # at most one row for each size
    sizes = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect():
        sizes[r["size"]] = r["n"]
    rounds = []
    for turn in range(ROUNDS):
        n = pool.count()
        if not n:
            break
        groups = -(-n // GROUP_ITEMS)
        spread = pool.withColumn("grp", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups)).cast("int"))
        done = checkpointed(spread.groupBy("grp").applyInPandas(lambda g: _pack_group(g, capacity), fields))
        packed = done.groupBy("grp").agg(F.count("*").alias("n_items"), F.count_distinct("bin").alias("containers"), F.max("bound").alias("bound"), F.sum("size").alias("filled"), F.count_distinct(F.when(F.col("final"), F.col("bin"))).alias("kept"))
        last = turn == ROUNDS - 1 or groups == 1  # one group has nobody to exchange with
        rounds.append(packed.select(F.lit(turn).alias("round"), "grp", "n_items", "containers", "bound", (F.col("containers") - F.col("bound")).alias("gap"), (F.col("containers") if last else F.col("kept")).alias("kept"), (1 - F.col("filled") / (F.col("containers") * capacity)).alias("unused")))
        kept = done if last else done.where("final")
        placed = placed.unionAll(kept.withColumn("container", F.concat_ws("-", F.lit(f"r{turn}"), "grp", "bin")).select(result))
        if last:
            break
        pool = done.where("not final").drop("grp", "bin", "final", "bound")
    groups = df.sparkSession.createDataFrame([], "round int, grp int, n_items long, containers long, bound long, gap long, kept long, unused double")
    for one in rounds:
        groups = groups.unionAll(one)
    bound = bound_of(sizes, capacity)
    whole = placed.where("container is not null").agg(F.count_distinct("container").alias("containers"), F.coalesce(F.sum("size"), F.lit(0)).alias("filled"))
    whole = whole.select("containers", F.lit(bound).cast("long").alias("bound"), (F.col("containers") - bound).alias("gap"), F.coalesce(1 - F.try_divide(F.col("filled"), F.col("containers") * capacity), F.lit(0.0)).alias("unused"))
    return Packed(placed.withColumnRenamed("item", key), groups, whole)
