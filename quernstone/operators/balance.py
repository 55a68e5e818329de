"""Per-key results without straggling tasks: fragment-replicate by estimated load.

Every key's load is counted with map-side combining. Keys heavier than a share of a task are cut into shards in proportion
to their load; all other keys fall into a fixed number of hash slots. Shards and slots are packed onto tasks, heaviest
first, each onto the task with least load. Rows go to the task that holds their shard, and rows of a matching (small) side
are replicated to the shards of their key and to nothing else.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from quernstone.plans.session import default_tasks

#: Hash slots that light keys share. Fixed: the table of their loads has as many rows however many keys there are.
SLOTS = 1024
#: A key is heavy when it holds more than this share of one task's load; so there are at most tasks / HEAVY heavy keys.
HEAVY = 0.25


@dataclass(frozen=True)
class Plan:
    """Placement of keys. ``heavy`` maps a key to the tasks of its shards, ``slot_task`` a slot to its task."""

    tasks: int
    heavy: dict[str, list[int]]
    slot_task: list[int]
    loads: list[int]


def pack(heavy: dict[str, int], slots: dict[int, int], tasks: int) -> Plan:
    """Longest-processing-time packing of shards and slots onto ``tasks`` tasks."""
    total = sum(heavy.values()) + sum(slots.values())
    target = max(1, -(-total // tasks))
    pieces: list[tuple[int, str | int, int]] = []
    for key, n in heavy.items():
        shards = min(tasks, max(1, -(-n // max(1, int(target * HEAVY)))))
        pieces += [(n // shards + (i < n % shards), key, i) for i in range(shards)]
    pieces += [(n, slot, 0) for slot, n in slots.items()]
    heap = [(0, t) for t in range(tasks)]
    placed: dict[str, list[int]] = {key: [] for key in heavy}
    slot_task = [slot % tasks for slot in range(SLOTS)]
    loads = [0] * tasks
    for n, what, _ in sorted(pieces, key=lambda x: (-x[0], str(x[1]), x[2])):
        load, t = heapq.heappop(heap)
        heapq.heappush(heap, (load + n, t))
        loads[t] += n
        if isinstance(what, str):
            placed[what].append(t)
        else:
            slot_task[what] = t
    return Plan(tasks, placed, slot_task, loads)


def slot_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")


def plan_load(df: DataFrame, key: str, tasks: int | None = None) -> Plan:
    """Count every key and pack. What reaches the driver is bounded: ``SLOTS`` loads and at most ``tasks / HEAVY`` keys."""
    tasks = tasks or default_tasks(df.sparkSession)
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    total = df.agg(F.count(key).alias("n")).first()["n"]
    limit = max(1, int(HEAVY * total / tasks))
    marked = counts.withColumn("heavy", F.when(F.col("n") > limit, F.col("k")))
    rows = marked.groupBy("heavy", F.when(F.col("heavy").isNull(), slot_of(F.col("k"))).alias("slot")).agg(F.sum("n").alias("n")).collect()
    return pack({r["heavy"]: r["n"] for r in rows if r["heavy"] is not None}, {r["slot"]: r["n"] for r in rows if r["heavy"] is None}, tasks)


def _placement(df: DataFrame, key: str, plan: Plan) -> tuple[DataFrame, Column]:
    """``df`` with the array of its key's shard tasks (null for light keys), and the task of a light key."""
    spark = df.sparkSession
    heavy = spark.createDataFrame([(k, t) for k, t in plan.heavy.items()], T.StructType([T.StructField("__k", T.StringType()), T.StructField("__shards", T.ArrayType(T.IntegerType()))]))
    # at most tasks / HEAVY rows, see plan_load
    marked = df.join(F.broadcast(heavy), F.col(key) == F.col("__k"), "left").drop("__k")
    tasks = F.split(F.lit(",".join(map(str, plan.slot_task))), ",").cast("array<int>")  # folded to a literal
    light = F.element_at(tasks, slot_of(F.col(key)) + 1)
    return marked, light


def fragment(df: DataFrame, key: str, plan: Plan, spread: Sequence[str]) -> DataFrame:
    """Rows with ``__task`` and ``__shard``, moved to their task. ``spread``: columns whose hash picks a heavy key's shard."""
    marked, light = _placement(df, key, plan)
    shard = F.pmod(F.xxhash64(*spread), F.coalesce(F.size("__shards"), F.lit(1))).cast("int")
    out = marked.withColumn("__shard", F.when(F.col("__shards").isNotNull(), shard).otherwise(F.lit(0)))
    out = out.withColumn("__task", F.coalesce(F.try_element_at("__shards", F.col("__shard") + 1), light, F.lit(0))).drop("__shards")
    return out.repartitionById(plan.tasks, F.col("__task"))


def replicate(df: DataFrame, key: str, plan: Plan) -> DataFrame:
    """Rows of the matching side, once for each shard of their key."""
    marked, _ = _placement(df, key, plan)
    return marked.withColumn("__shard", F.explode(F.sequence(F.lit(0), F.coalesce(F.size("__shards"), F.lit(1)) - 1))).drop("__shards")


def balanced_aggregate(df: DataFrame, key: str, aggregates: dict[str, tuple[str, Column]], side: DataFrame | None = None, spread: Sequence[str] | None = None, tasks: int | None = None) -> DataFrame:
    """Aggregates per key, computed shard by shard and then merged, joined with ``side`` on the way if given.

    ``aggregates``: name -> (kind, column) with kind sum, min or max; a count is the sum of ones. Rows with a null key
    belong to no key and are left out. ``side`` needs ``key``; of several side rows with one key the least (compared column
    by column) counts; keys absent from it get nulls. ``df`` and ``side`` may share column names, since of ``df`` only the
    aggregates come out; an aggregate named like a side column raises. An empty ``df`` gives no rows. Ties and repeated
    rows of ``df`` count as they stand.
    """
    clash = {c for c in df.columns if c in ("__k", "__shards", "__shard", "__task")} | ({*side.columns} & {*aggregates} if side is not None else set())
    if clash:
        raise ValueError(f"column names in the way: {sorted(clash)}")
    used = df.where(F.col(key).isNotNull())
    plan = plan_load(used, key, tasks)
    moved = fragment(used, key, plan, list(spread or df.columns))
    merge = {"sum": F.sum, "min": F.min, "max": F.max}
    shards = moved.groupBy(key, "__task", "__shard").agg(*[merge[kind](c).alias(name) for name, (kind, c) in aggregates.items()])
    kept = []
    if side is not None:
        rest = [c for c in side.columns if c != key]
        side = side.groupBy(key).agg(F.min(F.struct(*rest)).alias("__side")).select(key, *[F.col("__side")[c].alias(c) for c in rest])
        # one row per shard is left of the large side here, so the replicas meet shards, not rows
        shards = shards.join(replicate(side, key, plan), [key, "__shard"], "left")
        kept = [F.first(c).alias(c) for c in rest]
    return shards.groupBy(key).agg(*[merge[kind](name).alias(name) for name, (kind, _) in aggregates.items()], *kept)
