from collections import Counter

import pytest
from pyspark.sql import functions as F

from quernstone.operators.balance import balanced_aggregate, fragment, pack, plan_load



def figures():
    return {"n": ("sum", F.lit(1)), "least": ("min", F.col("v")), "most": ("max", F.col("v"))}


def rows(spark, data):
    return spark.createDataFrame(data, "k string, v int, name string")


def test_equals_plain_aggregate_with_a_hot_key(spark):
    data = [("hot", i, "x") for i in range(3000)] + [(f"k{i % 50}", i, "x") for i in range(3000)] + [(None, 1, "x")] * 10
    got = {r["k"]: (r["n"], r["least"], r["most"]) for r in balanced_aggregate(rows(spark, data), "k", figures(), tasks=6).collect()}
    want = {}
    for k, v, _ in data:
        if k is not None:
            n, a, b = want.get(k, (0, v, v))
            want[k] = (n + 1, min(a, v), max(b, v))
    assert got == want


def test_hot_key_is_spread_and_tasks_are_even(spark):
    df = rows(spark, [("hot", i, "") for i in range(4000)] + [(f"k{i}", i, "") for i in range(8000)])
    plan = plan_load(df, "k", 8)
    assert len(plan.heavy["hot"]) > 1
    sizes = [r["n"] for r in fragment(df, "k", plan, ["v"]).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.5 * 12000 / 8


def test_side_is_joined_once_and_may_share_names(spark):
    df = rows(spark, [("a", 1, "big"), ("a", 2, "big"), ("b", 3, "big")])
    side = spark.createDataFrame([("a", "A"), ("a", "B"), ("c", "C")], "k string, name string")
    got = {r["k"]: (r["n"], r["name"]) for r in balanced_aggregate(df, "k", figures(), side).collect()}
    assert got == {"a": (2, "A"), "b": (1, None)}


def test_empty_and_clashing(spark):
    assert balanced_aggregate(rows(spark, []), "k", figures()).count() == 0
    with pytest.raises(ValueError):
        balanced_aggregate(rows(spark, []).withColumnRenamed("name", "__task"), "k", figures())


def test_pack_splits_in_proportion():
    plan = pack({"big": 600, "mid": 200}, {i: 1 for i in range(200)}, 16)
    assert max(plan.loads) - min(plan.loads) <= 20 and sum(plan.loads) == 1000
    assert len(plan.heavy["big"]) > len(plan.heavy["mid"])
    assert set(Counter(plan.slot_task)) <= set(range(16))
