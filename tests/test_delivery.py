from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quernstone.operators import delivery as D

SCHEMA = "d long, at timestamp_ntz, id string, payload string"


def written(spark, tmp_path, data, files=3):
    path = str(tmp_path / "raw")
    spark.createDataFrame(data, SCHEMA).repartition(files).write.parquet(path)
    return spark.read.parquet(path)


def t(n):
    return datetime(2026, 1, 1, 0, 0, n % 60, n)


def test_one_copy_by_time_then_delivery(spark, tmp_path):
    data = [(1, t(5), "a", "late"), (2, t(1), " a", "first"), (3, t(1), "a\t", "tie"), (4, t(2), "b", "only"), (5, t(0), None, "null"), (6, t(0), "  ", "blank"), (7, None, "c", "no time"), (8, t(1), "c", "timed")]
    out = {r["d"]: r["is_surplus"] for r in D.mark_deliveries(written(spark, tmp_path, data), "id", ["at", "d"]).collect()}
    assert {d for d, s in out.items() if s} == {1, 3, 8} and len(out) == 8


def test_exact_repeats_leave_one(spark, tmp_path):
    df = written(spark, tmp_path, [(1, t(1), "a", "x")] * 7 + [(2, t(1), "b", "y")])
    assert sorted(r["d"] for r in D.deduplicated(df, "id", ["at", "d"]).collect()) == [1, 2]


def test_hot_identifier_and_slices(spark, tmp_path, monkeypatch):
    data = [(i, t(i), "hot" if i % 3 == 0 else f"i{i % 400}", "p" * 50) for i in range(3000)]
    df = written(spark, tmp_path, data, files=5)
    whole = D.deduplicated(df, "id", ["at", "d"]).count()
    monkeypatch.setattr(D, "SLICE_BYTES", D.BLOCK_BYTES)
    assert D.deduplicated(df, "id", ["at", "d"]).count() == whole == len({r[2] for r in data})


def test_empty_and_clashing(spark, tmp_path):
    df = written(spark, tmp_path, [])
    assert D.deduplicated(df, "id", ["at", "d"]).count() == 0
    with pytest.raises(ValueError):
        D.mark_deliveries(df.withColumn("is_surplus", F.lit(1)), "id", ["at"])


def test_payload_is_not_shuffled(spark, tmp_path):
    df = written(spark, tmp_path, [(1, t(1), "a", "x"), (2, t(2), "a", "y")])
    plan = D.deduplicated(df, "id", ["at", "d"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
