import hashlib
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quernstone.operators import bootstrap as B, metrics as M


def test_draws_equal_the_operators_on_resampled_rows(spark):
    r = random.Random(5)
    rows = [(f"{i:03d}", round(r.random(), 1), round(r.random(), 1), int(r.random() < 0.3)) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, c double, q double, y int")
    drawn = M.resampled(df, ["id"], 8, "s")
    points = M.frontier(drawn, w="k", by=["draw"]).collect()
    each = drawn.withColumn("e", F.explode(F.sequence(F.lit(1), F.col("k"))))
    auc = {s: {x["draw"]: x["auc"] for x in M.ranking(each, s, "y", ["draw"]).collect()} for s in ("c", "q")}
    got = {(x["draw"], x["target"]): x["arr"] for x in B.shares(df, "id", "c", "y", [0.1, 0.25], 8, "s").collect()}
    assert got == {(d, t): max([p["n_auto"] for p in points if p["draw"] == d and p["n_false"] <= t * p["n_auto"]], default=0) / 60 for d in range(8) for t in (0.1, 0.25)}
    gained = {x["draw"]: x["gain"] for x in B.gains(df, "id", "y", [("q", "c")], 8, "s").collect()}
    assert gained == pytest.approx({d: auc["c"][d] - auc["q"][d] for d in range(8)})


def test_picks_are_md5_at_every_length():
    for start, n in ((b"s:0:", 12_001), (b"x" * 51, 12_001), (b"x" * 60, 12), (b"s:1:", 0)):
        assert B._picks(start, n).tolist() == [int.from_bytes(hashlib.md5(start + b"%d" % j).digest()[:4], "big") for j in range(n)]


def test_draws_with_one_outcome_have_no_gain(spark):
    df = spark.createDataFrame([("a", 0.1, 0.2, 0), ("b", 0.3, 0.4, 0)], "id string, p double, q double, y int")
    assert B.gains(df, "id", "y", [("p", "q")], 3, "s").count() == 0


def test_full_intervals_use_the_references_draws_and_every_budget(spark, sf_dir):
    from quernstone.plans import evaluation as E

    assert E.FULL_DRAWS == 1000 and "range(1000)" in entry.oracle_sql()["bootstrap_arr_full"]
    assert sorted(r["target"] for r in entry.queries()["bootstrap_arr_full"](spark, sf_dir).collect()) == E.TARGETS
