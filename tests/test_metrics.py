import itertools
import random

import pytest
from pyspark.sql import functions as F

from quernstone.operators import metrics as M


def df(spark, c, y, w=None):
    rows = [(float(a), int(b), float(x)) for a, b, x in zip(c, y, w or [1.0] * len(c))]
    return spark.createDataFrame(rows, "c double, y int, w double")


def points(frame):
    return [(r["tau"], r["n_auto"], r["n_false"]) for r in frame.orderBy(F.desc("tau")).collect()]


def test_ties_are_one_point(spark):
    assert points(M.frontier(df(spark, [0.9, 0.9, 0.5], [0, 1, 1]))) == [(0.9, 2, 1), (0.5, 3, 2)]


def test_empty_frontier_and_ece(spark):
    none = df(spark, [], [])
    assert points(M.frontier(none)) == [] and M.ece(none).first()[0] == 0.0


def test_best_is_not_the_first_crossing(spark):
    c = [0.9, 0.8] + [0.7] * 8
    f = M.frontier(df(spark, c, [0, 1] + [0] * 8))
    r = M.best_at(f, [0.1, 0.0], len(c)).orderBy("target").collect()
    assert (r[0]["n_auto"], r[0]["tau"]) == (1, 0.9) and (r[1]["n_auto"], r[1]["n_false"], r[1]["arr"]) == (10, 1, 1.0)


def test_unreachable_budget_gives_nulls(spark):
    r = M.best_at(M.frontier(df(spark, [0.9, 0.1], [1, 1])), [0.2], 2).collect()
    assert len(r) == 1 and r[0]["tau"] is None and r[0]["arr"] is None


def test_weighted_frontier(spark):
    assert points(M.frontier(df(spark, [0.9, 0.5], [1, 0], [2.0, 3.0]), w="w")) == [(0.9, 2.0, 2.0), (0.5, 5.0, 2.0)]


def test_bins_are_closed_on_the_right(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.10001, 0.3, 0.95, 1.0)], "c double").select(M.bin_of(F.col("c"), 10)).collect()]
    assert got == [0, 0, 1, 2, 9, 9]


def test_ece_by_hand(spark):
    # stated 0.9 and right half the time; stated 0.2 and never right
    got = M.ece(df(spark, [0.9, 0.9, 0.2, 0.2], [0, 1, 1, 1])).first()[0]
    assert got == pytest.approx(0.5 * 0.4 + 0.5 * 0.2)


@pytest.mark.parametrize("seed", [1, 2])
def test_area_is_the_pairwise_definition(spark, seed):
    r = random.Random(seed)
    p = [round(r.random(), 1) for _ in range(200)]
    y = [int(r.random() < x) for x in p]
    pos, neg = [a for a, b in zip(p, y) if b], [a for a, b in zip(p, y) if not b]
    want = sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)) / (len(pos) * len(neg))
    row = M.ranking(df(spark, p, y), "c", "y").first()
    assert row["auc"] == pytest.approx(want) and row["brier"] == pytest.approx(sum((a - b) ** 2 for a, b in zip(p, y)) / 200)


def test_one_outcome_has_no_area(spark):
    assert M.ranking(df(spark, [0.1, 0.2], [0, 0]), "c", "y").first()["auc"] is None


def test_sweep_equals_frontier_at_every_stop(spark):
    r = random.Random(3)
    c = [round(r.random(), 3) for _ in range(300)] + [0.0, 1.0]
    y = [int(r.random() < 0.3) for _ in c]
    for s in M.sweep(df(spark, c, y)).collect():
        assert (s["n_auto"], s["n_false"]) == (sum(x >= s["tau"] for x in c), sum(b for x, b in zip(c, y) if x >= s["tau"]))


def test_resampling_keeps_size_and_repeats(spark):
    frame = df(spark, [0.1 * i for i in range(10)], [0] * 10)
    one = sorted(tuple(r) for r in M.resampled(frame, ["c"], 5, "s").select("draw", "c", "k").collect())
    assert one == sorted(tuple(r) for r in M.resampled(frame, ["c"], 5, "s").select("draw", "c", "k").collect())
    assert all(sum(k for d, _, k in one if d == i) == 10 for i in range(5))
