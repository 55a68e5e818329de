import random

import numpy as np
import pytest

from quernstone.llm import packing as P


def test_bound_never_exceeds_the_packing():
    r = random.Random(1)
    for _ in range(60):
        cap = r.choice([10, 64, 100])
        sizes = np.array([r.randint(1, cap) for _ in range(r.randint(1, 80))])
        bins = P.best_fit_decreasing(sizes, cap)
        fill = np.bincount(bins, weights=sizes)
        assert fill.max() <= cap and P.lower_bound(sizes, cap) <= bins.max() + 1


def test_bound_sees_what_sums_do_not():
    assert P.lower_bound(np.array([6] * 10), 10) == 10  # no two fit together


def pack(spark, sizes, cap=100):
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, size long")
    return P.pack(df, "id", "size", cap).placements.toPandas()


def check(out, sizes, cap):
    assert len(out) == sum(max(1, -(-(s or 0) // cap)) for s in sizes)
    assert out.groupby("id")["size"].sum().to_dict() == {i: s or 0 for i, s in enumerate(sizes)}
    assert out.dropna(subset=["container"]).groupby("container")["size"].sum().max() <= cap
    assert (out["n_parts"] > 1).eq(out["id"].map(lambda i: (sizes[i] or 0) > cap)).all()


def test_whole_items_and_splits(spark):
    sizes = [None, 0, 1, 100, 101, 250, 99, 1, 60, 40] + [30] * 10
    out = pack(spark, sizes)
    check(out, sizes, 100)
    assert out[out["container"].isna()]["id"].tolist() in ([0, 1], [1, 0])


def test_groups_exchange(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP_ITEMS", 100)
    r = random.Random(2)
    sizes = [r.randint(1, 100) for _ in range(900)]
    out = pack(spark, sizes)
    check(out, sizes, 100)
    alone = P.best_fit_decreasing(np.array(sizes), 100).max() + 1
    assert out["container"].nunique() <= 1.03 * alone


def test_repeated_keys_empty_and_negative(spark):
    df = spark.createDataFrame([("a", 70), ("a", 70), (None, 70), ("b", 150), ("b", 150)], "id string, size int")
    out = P.pack(df, "id", "size", 100).placements.toPandas()
    assert len(out) == 7 and out.groupby("container")["size"].sum().max() <= 100
    assert P.pack(df.limit(0), "id", "size", 100).placements.count() == 0
    with pytest.raises(Exception, match="negative"):
        P.pack(spark.createDataFrame([(1, -1)], "id int, size int"), "id", "size", 100).placements.count()


def test_certificates(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP_ITEMS", 100)
    r = random.Random(3)
    sizes = [r.randint(1, 250) for _ in range(500)] + [0, None]
    packed = P.pack(spark.createDataFrame(list(enumerate(sizes)), "id long, size long"), "id", "size", 100)
    placed, whole = packed.placements.dropna(subset=["container"]).toPandas(), packed.whole.collect()[0]
    assert whole["containers"] == placed["container"].nunique() and whole["gap"] == whole["containers"] - whole["bound"] >= 0
    assert whole["unused"] == pytest.approx(1 - placed["size"].sum() / whole["containers"] / 100)
    groups = packed.groups.toPandas()
    assert (groups["gap"] == groups["containers"] - groups["bound"]).all() and (groups["gap"] >= 0).all()
    loose = placed[~placed["container"].str.startswith("full")]
    assert groups["kept"].sum() == loose["container"].nunique() and groups[groups["round"] == 0]["n_items"].sum() == len(loose)
    empty = P.pack(spark.createDataFrame([], "id long, size long"), "id", "size", 100)
    assert empty.groups.count() == 0 and tuple(empty.whole.collect()[0]) == (0, 0, 0, 0.0)
