import pytest
from pyspark.sql import functions as F

from quernstone.llm import sampling as S

TARGETS = "split string, cat string, target_share double, min_rows int, sample_fraction double"


def draw(spark, rows, targets, **kw):
    df = spark.createDataFrame(rows, "id string, split string, cat string")
    return S.systematic_sample(df, spark.createDataFrame(targets, TARGETS), "split", "cat", "id", **kw)


def data():
    return [(f"{i:05d}", "a" if i < 3000 else "b", "x" if i % 10 else "y") for i in range(4000)] + [(f"n{i}", "a", None) for i in range(10)] + [("z", None, "x")]


def test_shares_and_report(spark):
    targets = [("a", "x", 0.5, 5, 0.2), ("a", "y", 0.5, 5, 0.2), ("b", "x", 0.9, 5, 0.1), ("b", "y", 0.05, 5, 0.1), ("b", "w", 0.05, 5, 0.1)]
    sample, report = draw(spark, data(), targets)
    r = {(x["split"], x["cat"]): x for x in report.collect()}
    assert r["a", "x"]["n_sampled"] in (301, 301) and r["a", "x"]["target_met"]
    assert r["a", "y"]["n_sampled"] == 300 and not r["a", "y"]["target_met"]  # 301 wanted, 300 there
    assert abs(r["b", "x"]["n_sampled"] - 90) <= 1 and r["b", "y"]["n_sampled"] >= 5 and r["b", "y"]["floor_met"]
    assert r["b", "w"]["n_rows"] == r["b", "w"]["n_sampled"] == 0 and not r["b", "w"]["floor_met"]
    assert sample.count() == sum(x["n_sampled"] for x in r.values()) == sample.select("id").distinct().count()
    assert sample.where("cat is null or split is null").count() == 0


def test_total_is_the_sum_of_probabilities(spark):
    sample, _ = draw(spark, data(), [("a", "x", 0.33, 0, 0.37), ("a", "y", 0.11, 0, 0.37), ("b", "x", 0.77, 0, 0.13)])
    want = 3010 * 0.37 * 0.44 + 1000 * 0.13 * 0.77
    assert abs(sample.count() - want) < 1


def test_floors_are_filled_and_marked(spark):
    sample, report = draw(spark, data(), [("a", "y", 0.0, 7, 0.2), ("b", "y", 0.001, 10, 0.1)])
    assert {(r["split"], r["n_sampled"]) for r in report.collect()} == {("a", 7), ("b", 10)}
    assert sample.where("sampled_by = 'floor'").count() >= 16


def test_same_seed_same_sample_whatever_the_storage(spark, monkeypatch):
    targets = [("a", "x", 0.5, 0, 0.1)]
    one = {r["id"] for r in draw(spark, data(), targets)[0].collect()}
    monkeypatch.setattr(S, "BUCKET_ROWS", 200)
    assert {r["id"] for r in draw(spark, data()[::-1], targets)[0].collect()} == one
    assert {r["id"] for r in draw(spark, data(), targets, seed=1)[0].collect()} != one


def test_repeated_rows_empty_and_clashes(spark):
    sample, report = draw(spark, [("same", "a", "x")] * 100, [("a", "x", 0.5, 0, 1.0)])
    assert sample.count() == 50
    sample, report = draw(spark, [], [("a", "x", 0.5, 3, 1.0)])
    assert sample.count() == 0 and report.collect()[0]["n_rows"] == 0
    with pytest.raises(ValueError):
        draw(spark, [], [("a", "x", 0.5, 3, 1.0)] * 2)
    df = spark.createDataFrame([("a", "a", "x")], "id string, split string, cat string").withColumn("sampled_by", F.lit(1))
    with pytest.raises(ValueError):
        S.systematic_sample(df, spark.createDataFrame([], TARGETS), "split", "cat", "id")
