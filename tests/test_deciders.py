import math

import numpy as np
import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quernstone.operators import regression as G
from quernstone.plans import deciders as D


def test_vocabulary_and_weights_by_hand(spark):
    df = spark.createDataFrame([("Café bill",), ("cafe BILL bill",), ("bill x",), (None,)], "t string")
    known = D.vocabulary(df, "t", 2, 10, True)
    idf = lambda n: math.log(5 / (1 + n)) + 1
    assert known == {"bill": (0, pytest.approx(idf(3))), "cafe": (1, pytest.approx(idf(2))), "cafe bill": (2, pytest.approx(idf(2)))}
    assert [*D.vocabulary(df, "t", 2, 1, True)] == ["bill"] and "café" in D.vocabulary(df, "t", 1, 10, False)
    raw = [(1 + math.log(2)) * idf(3), idf(2), idf(2)]
    assert D.weights("cafe bill, bill unknown", known, True) == ([0, 1, 2], pytest.approx([x / math.dist(raw, [0] * 3) for x in raw]))


def test_rare_values_share_a_code_and_unseen_ones_have_none(spark):
    rows = [("a", "x")] * 6 + [("b", "x")] * 5 + [("c", "x"), ("d", "y")]
    assert D.value_codes(spark.createDataFrame(rows, "p string, q string"), ["p", "q"]) == {("p", "a"): 0, ("p", "b"): 1, ("p", "c"): 2, ("p", "d"): 2, ("q", "x"): 3, ("q", "y"): 4}


def test_fit_is_the_minimum_of_the_penalised_loss(spark):
    r = np.random.default_rng(1)
    x, y = r.normal(size=(60, 2)), r.integers(0, 2, 60)
    df = spark.createDataFrame([(f"{i:02d}", s, int(b), SparseVector(2, [0, 1], [*map(float, a)])) for s in ("train", "test") for i, (a, b) in enumerate(zip(x, y))], ["complaint_id", "split", "y", "f"])
    z, w = np.c_[x, np.ones(60)], np.zeros(3)
    for _ in range(30):  # Newton; the intercept isn't penalised
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag([1, 1, 0]), z.T @ (p - y) + w * [1, 1, 0])
    got = [row["p_f"] for row in D.fitted(df, ["f"]).orderBy("complaint_id").collect()]
    assert got == pytest.approx(1 / (1 + np.exp(-z @ w)), abs=1e-4)


def test_all_six_models_and_both_texts_are_scored(spark, sf_dir):
    queries = entry.queries()
    scores = queries["lr_scores"](spark, sf_dir)
    assert scores.columns == ["complaint_id", "split", "y", *[f"p_{m}" for m in D.MODELS]] and len(D.MODELS) == 6
    rows = scores.collect()
    assert len(rows) == 44 and all(len({r[f"p_{m}"] for r in rows}) > 1 for m in D.MODELS)
    assert len([c for c in queries["score_table_full"](spark, sf_dir).columns if c.startswith("c_")]) == 7
    leak = queries["name_leak_scores"](spark, sf_dir).collect()
    assert len(leak) == 17 and any(r["p_published"] != r["p_masked"] for r in leak)


def test_regressions_side_by_side_are_at_the_minimum(spark, monkeypatch):
    r = np.random.default_rng(2)
    vocabulary = [f"word{i}" for i in range(40)] + ["Café", "naïve"]
    rows = [(f"{i:03d}", "train" if i < 150 else "test", int(r.integers(0, 2)), *[str(v) for v in r.integers(0, 3, 8)], " ".join(r.choice(vocabulary, 12)) if i % 50 else None, [*map(float, r.normal(size=3))]) for i in range(170)]
    df = spark.createDataFrame(rows, ["complaint_id", "split", "y", *D.CATEGORICAL, "narrative", "shape"]).repartition(3).withColumn("y", F.col("y").cast("int"))
    train = df.where("split = 'train'")
    codes, known, old = D.value_codes(train, D.CATEGORICAL), D.frequent(train, "narrative", 3, 9999, True), D.vocabulary(train, "narrative", 3, 9999, True)
    assert sorted(known[1]) == pytest.approx(sorted(w for _, w in old.values()))
    layout, text = G.Layout(3, max(codes.values()) + 1, known[1]), [*old]
    models = [(has, np.concatenate([layout.columns(h) for h in has])) for has in (("shape",), ("codes", "words"))]
    for name, value in {"ROWS": 16, "LEADING": 20, "BLOCKS": 3, "SETTLED": 1e-9}.items():
        monkeypatch.setattr(G, name, value)
    blocks = D._stored(D.blocks(train, codes, known, True))
    found = G.fit(blocks, layout, models)
    monkeypatch.setattr(type(blocks), "inputFiles", lambda _: [])  # as where the shared folder isn't a path
    assert np.allclose(G.fit(blocks, layout, models[:1])[0], found[0])
    got = {x["complaint_id"]: (x["a"], x["b"]) for x in G.chances(D.blocks(df.where("split = 'test'"), codes, known, True), layout, models, found, ["a", "b"]).collect()}

    def dense(x):
        out = np.zeros(max(codes.values()) + 1 + len(text))
        out[[codes[c, v] for c, v in zip(D.CATEGORICAL, x[3:11]) if (c, v) in codes]] = 1
        at, w = D.weights(x[11] or "", old, True)
        out[max(codes.values()) + 1 + np.array(at, int)] = w
        return [*x[12]], out

    for j in (0, 1):
        z, t = (np.array([[*dense(x)[j], 1] for x in rows if x[1] == s]) for s in ("train", "test"))
        y, w, one = np.array([x[2] for x in rows[:150]]), np.zeros(z.shape[1]), np.append(np.ones(z.shape[1] - 1), 0)
        for _ in range(30):  # Newton
            p = 1 / (1 + np.exp(-z @ w))
            w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(one), z.T @ (p - y) + w * one)
        assert [got[x[0]][j] for x in rows[150:]] == pytest.approx(1 / (1 + np.exp(-t @ w)), abs=2e-6)


def test_the_last_terms_are_taken_by_name_and_one_outcome_is_certain(spark):
    df = spark.createDataFrame([("b a",), ("a b c d",), ("d c a b",)], "t string").select(F.regexp_replace("t", "(\\w)", "$1$1").alias("t"))
    idf = {t: w for t, (_, w) in D.vocabulary(df, "t", 1, 4, True).items()}
    assert [*idf] == ["aa", "bb", "aa bb", "cc"]
    h, w = D.frequent(df, "t", 1, 4, True)
    row, number = D.numbered([*idf], True, D._Numbers())
    assert {*h.tolist()} == {int(n) >> D.ROW_BITS for n in number} and sorted(w) == pytest.approx(sorted(idf.values()))
    block = G.packed(np.ones(2), np.zeros((2, 3)), np.zeros((2, 8), int), np.array([0, 1]), np.array([0, 70000]), np.array([1, 2]), np.ones(2))
    assert G.Block(block).index.tolist() == [0, 70000]
    one = spark.createDataFrame([(1, ["a", "b"], ["test"] * 2, bytearray(block))], "key bigint, ids array<string>, splits array<string>, data binary")
    layout = G.Layout(3, 1, np.ones(70001))
    models = [(("words",), layout.columns("words"))]
    assert [x["p"] for x in G.chances(one, layout, models, G.fit(one, layout, models), ["p"]).collect()] == [1.0, 1.0]
    with pytest.raises(ValueError, match="no train row"):
        G.fit(one.where("key = 0"), layout, models)
