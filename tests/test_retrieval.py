import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quernstone.functions.expressions import fingerprint
from quernstone.operators import retrieval as R
from quernstone.operators.history import as_of
from quernstone.operators.masking import mask, mentions_own
from quernstone.operators.samples import stratified
from quernstone.plans import textual


def terms(text):
    w = re.findall(r"\w{2,}", text.lower())
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute(corpus, queries, k):
    """(group, id, day, text) lists -> {query: [neighbour]}."""
    by = defaultdict(list)
    for g, i, d, t in corpus:
        by[g].append((i, d, Counter(terms(t)), t))
    out = {}
    for g, q, day, text in queries:
        n = len(by[g])
        df = Counter(x for _, _, c, _ in by[g] for x in c)
        idf = {x: math.log((1 + n) / (1 + m)) + 1 for x, m in df.items() if m >= 2}

        def vec(c):
            v = {x: (1 + math.log(m)) * idf[x] for x, m in c.items() if x in idf}
            z = math.sqrt(sum(a * a for a in v.values())) or 1
            return {x: a / z for x, a in v.items()}

        vs = {i: vec(c) for i, _, c, _ in by[g]}
        dot = lambda a, b: sum(x * b.get(t, 0) for t, x in a.items())
        qv = vec(Counter(terms(text)))
        pool = sorted(((round(dot(qv, vs[i]), 9), i, d, t) for i, d, _, t in by[g]), key=lambda r: (-r[0], r[1]))[: 8 * k]
        kept = []
        for s, i, d, t in pool:
            if len(kept) < k and s >= 0.1 and i != q and d < day and t != text and all(t != kt and dot(vs[i], vs[ki]) < 0.9 for ki, kt in kept):
                kept.append((i, t))
        out[q] = [i for i, _ in kept]
    return out


def test_similar_equals_brute_force(spark):
    r = random.Random(7)
    words = [f"word{i}" for i in range(30)]
    corpus = [(r.choice("ab"), f"{i:03d}", f"2024-01-{1 + r.randrange(28):02d}", " ".join(r.choice(words) for _ in range(12))) for i in range(80)]
    corpus += [("a", f"c{i}", "2024-01-02", corpus[0][3]) for i in range(10)]  # one event, many copies
    queries = [corpus[i] for i in range(0, 80, 9)] + [("z", "zz", "2024-02-01", "word1 word2")]
    schema = "g string, id string, day string, text string"
    got = defaultdict(list)
    for row in R.similar(spark.createDataFrame(corpus, schema), spark.createDataFrame(queries, schema), "g", "id", "day", "text", fingerprint(F.col("text")), 3).orderBy("query", "rank").collect():
        got[row["query"]].append(row["neighbour"])
    want = {q: v for q, v in brute(corpus, queries, 3).items() if v}
    assert dict(got) == want


def test_similar_in_blocks_and_slices_makes_no_row_of_a_term(spark, monkeypatch):
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    corpus = [("a", f"{i:03d}", f"2024-01-{1 + r.randrange(28):02d}", " ".join(r.choice(words) for _ in range(9))) for i in range(200)]
    corpus += [("a", f"c{i:02d}", "2024-01-01", corpus[5][3].upper() + " w1" * (i % 3)) for i in range(60)]  # many near copies: the walk goes far down
    queries = [*corpus[:40:2], ("a", "zz", "2024-02-01", corpus[5][3] + " w2"), ("a", "none", "2024-02-01", None)]
    for name, value in {"SLICE": 9, "COLUMNS": 7, "CELLS": 64, "STEP": 50, "FIRST": 2}.items():
        monkeypatch.setattr(R, name, value)
    schema = "g string, id string, day string, text string"
    for k in (2, 5):
        df = R.similar(spark.createDataFrame(corpus, schema), spark.createDataFrame(queries, schema), "g", "id", "day", "text", F.upper("text"), k)
        got = defaultdict(list)
        for row in df.orderBy("query", "rank").collect():
            got[row["query"]].append(row["neighbour"])
        upper = [[(g, i, d, t and t.upper()) for g, i, d, t in rows if t] for rows in (corpus, queries)]
        assert dict(got) == {q: v for q, v in brute(*upper, k).items() if v}
    monkeypatch.setattr(F, "explode", None)
    R.similar(spark.createDataFrame(corpus, schema), spark.createDataFrame(queries, schema), "g", "id", "day", "text", F.upper("text"), 2)


def test_similar_to_shuffles_no_terms(spark, sf_dir):
    got = textual.similar_to(spark, sf_dir)
    assert "Generate" not in got._jdf.queryExecution().toString()
    asked = {r["complaint_id"] for r in textual.cases(spark, sf_dir).select("complaint_id").collect() if int(r["complaint_id"]) % textual.EVERY == 0}
    rows = got.collect()
    assert rows and {r["query"] for r in rows} <= asked and all(0.1 <= r["similarity"] < 1.000000001 for r in rows)
    assert sorted(R._product((np.array([1, 4, 9]), np.array([1.0, 2.0, 3.0])), b) for b in [(np.array([4, 5]), np.array([10.0, 7.0])), (np.array([], int), np.array([]))]) == [0.0, 20.0]


def test_find_objects_answers_every_case(spark, tmp_path):
    r = random.Random(5)
    words = [f"word{i}" for i in range(25)]
    rows = [(r.choice("ab"), str(i), f"2024-01-{1 + r.randrange(28):02d}", " ".join(r.choice(words) for _ in range(10)), *(("train", "relief") if i % 3 else ("test", "excluded")), f"issue{i % 4}") for i in range(1, 61)]
    schema = "canonical_product string, complaint_id string, date_received string, narrative string, split string, label string, issue string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/complaints.parquet")
    got = defaultdict(list)
    for row in textual.find_objects(spark, str(tmp_path)).orderBy("query", "rank").collect():
        got[row["query"]].append(row["neighbour"])
    want = brute([x[:4] for x in rows if x[4] == "train"], [x[:4] for x in rows], textual.K)
    assert dict(got) == {q: v for q, v in want.items() if v}
    assert sum(int(q) % 50 > 0 for q in got) > 40


def test_similar_reads_sent_files_and_keeps_the_first_of_many_equal_texts(spark, monkeypatch):
    texts = ["one two three four", "one two five six", "three four five six", "one six seven two"]
    corpus = [("a", f"{i:03d}", f"2024-01-{1 + i % 28:02d}", texts[i % 7 % 4]) for i in range(120)]  # more equal ones than a pool holds
    queries = [("a", "q", "2024-01-20", "one two three seven"), ("a", "early", "2024-01-01", texts[0]), ("a", None, "2024-02-01", texts[0]), ("a", "undated", None, texts[0]), (None, "x", "2024-02-01", texts[0])]
    schema = "g string, id string, day string, text string"
    want = {q: v for q, v in brute(corpus, queries[:2], 2).items() if v}

    def found(day):
        frames = [spark.createDataFrame(rows, schema).withColumn("day", F.col("day").cast(day)) for rows in (corpus, queries)]
        got = defaultdict(list)
        for row in R.similar(*frames, "g", "id", "day", "text", F.col("text"), 2).orderBy("query", "rank").collect():
            got[row["query"]].append(row["neighbour"])
        return dict(got)

    assert want and found("string") == found("date") == found("timestamp") == want
    frame, context = type(spark.range(1)), type(spark.sparkContext)
    names, add = frame.inputFiles, context.addFile
    monkeypatch.setattr(frame, "inputFiles", lambda df: [n.replace("file:", "hdfs:") for n in names(df)])
    monkeypatch.setattr(context, "addFile", lambda self, path, recursive: add(self, path.replace("hdfs:", "file:"), recursive))
    assert found("date") == want


def test_as_of_leaves_out_the_same_day_and_nulls(spark):
    rows = [("a", "2024-01-01", 1), ("a", "2024-01-01", 1), ("a", "2024-01-03", 1), ("b", "2024-01-02", 1), (None, "2024-01-02", 1)]
    df = spark.createDataFrame(rows, "e string, d string, v int")
    got = sorted((r["e"] or "", r["d"], r["n"]) for r in as_of(df, "e", "d", {"n": F.col("v")}).collect())
    assert got == [("", "2024-01-02", None), ("a", "2024-01-01", 0), ("a", "2024-01-01", 0), ("a", "2024-01-03", 2), ("b", "2024-01-02", 0)]


def test_masking_takes_whole_words(spark):
    df = spark.createDataFrame([("1", "capital capitalone one_capital"), ("2", None)], "id string, t string")
    words = spark.createDataFrame([("capital",), ("",), (None,)], "w string")
    assert [r["t"] for r in mask(df, "id", "t", words, "w", "NAME").orderBy("id").collect()] == ["NAME capitalone one_capital", None]
    assert spark.createDataFrame([("at Acme's", ["acme"])], "t string, w array<string>").select(mentions_own(F.col("t"), F.col("w"))).first()[0]


def test_stratified_weights(spark):
    df = spark.createDataFrame([(f"{i}", i % 4 == 0) for i in range(100)], "id string, y boolean")
    rows = stratified(df, "y", "id", 30, "s").collect()
    assert Counter((r["y"], round(r["weight"], 6)) for r in rows) == {(True, 1.0): 25, (False, 2.5): 30}
    assert {r["id"] for r in rows} == {r["id"] for r in stratified(df.repartition(7), "y", "id", 30, "s").collect()}


def test_accents_fall_away(spark):
    assert spark.createDataFrame([("Crème BRÛLÉE ñ",)], "t string").select(R.terms(F.col("t"), pairs=False)).first()[0] == ["creme", "brulee"]
