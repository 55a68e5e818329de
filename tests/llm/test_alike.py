import itertools
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quernstone.llm import pigeonhole as G
from quernstone.llm.linking import TOGETHER, Linked, components, expanded, pairs_by_key
from quernstone.llm.overlap import banding, collision, cross_split_pairs
from quernstone.llm.pigeonhole import near_duplicates
from quernstone.llm.shingles import jaccard, may_reach, sequence_sets, sketch_distance


def sets(text, k):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def similarity(a, b, k=3):
    x, y = sets(a, k), sets(b, k)
    return len(x & y) / len(x | y) if x or y else 0.0


TEXTS = ["", None, "one", "One two THREE four", "one two three four", "ÀÉ ß_x 日本 a1 b2", "İstanbul now and then x y", "a b c " * 50, "it's 10.5 % off"]


@pytest.mark.parametrize("k", [1, 3, 5])
def test_sets_and_similarity_equal_brute_force(k):
    s = sequence_sets(TEXTS, k)
    assert s.sizes.tolist() == [len(sets(t, k)) for t in TEXTS]
    f = s.fingerprints()
    assert f[3] == f[4]
    for a, b in itertools.combinations(range(len(TEXTS)), 2):
        got = jaccard(sequence_sets([TEXTS[a]], k), sequence_sets([TEXTS[b]], k))[0]
        assert got == pytest.approx(similarity(TEXTS[a], TEXTS[b], k))


def corpus(n=60, copies=40, seed=3):
    """Base texts, edited copies of some, and one text that makes up a third of all rows."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocab) for _ in range(r.randint(20, 150))] for _ in range(n)]
    out = [" ".join(b) for b in base]
    for _ in range(copies):
        b = list(r.choice(base))
        for _ in range(max(1, len(b) // 30)):
            at = r.randrange(len(b))
            b[at : at + r.randint(0, 2)] = [r.choice(vocab)] * r.randint(0, 2)
        out.append(" ".join(b).upper() if r.random() < 0.3 else " ".join(b))
    out += ["the very same text of more than five words"] * ((n + copies) // 2)
    return out


def brute(texts, k, t):
    return {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if sets(a, k) and similarity(a, b, k) >= t}


@pytest.mark.parametrize(("k", "t"), [(3, 0.6), (5, 0.8)])
def test_near_duplicates_equal_brute_force(spark, k, t):
    texts = corpus() + [None, "", "two words", "two words"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("cls", F.lit("clash")).repartition(3)
    found = near_duplicates(df, "id", "text", k, t)
    got = {tuple(r) for r in expanded(found).collect()}
    want = brute(texts, k, t)
    assert got <= want and len(got) >= 0.99 * len(want)
    least = {r["rep"] for r in found.members.collect()}
    assert found.links.count() < len(want) and all(r["a"] in least and r["a"] < r["b"] for r in found.links.collect())


def test_complaints_equal_brute_force(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/complaints.parquet", columns=["complaint_id", "narrative"]).to_pydict()
    df = spark.read.parquet(f"{sf_dir}/complaints.parquet")
    got = {tuple(r) for r in expanded(near_duplicates(df, "complaint_id", "narrative", 3, 0.6, 0.7)).collect()}
    ids = t["complaint_id"]
    want = {tuple(sorted((ids[i], ids[j]))) for i, j in brute(t["narrative"], 3, 0.6)}
    assert got == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id string, text string")
    found = near_duplicates(none, "id", "text")
    assert found.members.count() == found.links.count() == 0
    assert cross_split_pairs(none, "id", "text", F.lit(True)).count() == 0


def test_cross_split_equals_brute_force(spark):
    texts = corpus(seed=5)
    side = [None if i % 7 == 0 else i % 3 == 0 for i in range(len(texts))]
    df = spark.createDataFrame([(i, x, s) for i, (x, s) in enumerate(zip(texts, side))], "id long, text string, s boolean")
    got = [(r["eval_id"], r["train_id"]) for r in cross_split_pairs(df, "id", "text", F.col("s"), 3, 0.6).collect()]
    want = {(i, j) for i, j in itertools.permutations(range(len(texts)), 2) if side[i] is True and side[j] is False and similarity(texts[i], texts[j]) >= 0.6}
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want)


def test_banding_reaches_its_recall():
    bands, rows = banding(0.7)
    assert collision(0.7, bands, rows) >= 0.999 and collision(0.1, bands, rows) < 0.01
    with pytest.raises(ValueError):
        banding(0.01, most=3)


def test_sketches_of_like_texts_are_near():
    texts = corpus()
    s = sequence_sets(texts, 3)
    k = s.sketches()
    for i, j in brute(texts, 3, 0.6):
        assert sum(int(half[i] ^ half[j]).bit_count() for half in k) <= sketch_distance(0.6)


def test_allocation_is_optimal():
    r = np.random.default_rng(1)
    for _ in range(20):
        m, need = 4, 1.0
        costs, gains = (np.concatenate([np.zeros((m, 1)), np.sort(r.random((m, 3)), axis=1)], axis=1) for _ in range(2))
        steps = np.minimum(np.floor(gains * G._STEPS + 1e-9), G._STEPS)
        options = [sum(costs[i, o] for i, o in enumerate(os)) for os in itertools.product(range(4), repeat=m) if sum(steps[i, o] for i, o in enumerate(os)) >= G._STEPS]
        chosen = G.allocate(costs, gains, need)
        if options:
            assert gains[range(m), chosen].sum() >= need - 1e-9 and sum(costs[range(m), chosen]) == pytest.approx(min(options))
        else:
            assert chosen.tolist() == gains.argmax(axis=1).tolist()


def edited(rng, words, similarity, k):
    """A text of so many words, and a copy with single words replaced all over, as many as leave just the similarity."""
    w = [f"w{rng.randrange(10**7)}" for _ in range(words)]
    n, c = words - k + 1, list(w)
    for e in range(max(1, int(n * (1 - similarity) / (1 + similarity) / k))):
        c[int((e + rng.random()) * words / max(1, int(n * (1 - similarity) / (1 + similarity) / k)))] = f"w{rng.randrange(10**7)}"
    return " ".join(w), " ".join(c)


@pytest.mark.parametrize(("k", "t"), [(3, 0.6), (5, 0.8)])
def test_recall_at_every_length(spark, k, t):
    """Copies as little alike as is asked for, edits spread evenly, of 12 to 1,000 words: all but one in a thousand are found."""
    r, rows, want = random.Random(11), [], 0
    lengths = [12, 20, 30, 40, 50, 60, 80, 100, 140, 160, 180, 215, 240, 260, 340, 430, 520, 600, 800, 1000]
    for length in lengths * 70:
        pair = edited(r, length, t + 0.01, k)
        want += similarity(*pair, k) >= t
        rows += [(len(rows), pair[0]), (len(rows) + 1, pair[1])]
    found = expanded(near_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text", k, t))
    got = {tuple(x) for x in found.collect()}
    assert want > 1_000 and all(i % 2 == 0 and j == i + 1 for i, j in got) and want - 2 <= len(got) <= want


def test_certain_finds_all(spark):
    r, rows = random.Random(12), []
    for length in [5, 40, 150, 400] * 40:
        pair = edited(r, length, 0.62, 3)
        rows += [(len(rows), pair[0]), (len(rows) + 1, pair[1])]
    got = {tuple(x) for x in expanded(near_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text", 3, 0.6, certain=True)).collect()}
    assert got == {(i, i + 1) for i in range(0, len(rows), 2) if similarity(rows[i][1], rows[i + 1][1]) >= 0.6}


def test_samples_agree_as_often_as_texts_are_alike_whatever_stands_beside_them():
    r = random.Random(13)
    pairs = [edited(r, length, 0.6, 3) for length in [4, 8, 30, 150] * 100]
    left, right = (sequence_sets([p[i] for p in pairs], 3) for i in (0, 1))
    x, y = left.samples(128), right.samples(128)
    assert abs(float((x == y).mean()) - float(jaccard(left, right).mean())) < 0.01
    assert (sequence_sets([pairs[3][0]], 3).samples(128)[0] == x[3]).all()


def test_bits_never_rule_out_a_like_pair(spark):
    r = random.Random(14)
    pairs = [edited(r, length, s, 3) for length in (5, 20, 45, 90, 300, 900) for s in (0.3, 0.6, 0.62, 0.7, 0.9) for _ in range(10)]
    left, right = (sequence_sets([p[i] for p in pairs], 3) for i in (0, 1))
    rows = zip(range(len(pairs)), left.sizes.tolist(), left.parities().to_pylist(), right.sizes.tolist(), right.parities().to_pylist())
    df = spark.createDataFrame(list(rows), "i int, n_x long, odd_x array<long>, n_y long, odd_y array<long>")
    kept = {x["i"] for x in df.where(may_reach("x", "y", 0.6)).collect()}
    like = {i for i, p in enumerate(pairs) if similarity(*p) >= 0.6}
    assert like <= kept and len(kept) < len(pairs)


def test_a_class_and_a_bucket_of_a_third_of_the_rows(spark):
    """Equal texts are paired in blocks, and so are the many different texts under one key."""
    n = TOGETHER + 40
    members = spark.range(n).select("id", F.lit(0).cast("long").alias("rep"), F.lit(n).cast("long").alias("size")).unionAll(spark.sql("select 5000L, 5000L, 1L"))
    links = spark.createDataFrame([(0, 5000, 0.9)], "a long, b long, jaccard double")
    got = [tuple(x) for x in expanded(Linked(members, links)).collect()]
    assert len(got) == len(set(got)) == n * (n - 1) // 2 + n and all(i < j for i, j in got)
    keys = spark.range(n).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("cls"), F.lit(0).cast("long").alias("s1"), F.lit(0).cast("long").alias("s2"))
    pairs = pairs_by_key(keys, 0)
    assert pairs.count() == n * (n - 1) // 2
    sided = pairs_by_key(keys.withColumn("side", F.col("cls") < 300), 0, sided=True)
    assert sided.count() == sided.where("x < 300 and y >= 300").count() == 300 * (n - 300)


def test_components_of_a_chain_and_an_island(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200)]
    got = {r["id"]: r["group"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100}
