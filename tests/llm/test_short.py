import random

from pyspark.sql import functions as F

from quernstone.llm.overlap import cross_split_pairs


def test_short_like_texts_are_not_lost(spark):
    r = random.Random(3)
    rows = []
    for i in range(300):  # 17 sequences, 3 of them changed: similarity 0.7
        w = [f"w{r.randrange(10**6)}" for _ in range(19)]
        rows += [(2 * i, " ".join(w), True), (2 * i + 1, " ".join([*w[:9], "other", *w[10:]]), False)]
    df = spark.createDataFrame(rows, "id long, text string, side boolean")
    assert cross_split_pairs(df, "id", "text", F.col("side"), 3, 0.6, 0.7).count() >= 297
