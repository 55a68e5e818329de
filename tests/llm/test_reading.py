import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quernstone.llm import reading as R


@pytest.fixture(scope="module")
def model(spark):
    return R.fit(spark.read.parquet("/root/testdata/sf0.001/level_examples.parquet"), "text", "reading_level")


def test_held_out_accuracy(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/level_examples.parquet").withColumn("h", F.pmod(F.xxhash64("text"), F.lit(3)))
    m = R.fit(rows.where("h > 0"), "text", "reading_level")
    held = rows.where("h = 0").collect()
    got = m.probabilities([r["text"] for r in held]).argmax(1)
    assert sum(m.levels[g] == r["reading_level"] for g, r in zip(got, held)) / len(held) >= 0.9


def test_layout_case_and_punctuation_play_no_part(model):
    t = pq.read_table("/root/testdata/sf0.001/level_examples.parquet").to_pydict()
    for text, level in list(zip(t["text"], t["reading_level"]))[:30]:
        changed = "\n* ".join(text.upper().replace(",", "").split(". "))
        assert model.levels[model.probabilities([changed])[0].argmax()] == level


def test_no_words_no_level(spark, model):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "12 345 !!"), (5, "The fee is fine. We paid it."), (6, "The fee is fine. We paid it.")], "id int, text string")
    got = {r["id"]: r["reading_level"] for r in R.score(df, "text", model).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [None] * 4 and got[5] == got[6] == "basic"
    assert R.score(df.limit(0), "text", model).count() == 0
    with pytest.raises(ValueError):
        R.score(df.withColumn("reading_level", F.lit("x")), "text", model)
    with pytest.raises(ValueError):
        R.fit(df.limit(0).withColumn("l", F.lit("x")), "text", "l")


def test_very_long_text(model):
    assert model.probabilities(["The fee is fine. " * 20000]).argmax() == model.levels.index("basic")
