import pytest
from pyspark.sql import functions as F

from quernstone.sources import reports, transcripts
from quernstone.sources.files import read_jsonl, write_jsonl, write_parquet


def test_jsonl_keeps_nulls_unicode_and_microseconds(spark, tmp_path):
    df = spark.createDataFrame([("é\n日", None, 1), (None, "x", None)], "b string, a string, n long").withColumn("t", F.lit("2026-01-05 02:37:04.977795").cast("timestamp_ntz"))
    write_jsonl(df, str(tmp_path / "j"))
    back = read_jsonl(spark, str(tmp_path / "j"), df.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    line = spark.read.text(str(tmp_path / "j")).first()[0]
    assert line.index('"a"') < line.index('"b"') < line.index('"n"')


def test_corrupt_line_fails(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"complaint_id": "1", "responses": []}\n\n{"complaint_id": \n')
    with pytest.raises(Exception):
        transcripts.read(spark, str(tmp_path / "t.jsonl")).collect()


def test_empty_parquet_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        write_parquet(spark.range(0).toDF("id"), str(tmp_path / "p"))


def test_decisions(spark):
    rows = [("1", ["hm", '{"x": 1}', '{"disposition": "close", "confidence": 1.7}', '{"disposition": "late"}'], None), ("2", ["nothing"], None), ("3", None, None), ("4", [], "boom"), ("5", ['{"disposition": "hand_over", "confidence": -2}'], None)]
    got = {r["complaint_id"]: tuple(r)[1:] for r in transcripts.decisions(spark.createDataFrame(rows, transcripts.SCHEMA)).collect()}
    assert got == {"1": ("close", 1.0, None), "2": ("none", 0.0, "no_decision"), "3": ("none", 0.0, "no_decision"), "4": ("none", 0.0, "api_error"), "5": ("hand_over", 0.0, None)}
    assert transcripts.scorable(transcripts.decisions(spark.createDataFrame(rows, transcripts.SCHEMA))).count() == 4


def test_reports(spark):
    assert reports.markdown(spark.createDataFrame([("a", 1), (None, 2)], "k string, n int")) == "| k | n |\n| --- | ---: |\n| a | 1 |\n|  | 2 |"
    assert reports.share(1, 4) == "25.00%" and reports.share(1, 0) == "n/a"
