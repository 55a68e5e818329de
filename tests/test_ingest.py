import pytest
from pyspark.sql import functions as F

from quernstone.plans import ingest as I
from quernstone.plans.evaluation import missing_anti
from quernstone.plans.session import is_local

IDS = ["a", " a\t", "x 1", "x1", "\t \n", "", None, "\u2003b", "b"]


@pytest.fixture
def raw_dir(spark, tmp_path):
    rows = [(i, 1, i, x) for i, x in enumerate(IDS)]
    raw = spark.createDataFrame(rows, "delivery_id long, run_id long, at long, complaint_id string")
    raw.withColumn("fetched_at", F.timestamp_seconds("at")).drop("at").write.parquet(str(tmp_path / "raw_records.parquet"))
    spark.createDataFrame([(1, 4), (2, 3)], "run_id long, records long").write.parquet(str(tmp_path / "fetch_stats.parquet"))
    spark.createDataFrame([("a",), ("x1",)], "complaint_id string").write.parquet(str(tmp_path / "complaints.parquet"))
    return str(tmp_path)


def test_ids_are_trimmed_at_their_ends_only(spark, raw_dir):
    assert sorted(r["complaint_id"] for r in I.dedup_first(spark, raw_dir).collect()) == ["a", "b", "x 1", "x1"]
    assert sorted(r["complaint_id"] for r in missing_anti(spark, raw_dir).collect()) == ["b", "x 1"]


def test_coverage_counts_the_same_ids_and_raises_on_request(spark, raw_dir):
    checked = I.coverage_check(spark, raw_dir)
    assert sorted(tuple(r) for r in checked.collect()) == [(1, 4, 4, True), (2, 3, 0, False)]
    assert I.require_complete(checked.where("run_id = 1")).count() == 1
    with pytest.raises(ValueError, match=r"\(2, 3, 0\)"):
        I.require_complete(checked)


def test_only_one_process_may_do_without_a_shared_folder():
    assert is_local("local[4]") and is_local("local") and not is_local("local-cluster[2,1,1024]") and not is_local("spark://x:7077") and not is_local("yarn")
