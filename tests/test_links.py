import gzip
import json

import pytest

from quernstone.plans import links as L
from quernstone.plans.ingest import cases
from quernstone.sources.files import write_sample


def test_links_are_followed_or_refused(spark, sf_dir):
    every = cases(spark, sf_dir)
    one = every.orderBy("complaint_id").limit(1)
    row = one.collect()[0]
    assert [tuple(r) for r in L.follow(one, every, "filed_against").collect()] == [(row["complaint_id"], "".join(c for c in row["company"].upper() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))]
    mine = L.follow(one, every, "categorized_as").collect()[0]["target"]
    contained = {r["target"] for r in L.follow(one, every, "contains").collect()}
    assert mine in contained and all(t.startswith(row["canonical_product"]) for t in contained)
    with pytest.raises(L.HiddenLink):
        L.follow(one, every, "resolved_as")
    with pytest.raises(L.HiddenLink):
        L.follow(one, every, "filed_against", company_shown=False)
    with pytest.raises(ValueError, match="similar_to"):
        L.follow(one, every, "similar_to")
    assert L.follow(every.limit(0), every, "contains").count() == 0


def test_answers(spark, sf_dir):
    every = cases(spark, sf_dir)
    one = every.orderBy("complaint_id").limit(1)
    assert L.answer(one, every, "categorized_as")["ok"] and L.answer(one, every, "contains", most=1)["ok"] is False
    assert "resolved_as" in L.answer(one, every, "resolved_as")["error"] and not L.answer(one, every, "nowhere")["ok"]
    assert L.visible(company_shown=False) == ["categorized_as", "contains"]


def test_sample_files_are_the_same_to_the_byte(spark, tmp_path, monkeypatch):
    rows = [("10", "b", None), ("9", "é", "x"), ("100", "", "y")]
    for name, r in (("a", rows), ("b", rows[::-1])):
        assert write_sample(spark.createDataFrame(r, "id string, z string, a string").repartition(2), "id", str(tmp_path / name)) == 3
    assert (tmp_path / "a").read_bytes() == (tmp_path / "b").read_bytes()
    lines = gzip.decompress((tmp_path / "a").read_bytes()).decode().splitlines()
    assert [json.loads(x)["id"] for x in lines] == ["9", "10", "100"] and lines[0] == '{"a": "x", "id": "9", "z": "é"}'
    monkeypatch.setattr("quernstone.sources.files.MOST_SAMPLED", 2)
    with pytest.raises(ValueError):
        write_sample(spark.createDataFrame(rows, "id string, z string, a string"), "id", str(tmp_path / "c"))
