import pytest
from pyspark.sql import Row, functions as F

from quernstone.functions import expressions as E
from quernstone.functions.vocabulary import SPLITS, SUB_PRODUCTS
from quernstone.operators.records import TYPED, require_unique, typed, typed_and_rejected, typed_or_fail

GOOD = dict(
    product="Credit card", complaint_what_happened="It went wrong", date_received="2025-08-01T23:56:48.000Z", date_sent_to_company="2025-08-02T00:10:00.000Z", issue="Fees", sub_issue=None, sub_product="Store credit card",
    zip_code="78108", tags="", company_public_response=None, has_narrative=True, complaint_id="18410719", timely="Yes", company_response="Closed with explanation", submitted_via="Web", company="A Bank", state="TX",
)
SCHEMA = ", ".join(f"{k} {'boolean' if k == 'has_narrative' else 'string'}" for k in GOOD)


def raw(spark, *changes):
    return spark.createDataFrame([Row(**(GOOD | c)) for c in changes], SCHEMA)


def test_good_record(spark):
    r = typed_or_fail(raw(spark, {})).collect()[0].asDict()
    assert list(r) == TYPED and r["split"] == "test" and r["label"] == "no_relief" and r["canonical_product"] == "credit_card" and r["timely"] is True and r["tags"] is None
    assert str(r["date_received"]) == "2025-08-01"


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        ({"complaint_what_happened": " \n "}, "no narrative"), ({"complaint_id": None}, "no id"), ({"date_received": "yesterday"}, "no day received"), ({"date_received": "2025-13-40"}, "no day received"),
        ({"issue": ""}, "no issue"), ({"timely": "Maybe"}, "timely is neither Yes nor No"), ({"company_response": "Closed"}, "unknown outcome"), ({"product": "Mortgage", "sub_product": None}, "unresolved product"),
        ({"product": "Prepaid card"}, "unresolved product"), ({"product": "Credit card or prepaid card", "sub_product": None}, "unresolved product"),
    ],
)
def test_first_problem(spark, change, problem):
    good, bad = typed_and_rejected(raw(spark, {}, change))
    assert good.count() == 1 and bad.collect()[0]["problem"] == problem
    with pytest.raises(Exception, match=problem):
        typed_or_fail(raw(spark, change)).count()


def test_day_does_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert str(raw(spark, {}).select(E.iso_date(F.col("date_received"))).first()[0]) == "2025-08-01"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_splits_are_contiguous_and_sub_products_disjoint(spark):
    days = spark.sql("select explode(sequence(date '2020-12-31', date '2026-01-01')) as d").select(E.split_for(F.col("d")).alias("s"), "d")
    counts = {r["s"]: r["count"] for r in days.groupBy("s").count().collect()}
    assert counts["out_of_range"] == 2 and set(counts) == {s for s, _, _ in SPLITS} | {"out_of_range"}
    subs = [x for v in SUB_PRODUCTS.values() for x in v]
    assert len(subs) == len(set(subs)) == 22


def test_unknown_outcome_raises_even_when_counted(spark):
    with pytest.raises(Exception, match="unknown outcome"):
        spark.createDataFrame([("x",)], "r string").where(E.label_for(F.col("r")) == "no_relief").count()


def test_evidence(spark):
    texts = ["I paid $35.00 and $1,250", "{$XX.00} gone", "on 3/14/2025", "since XX/XX/XXXX", "March 14 it was", "nothing", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(E.amounts(F.col("t")).alias("a"), *[c.alias(n) for n, c in E.evidence(F.col("t")).items()]).collect()
    assert rows[0]["a"] == [35.0, 1250.0] and rows[1]["has_redacted_amount"] and not rows[1]["has_amount"]
    assert rows[2]["has_date"] and rows[3]["has_redacted_date"] and rows[4]["has_date"]
    assert not any(v for k, v in rows[5].asDict().items() if k != "a") and rows[6]["a"] == []


def test_fingerprint_collapses_redaction_runs_like_three_replacements(spark):
    got = [r[0] for r in spark.createDataFrame([("a XXXX b",), ("A  XX\nB",), ("a " + "X" * 64 + " b",), ("other",)], "t string").select(E.fingerprint(F.col("t"))).collect()]
    assert got[0] == got[1] != got[2] and got[3] != got[0]


def test_extra_columns_stay_and_empty_is_empty(spark):
    assert "more" in typed(raw(spark, {}).withColumn("more", F.lit(1))).columns
    assert typed(raw(spark, {}).limit(0)).count() == 0


def test_require_unique(spark):
    with pytest.raises(ValueError):
        require_unique(spark.createDataFrame([("a",), ("a",)], "k string"), "k")
