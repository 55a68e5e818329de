from collections import Counter

import __spark_entry__ as entry


def test_full_samples_have_the_references_sizes(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    rows = queries["stratified_sample_full"](spark, "/root/testdata/sf0.1").collect()
    assert Counter(r["y"] for r in rows) == {0: 250, 1: 250} and queries["eval_join_full"](spark, "/root/testdata/sf0.1").count() == 500
    assert queries["coverage_sample_full"](spark, "/root/testdata/sf0.1").count() == 3000
    for name in ("stratified_sample", "eval_join", "base_rate", "eval_summary", "scores_semi", "resume_anti", "coverage_sample"):
        assert sql[f"{name}_full"] != sql[name]
