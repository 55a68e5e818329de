"""Profile of the case table: counts, shapes, histograms. Each query is one pass with partial aggregation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quernstone.functions.expressions import AMOUNT, DATE, REDACTED_AMOUNT, REDACTED_DATE, REDACTION, company_key, redactions, zip_shape
from quernstone.functions.vocabulary import RETIRED_LABEL
from quernstone.plans.ingest import cases

def _n() -> F.Column:
    return F.count("*").alias("n")


def total_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).agg(_n())


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narratives that occur more than once, by hash, so that texts aren't shuffled."""
    rows = cases(spark, sf_dir).select(F.md5("narrative").alias("h"), "split", F.substring("narrative", 1, 90).alias("head"))
    return rows.groupBy("h").agg(_n(), F.min("split").alias("split"), F.min("head").alias("head")).where("n > 1")


def duplicate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir).agg(F.count("*").alias("n_texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def top_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir).orderBy(F.desc("n"), "head").limit(5).select("n", "split", "head")


def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["sub_product", "sub_issue", "state", "tags", "company_public_response"]
    one = cases(spark, sf_dir).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return one.unpivot([], names, "column_name", "n")


def zip_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).groupBy(zip_shape(F.col("zip_code")).alias("shape")).agg(_n())


def product_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir).groupBy("canonical_product").agg(_n(), F.count_if(F.col("label") == "needed_human").alias("n_positive"), F.count_if(F.col("label") != "excluded").alias("n_usable"))
    return rows.select("canonical_product", "n", "n_positive", F.round(F.try_divide("n_positive", "n_usable"), 6).alias("positive_rate"))


def response_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).groupBy("company_response").agg(_n())


def taxonomy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).groupBy("product_label", "sub_product").agg(_n())


def distinct_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("canonical_product", "sub_product", "issue", "sub_issue").distinct().agg(_n())


def distinct_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).agg(F.countDistinct("issue").alias("n"))


def shared_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir).groupBy("issue").agg(F.countDistinct("canonical_product").alias("n_products"))
    return rows.where("n_products > 1").orderBy(F.desc("n_products"), "issue").limit(8)


def retired_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir).where(F.col("product_label") == RETIRED_LABEL)
    return rows.groupBy("canonical_product").agg(_n(), F.min("date_received").alias("first_day"), F.max("date_received").alias("last_day"))


def company_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).groupBy("company").agg(_n()).agg(F.count("*").alias("n_companies"), F.count_if(F.col("n") == 1).alias("n_singletons"))


def top_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir).groupBy("company").agg(_n(), F.count_if(F.col("label") == "needed_human").alias("n_positive"))
    return rows.orderBy(F.desc("n"), "company").limit(10)


def date_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    lag = F.datediff("date_sent_to_company", "date_received")
    return cases(spark, sf_dir).agg(F.count_if(lag < 0).alias("n_backwards"), F.count_if(lag == 0).alias("n_same_day"), F.median(lag).alias("median_lag"), F.max(lag).cast("long").alias("max_lag"))


def redaction_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("narrative")
    rows = cases(spark, sf_dir).select(text, redactions(text).alias("spans"), F.length(text).alias("chars"))
    found = {"n_redacted": REDACTION, "n_amount": AMOUNT, "n_redacted_amount": REDACTED_AMOUNT, "n_date": DATE, "n_redacted_date": REDACTED_DATE}
    return rows.agg(
        *[F.count_if(text.rlike(p)).alias(n) for n, p in found.items()],
        F.median("spans").alias("median_spans"), F.round(F.avg("spans"), 6).alias("mean_spans"), F.max("spans").alias("max_spans"),
        F.median("chars").alias("median_chars"), F.round(F.avg("chars"), 6).alias("mean_chars"), F.max("chars").cast("long").alias("max_chars"),
    )


def length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths at the positions n div 10 and 9 n div 10 (from 0) of the sorted lengths, found from counts per length."""
    per = cases(spark, sf_dir).groupBy(F.length("narrative").alias("chars")).agg(_n())
    upto = per.withColumn("below", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("chars")) - F.col("n"))  # a row per distinct length
    total = per.agg(F.sum("n").alias("total"))
    place = lambda k: F.expr(f"total * {k} div 10")
    hit = lambda k: (F.col("below") <= place(k)) & (place(k) < F.col("below") + F.col("n"))
    rows = upto.join(F.broadcast(total))  # one row
    return rows.agg(F.max(F.when(hit(1), F.col("chars"))).cast("long").alias("p10"), F.max(F.when(hit(9), F.col("chars"))).cast("long").alias("p90"))


def company_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of each respondent in the company column, and the labels of its cases."""
    rows = cases(spark, sf_dir).select(company_key(F.col("company")).alias("company_id"), "company", "label")
    # distinct first: what is gathered is bounded by spellings, not by rows
    names = rows.select("company_id", "company").distinct().groupBy("company_id").agg(F.sort_array(F.collect_list("company")).alias("spellings"))
    labels = rows.select("company_id", "label").distinct().groupBy("company_id").agg(F.sort_array(F.collect_list("label")).alias("labels"))
    return names.join(labels, "company_id")


_KEY = "regexp_replace(upper(company), '[^A-Z0-9]+', '', 'g')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "total_count": total_count, "duplicate_summary": duplicate_summary, "top_duplicates": top_duplicates, "null_counts": null_counts, "zip_shape": zip_shapes, "product_counts": product_counts,
    "response_counts": response_counts, "taxonomy_pairs": taxonomy_pairs, "distinct_tuples": distinct_tuples, "distinct_issues": distinct_issues, "shared_issues": shared_issues,
    "retired_label": retired_label, "company_singletons": company_singletons, "top_companies": top_companies, "date_anomalies": date_anomalies, "redaction_profile": redaction_profile,
    "length_percentiles": length_percentiles, "company_aliases": company_aliases,
}
ORACLES = {
    "total_count": "select count(*) as n from complaints",
    "duplicate_summary": "select count(*) as n_texts, cast(coalesce(sum(n), 0) as bigint) as n_rows from (select count(*) as n from complaints group by narrative having count(*) > 1)",
    "top_duplicates": "select count(*) as n, min(split) as split, substr(narrative, 1, 90) as head from complaints group by narrative having count(*) > 1 order by n desc, head limit 5",
    "null_counts": " union all ".join(f"select '{c}' as column_name, count(*) filter (where {c} is null) as n from complaints" for c in ["sub_product", "sub_issue", "state", "tags", "company_public_response"]),
    "zip_shape": "select case when regexp_matches(zip_code, '^[0-9]{5}$') then 'full 5-digit' when regexp_matches(zip_code, '^[0-9]{3}XX$') then 'truncated (123XX)' when regexp_matches(zip_code, '^[0-9]+$') then 'numeric, not 5 digits' else 'other' end as shape, count(*) as n from complaints group by 1",
    "product_counts": "select canonical_product, count(*) as n, count(*) filter (where label = 'needed_human') as n_positive, round(count(*) filter (where label = 'needed_human') / nullif(count(*) filter (where label <> 'excluded'), 0), 6) as positive_rate from complaints group by 1",
    "response_counts": "select company_response, count(*) as n from complaints group by 1",
    "taxonomy_pairs": "select product_label, sub_product, count(*) as n from complaints group by all",
    "distinct_tuples": "select count(*) as n from (select distinct canonical_product, sub_product, issue, sub_issue from complaints)",
    "distinct_issues": "select count(distinct issue) as n from complaints",
    "shared_issues": "select issue, count(distinct canonical_product) as n_products from complaints group by 1 having n_products > 1 order by n_products desc, issue limit 8",
    "retired_label": f"select canonical_product, count(*) as n, min(date_received) as first_day, max(date_received) as last_day from complaints where product_label = '{RETIRED_LABEL}' group by 1",
    "company_singletons": "select count(*) as n_companies, count(*) filter (where n = 1) as n_singletons from (select company, count(*) as n from complaints group by 1)",
    "top_companies": "select company, count(*) as n, count(*) filter (where label = 'needed_human') as n_positive from complaints group by 1 order by n desc, company limit 10",
    "date_anomalies": "select count(*) filter (where date_sent_to_company < date_received) as n_backwards, count(*) filter (where date_sent_to_company = date_received) as n_same_day, median(datediff('day', date_received, date_sent_to_company)) as median_lag, max(datediff('day', date_received, date_sent_to_company)) as max_lag from complaints",
    "redaction_profile": f"with r as (select narrative, len(regexp_extract_all(narrative, 'X{{2,}}')) as spans, length(narrative) as chars from complaints) select count(*) filter (where regexp_matches(narrative, '{REDACTION}')) as n_redacted, count(*) filter (where regexp_matches(narrative, '{AMOUNT}')) as n_amount, count(*) filter (where regexp_matches(narrative, '{REDACTED_AMOUNT}')) as n_redacted_amount, count(*) filter (where regexp_matches(narrative, '{DATE}')) as n_date, count(*) filter (where regexp_matches(narrative, '{REDACTED_DATE}')) as n_redacted_date, median(spans) as median_spans, round(avg(spans), 6) as mean_spans, max(spans) as max_spans, median(chars) as median_chars, round(avg(chars), 6) as mean_chars, max(chars) as max_chars from r",
    "length_percentiles": "with r as (select length(narrative) as chars, row_number() over (order by length(narrative)) - 1 as i, count(*) over () as n from complaints) select max(chars) filter (where i = n // 10) as p10, max(chars) filter (where i = n * 9 // 10) as p90 from r",
    "company_aliases": f"select {_KEY} as company_id, list_sort(list(distinct company)) as spellings, list_sort(list(distinct label)) as labels from complaints group by 1",
}
