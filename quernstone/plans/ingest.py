"""Queries from raw records to typed rows, round trips through files, and integrity checks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.functions.expressions import canonical_product, category_id, company_key, iso_date, label_for, present, split_for, unrecognised, yes_no
from quernstone.functions.vocabulary import PRODUCT_LABELS, SUB_PRODUCTS
from quernstone.operators.delivery import blank_to_null, deduplicated
from quernstone.operators.records import require_unique, typed, typed_and_rejected
from quernstone.plans.session import checkpoint_dir, table
from quernstone.plans.training_core import ORDER, P7_FOUND_SQL
from quernstone.sources.files import read_jsonl, write_jsonl, write_parquet


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "complaints")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_records")


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delivery of each record id, the first."""
    rows = _raw(spark, sf_dir).select("delivery_id", "run_id", "fetched_at", "complaint_id")
    kept = deduplicated(rows, "complaint_id", ORDER).select("delivery_id", "run_id", blank_to_null(F.col("complaint_id")).alias("complaint_id"))
    return kept.where(F.col("complaint_id").isNotNull())


def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ids of each run against the number its source stated."""
    stats = table(spark, sf_dir, "fetch_stats").select("run_id", F.col("records").alias("expected"))
    return coverage(_raw(spark, sf_dir), "complaint_id", stats)


def coverage(raw: DataFrame, ident: str, stats: DataFrame) -> DataFrame:
    """(run_id, expected, got, complete) of each run in ``stats`` (run_id, expected). White space around an id does not make it another."""
    ids = raw.select("run_id", blank_to_null(F.col(ident)).alias("id")).where("id is not null").distinct()
    got = ids.groupBy("run_id").agg(F.count("*").alias("got"))
    return stats.join(got, "run_id", "left").select("run_id", "expected", F.coalesce("got", F.lit(0)).alias("got"), (F.coalesce("got", F.lit(0)) == F.col("expected")).alias("complete"))


def require_complete(checked: DataFrame) -> DataFrame:
    """``checked`` (see ``coverage``) itself; raises when a run has other than the expected number of ids."""
    wrong = checked.where("not coalesce(complete, false)").orderBy("run_id").limit(5).collect()
    if wrong:
        raise ValueError(f"runs not covered: {[(r['run_id'], r['expected'], r['got']) for r in wrong]}")
    return checked


def two_ended_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read from either end of a date range overlap; their union holds each id once."""
    rows = cases(spark, sf_dir).select("complaint_id", "date_received")
    early, late = rows.where("date_received <= date '2025-01-31'"), rows.where("date_received >= date '2024-12-01'")
    return early.unionByName(late).dropDuplicates(["complaint_id"]).groupBy(F.trunc("date_received", "year").alias("year")).agg(F.count("*").alias("n"))


def typed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw deliveries as typed rows: the first of each id, of those that can be typed."""
    return typed_and_rejected(deduplicated(_raw(spark, sf_dir), "complaint_id", ORDER))[0]


def record_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why deliveries can't be typed."""
    return typed(_raw(spark, sf_dir)).where("problem is not null").groupBy("problem").agg(F.count("*").alias("n"))


def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("delivery_id", iso_date(F.col("date_received")).alias("received"), yes_no(F.col("timely")).alias("timely"))


def canonical_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("complaint_id", canonical_product(F.col("product_label"), F.col("sub_product")).alias("product"))


def unrecognised_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _raw(spark, sf_dir).groupBy("product", "sub_product").agg(F.count("*").alias("n"))
    return pairs.where(unrecognised(F.col("product"), present(F.col("sub_product"))))


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir).select(split_for(F.col("date_received")).alias("split"), "label")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "needed_human").alias("n_positive"), F.count_if(F.col("label") == "excluded").alias("n_excluded"))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select(label_for(F.col("company_response")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def company_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).groupBy(company_key(F.col("company")).alias("company_id")).agg(F.count("*").alias("n"))


def issue_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.col(c) for c in ("canonical_product", "sub_product", "issue", "sub_issue")]
    return cases(spark, sf_dir).select("complaint_id", category_id(*parts).alias("category_id"))


def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of each product."""
    parts = [F.col(c) for c in ("canonical_product", "sub_product", "issue", "sub_issue")]
    return cases(spark, sf_dir).select("canonical_product", category_id(*parts).alias("category_id")).distinct().orderBy("canonical_product", "category_id")


def unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = require_unique(cases(spark, sf_dir).select("complaint_id", "split"), "complaint_id")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("complaint_id").alias("n_ids"))


def scratch(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/roundtrip-{uuid.uuid4().hex}"


def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records written as gzipped JSON lines and read back under their fixed schema."""
    rows = _raw(spark, sf_dir)
    path = scratch(spark)
    write_jsonl(rows, path)
    return read_jsonl(spark, path, rows.schema)


def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    write_parquet(cases(spark, sf_dir), path)
    return spark.read.parquet(path)


_FIRST = f"select * from raw_records where delivery_id not in ({P7_FOUND_SQL}) and trim(coalesce(complaint_id, ''), ' \t\n\r') <> ''"
_SUBS = ", ".join(f"('{sub.replace(chr(39), chr(39) * 2)}', '{product}')" for product, subs in SUB_PRODUCTS.items() for sub in subs)
_LABELS = ", ".join(f"('{label}', '{product}')" for product, labels in PRODUCT_LABELS.items() for label in labels)
_DIMS = f"subs(sub, product) as (values {_SUBS}), labels(label, product) as (values {_LABELS}), sole as (select label, any_value(product) as product from labels group by label having count(*) = 1)"
_CASE_SPLIT = "case when date_received between '2021-01-01' and '2024-12-31' then 'train' when date_received between '2025-01-01' and '2025-02-28' then 'excluded' when date_received between '2025-03-01' and '2025-06-30' then 'validation' when date_received between '2025-07-01' and '2025-12-31' then 'test' else 'out_of_range' end"
_CATEGORY = "concat_ws(' | ', canonical_product, coalesce(nullif(sub_product, ''), '-'), coalesce(nullif(issue, ''), '-'), coalesce(nullif(sub_issue, ''), '-'))"
_ISO = "case when regexp_matches(date_received, '^\\d{4}-\\d{2}-\\d{2}([T ].*)?$') then try_cast(substr(date_received, 1, 10) as date) end"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "dedup_first": dedup_first, "coverage_check": coverage_check, "two_ended_union": two_ended_union, "typed_records": typed_records, "record_problems": record_problems, "iso_date": iso_dates,
    "canonical_product": canonical_products, "unrecognised_pairs": unrecognised_pairs, "split_counts": split_counts, "label_counts": label_counts, "company_key": company_keys,
    "issue_category": issue_category, "contains": contains, "unique_ids": unique_ids, "jsonl_roundtrip": jsonl_roundtrip, "parquet_roundtrip": parquet_roundtrip,
}
ORACLES = {
    "dedup_first": f"select delivery_id, run_id, trim(complaint_id, ' \t\n\r') as complaint_id from ({_FIRST})",
    "coverage_check": "with g as (select run_id, count(distinct trim(complaint_id, ' \t\n\r')) as got from raw_records where trim(coalesce(complaint_id, ''), ' \t\n\r') <> '' group by 1) select run_id, records as expected, coalesce(got, 0) as got, coalesce(got, 0) = records as complete from fetch_stats left join g using (run_id)",
    "two_ended_union": "select cast(date_trunc('year', date_received) as date) as year, count(distinct complaint_id) as n from complaints group by 1",
    "typed_records": "select * from complaints",
    "unrecognised_pairs": f"with {_DIMS} select r.product, r.sub_product, count(*) as n from raw_records r left join subs s on s.sub = r.sub_product left join labels l on l.label = r.product and l.product = s.product where nullif(r.sub_product, '') is not null and l.product is null group by all",
    "record_problems": f"""with {_DIMS}, r as (select r.*, {_ISO} as received, {_ISO.replace('date_received', 'date_sent_to_company')} as sent, s.product as by_sub, l.product as filed, o.product as only_one from raw_records r
      left join subs s on s.sub = nullif(r.sub_product, '') left join labels l on l.label = r.product and l.product = s.product left join sole o on o.label = r.product),
    p as (select case when trim(coalesce(complaint_id, ''), ' \t\n\r') = '' then 'no id' when trim(coalesce(complaint_what_happened, ''), ' \t\n\r') = '' then 'no narrative' when coalesce(product, '') = '' then 'no product'
      when coalesce(company_response, '') = '' then 'no outcome' when coalesce(timely, '') not in ('Yes', 'No') then 'timely is neither Yes nor No' when received is null then 'no day received'
      when company_response not in ('Closed with explanation', 'Closed with monetary relief', 'Closed with non-monetary relief', 'Untimely response', 'In progress') then 'unknown outcome' when sent is null then 'no day sent'
      when coalesce(issue, '') = '' then 'no issue' when coalesce(company, '') = '' then 'no company' when coalesce(zip_code, '') = '' then 'no zip code' when coalesce(submitted_via, '') = '' then 'no channel'
      when coalesce(case when by_sub is not null then filed else only_one end, '') = '' then 'unresolved product' end as problem from r) select problem, count(*) as n from p where problem is not null group by 1""".replace("\\t\\n\\r", "\t\n\r"),
    "iso_date": f"select delivery_id, {_ISO} as received, case timely when 'Yes' then true when 'No' then false end as timely from raw_records",
    "canonical_product": "select complaint_id, canonical_product as product from complaints",
    "split_counts": f"select {_CASE_SPLIT} as split, count(*) as n, count(*) filter (where label = 'needed_human') as n_positive, count(*) filter (where label = 'excluded') as n_excluded from complaints group by 1",
    "label_counts": "select case when company_response like 'Closed with %relief' then 'needed_human' when company_response = 'Closed with explanation' then 'no_relief' when company_response in ('Untimely response', 'In progress') then 'excluded' else error('unknown') end as label, count(*) as n from complaints group by 1",
    "company_key": "select regexp_replace(upper(company), '[^A-Z0-9]+', '', 'g') as company_id, count(*) as n from complaints group by 1",
    "issue_category": f"select complaint_id, {_CATEGORY} as category_id from complaints",
    "contains": f"select distinct canonical_product, {_CATEGORY} as category_id from complaints",
    "unique_ids": "select split, count(*) as n, count(distinct complaint_id) as n_ids from complaints group by 1",
    "jsonl_roundtrip": "select * from raw_records",
    "parquet_roundtrip": "select * from complaints",
}
