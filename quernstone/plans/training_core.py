"""Queries for skewed keys (p3) and repeated deliveries (p7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quernstone.operators.balance import balanced_aggregate
from quernstone.operators.delivery import blank_to_null, deduplicated, mark_deliveries
from quernstone.plans.session import table

ORDER = ["fetched_at", "delivery_id"]


def company_id(c: Column) -> Column:
    """The respondent's key: upper case, everything but A-Z and 0-9 removed."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "")


def p3_respondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures per respondent, with its name from ``companies`` (null for an unknown one)."""
    rows = table(spark, sf_dir, "complaints").select("complaint_id", company_id(F.col("company")).alias("company_id"), "date_received", "date_sent_to_company", "label", "timely", F.length("narrative").alias("chars"))
    side = table(spark, sf_dir, "companies").select("company_id", "name", "n_prior_complaints")
    one = lambda c: F.when(c, 1).otherwise(0)
    figures = {
        "n": ("sum", F.lit(1)),
        "n_needed_human": ("sum", one(F.col("label") == "needed_human")),
        "n_late_reply": ("sum", one(~F.col("timely"))),
        "n_sent_before_received": ("sum", one(F.col("date_sent_to_company") < F.col("date_received"))),
        "narrative_chars": ("sum", F.col("chars")),
        "first_received": ("min", F.col("date_received")),
        "last_received": ("max", F.col("date_received")),
    }
    return balanced_aggregate(rows, "company_id", figures, side, spread=["complaint_id"])


P3_RESPONDENTS_SQL = """
with r as (select regexp_replace(upper(company), '[^A-Z0-9]+', '', 'g') as company_id, * from complaints)
select r.company_id, count(*) as n, count(*) filter (where label = 'needed_human') as n_needed_human, count(*) filter (where not timely) as n_late_reply,
  count(*) filter (where date_sent_to_company < date_received) as n_sent_before_received, cast(sum(length(narrative)) as bigint) as narrative_chars,
  min(date_received) as first_received, max(date_received) as last_received, any_value(c.name) as name, any_value(c.n_prior_complaints) as n_prior_complaints
from r left join companies c using (company_id) group by r.company_id
"""


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Respondents holding at least 2 % of the rows of ``complaints``."""
    rows = table(spark, sf_dir, "complaints").select("complaint_id", company_id(F.col("company")).alias("company_id"))
    per = balanced_aggregate(rows, "company_id", {"n": ("sum", F.lit(1))}, spread=["complaint_id"])
    total = table(spark, sf_dir, "complaints").count()
    return per.where(F.col("n") * 50 >= total).select("company_id")


P3_FOUND_SQL = """
select regexp_replace(upper(company), '[^A-Z0-9]+', '', 'g') as company_id from complaints group by 1
having count(*) * 50 >= (select count(*) from complaints)
"""


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries to drop."""
    rows = table(spark, sf_dir, "raw_records").select("delivery_id", "fetched_at", "complaint_id")
    return mark_deliveries(rows, "complaint_id", ORDER).where("is_surplus").select("delivery_id")


_P7_RANKED = "select *, row_number() over (partition by trim(complaint_id, ' \t\n\r') order by fetched_at, delivery_id) as place from raw_records where trim(coalesce(complaint_id, ''), ' \t\n\r') <> ''"
P7_FOUND_SQL = f"select delivery_id from ({_P7_RANKED}) where place > 1"


def p7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records themselves, each message once, whole payloads."""
    return deduplicated(table(spark, sf_dir, "raw_records"), "complaint_id", ORDER)


P7_RECORDS_SQL = f"select * from raw_records where delivery_id not in ({P7_FOUND_SQL})"


def p7_run_surplus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surplus deliveries within each run, beside ``fetch_stats.duplicates`` (null where the run broke off)."""
    rows = table(spark, sf_dir, "raw_records").select("run_id", "complaint_id")
    # counted per (run, id) first, so that neither a run nor an id with very many rows is gathered in one task
    per = rows.groupBy("run_id", blank_to_null(F.col("complaint_id")).alias("id")).agg(F.count("*").alias("n")).where(F.col("id").isNotNull())
    runs = per.groupBy("run_id").agg(F.count("*").alias("distinct_ids"), F.sum(F.col("n") - 1).alias("surplus"))
    stats = table(spark, sf_dir, "fetch_stats").select("run_id", "records", "duplicates")
    return stats.join(runs, "run_id", "left").select("run_id", F.coalesce("distinct_ids", F.lit(0)).alias("distinct_ids"), F.coalesce("surplus", F.lit(0)).alias("surplus"), "records", "duplicates", (F.col("duplicates") == F.coalesce("surplus", F.lit(0))).alias("agrees"))


P7_RUN_SURPLUS_SQL = """
with r as (select run_id, trim(complaint_id, ' \t\n\r') as id from raw_records where trim(coalesce(complaint_id, ''), ' \t\n\r') <> ''),
g as (select run_id, count(distinct id) as distinct_ids, count(*) - count(distinct id) as surplus from r group by run_id)
select run_id, coalesce(distinct_ids, 0) as distinct_ids, coalesce(surplus, 0) as surplus, records, duplicates, duplicates = coalesce(surplus, 0) as agrees
from fetch_stats left join g using (run_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p3_found": p3_found, "p3_respondents": p3_respondents, "p7_found": p7_found, "p7_records": p7_records, "p7_run_surplus": p7_run_surplus}
ORACLES = {"p3_found": P3_FOUND_SQL, "p3_respondents": P3_RESPONDENTS_SQL, "p7_found": P7_FOUND_SQL, "p7_records": P7_RECORDS_SQL, "p7_run_surplus": P7_RUN_SURPLUS_SQL}
