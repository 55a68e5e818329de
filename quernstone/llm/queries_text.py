"""Queries for sampling (p5), encoding (p8) and packing (p9)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.llm.bpe import count_tokens, encode
from quernstone.llm.packing import Packed, pack
from quernstone.llm.sampling import systematic_sample
from quernstone.plans.session import table

CAPACITY = 1024


def _sampled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "complaints").select("complaint_id", "split", "company_response")
    return systematic_sample(rows, table(spark, sf_dir, "sample_targets"), "split", "company_response", "complaint_id")


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir)[0]


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir)[1]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that cannot be reached."""
    return _sampled(spark, sf_dir)[1].where(~F.col("target_met")).select("split", "company_response")


P5_FOUND_SQL = """
with s as (select split, count(*) as n from complaints group by split),
c as (select split, company_response, count(*) as n from complaints group by all)
select t.split, t.company_response from sample_targets t left join s on s.split = t.split left join c on c.split = t.split and c.company_response = t.company_response
where coalesce(c.n, 0) < t.target_share * t.sample_fraction * coalesce(s.n, 0)
"""


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document in byte_bpe_50k."""
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "ids")


def _packed(spark: SparkSession, sf_dir: str) -> Packed:
    sized = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "n_tokens")
    return pack(sized, "doc_id", "n_tokens", CAPACITY)


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of every part of a document that had to be split."""
    return _packed(spark, sf_dir).placements


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group packed in any round, and (round and grp null) all documents: containers, the bound that certifies them, the gap, unused space."""
    packed = _packed(spark, sf_dir)
    return packed.groups.unionByName(packed.whole.withColumn("kept", F.col("containers")), allowMissingColumns=True)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that stand in more than one container once all are packed."""
    placed = p9_containers(spark, sf_dir).where("container is not null")
    return placed.groupBy("doc_id").agg(F.count_distinct("container").alias("n")).where("n > 1").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p5_found": p5_found, "p5_report": p5_report, "p5_sample": p5_sample, "p8_ids": p8_ids, "p9_found": p9_found, "p9_containers": p9_containers, "p9_report": p9_report}
ORACLES = {"p5_found": P5_FOUND_SQL}
