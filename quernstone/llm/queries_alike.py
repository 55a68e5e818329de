"""Queries for overlap between splits (p1) and near-duplicates (p4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.llm.linking import Linked, components, expanded
from quernstone.llm.overlap import cross_split_pairs
from quernstone.llm.pigeonhole import near_duplicates
from quernstone.plans.session import checkpointed, table

#: As the problems state: sequences of three words, 0.6 of them in both. No pair lies between 0.5 and 0.7.
WORDS, SIMILARITY, NEAREST = 3, 0.6, 0.7


def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "complaints").select("complaint_id", "narrative", "split")
    side = F.when(F.col("split") == "train", F.lit(False)).when(F.col("split").isin("validation", "test"), F.lit(True))
    return cross_split_pairs(rows, "complaint_id", "narrative", side, WORDS, SIMILARITY, NEAREST)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _overlap(spark, sf_dir)
    return pairs.select(F.least("eval_id", "train_id").alias("complaint_id_1"), F.greatest("eval_id", "train_id").alias("complaint_id_2"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation split and source: its complaints, those found in train, exactly or nearly, and the pairs."""
    pairs = checkpointed(_overlap(spark, sf_dir))
    per = pairs.groupBy(F.col("eval_id").alias("complaint_id")).agg(F.count("*").alias("pairs"), F.max("jaccard").alias("best"))
    rows = table(spark, sf_dir, "complaints").where(F.col("split").isin("validation", "test")).select("complaint_id", "split", "submitted_via")
    return rows.join(per, "complaint_id", "left").groupBy("split", "submitted_via").agg(
        F.count("*").alias("n_complaints"), F.count("pairs").alias("n_overlapping"), F.count_if(F.col("best") == 1.0).alias("n_same_words"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs")
    )


def _alike(spark: SparkSession, sf_dir: str) -> Linked:
    return near_duplicates(table(spark, sf_dir, "complaints").select("complaint_id", "narrative"), "complaint_id", "narrative", WORDS, SIMILARITY, NEAREST)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expanded(_alike(spark, sf_dir)).select(F.col("id_1").alias("complaint_id_1"), F.col("id_2").alias("complaint_id_2"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every complaint that is alike another: its class (least id with the same sequences), the links of its class to other classes,
    and its group (least id that a chain of links leads to)."""
    found = _alike(spark, sf_dir)
    ends = found.links.select(F.col("a").alias("rep")).unionAll(found.links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    groups = components(found.links).select(F.col("id").alias("rep"), F.col("group").alias("group_id"))
    sizes = found.members.groupBy("rep").agg(F.count("*").alias("n_class"))
    classes = sizes.join(ends, "rep", "left").join(groups, "rep", "left").where("n_class > 1 or n_links > 0")
    return found.members.join(classes, "rep").select(F.col("id").alias("complaint_id"), F.col("rep").alias("class_id"), "n_class", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "rep").alias("group_id"))


_SETS = r"""
w as (select complaint_id, split, submitted_via, regexp_extract_all(lower(narrative), '[\p{L}\p{N}]+') as w from complaints),
s as (select distinct complaint_id, split, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g from w where len(w) >= 3),
z as (select complaint_id, count(*) as n from s group by all)
"""
P4_FOUND_SQL = f"""
with {_SETS}, m as (select a.complaint_id as i, b.complaint_id as j, count(*) as k from s a join s b on a.g = b.g and a.complaint_id < b.complaint_id group by all)
select i as complaint_id_1, j as complaint_id_2 from m join z x on x.complaint_id = i join z y on y.complaint_id = j where k >= 0.6 * (x.n + y.n - k)
"""
P1_FOUND_SQL = f"""
with {_SETS}, m as (select a.complaint_id as i, b.complaint_id as j, count(*) as k from s a join s b on a.g = b.g and a.split = 'train' and b.split in ('validation', 'test') group by all)
select least(i, j) as complaint_id_1, greatest(i, j) as complaint_id_2 from m join z x on x.complaint_id = i join z y on y.complaint_id = j where k >= 0.6 * (x.n + y.n - k)
"""
P1_REPORT_SQL = f"""
with {_SETS}, m as (select a.complaint_id as i, b.complaint_id as j, count(*) as k from s a join s b on a.g = b.g and a.split = 'train' and b.split in ('validation', 'test') group by all),
p as (select j as complaint_id, count(*) as pairs, max(k / (x.n + y.n - k)) as best from m join z x on x.complaint_id = i join z y on y.complaint_id = j where k >= 0.6 * (x.n + y.n - k) group by j)
select split, submitted_via, count(*) as n_complaints, count(pairs) as n_overlapping, count(*) filter (where best = 1) as n_same_words, cast(coalesce(sum(pairs), 0) as bigint) as n_pairs
from complaints left join p using (complaint_id) where split in ('validation', 'test') group by all
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_report": p1_report, "p4_found": p4_found, "p4_groups": p4_groups}
ORACLES = {"p1_found": P1_FOUND_SQL, "p1_report": P1_REPORT_SQL, "p4_found": P4_FOUND_SQL}
