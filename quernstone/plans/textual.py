"""Queries on the texts of cases: evidence, names, fingerprints, term weights, similar earlier cases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.functions.expressions import AMOUNT, DATE, REDACTED_AMOUNT, REDACTED_DATE, amounts, evidence, fingerprint, own_words
from quernstone.functions.vocabulary import EVAL_SPLITS, GENERIC_WORDS
from quernstone.operators import retrieval as R
from quernstone.operators.masking import mask, mentions_own
from quernstone.plans.ingest import cases
from quernstone.plans.session import checkpointed

#: Neighbours wanted, and every how manieth id is a query: all.
K, EVERY = 5, 1


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that may be shown as precedents: train, with a usable outcome; none left raises."""
    rows = cases(spark, sf_dir).where("split = 'train' and label <> 'excluded'")
    if rows.isEmpty():
        raise ValueError("no eligible case")
    return rows


def eligible_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligible(spark, sf_dir).groupBy("canonical_product").agg(F.count("*").alias("n"))


def evidence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = evidence(F.col("narrative"), unicode=False)
    return cases(spark, sf_dir).select("complaint_id", *[c.alias(n) for n, c in flags.items()])


def amounts_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("complaint_id", amounts(F.col("narrative"), unicode=False).alias("amounts"))


def fingerprint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are one submission but for case, blanks and how they were redacted, in several cases."""
    rows = cases(spark, sf_dir).select("complaint_id", "split", fingerprint(F.col("narrative"), unicode=False).alias("fp"))
    return rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("complaint_id").alias("first_id"), F.countDistinct("split").alias("n_splits")).where("n > 1")


def name_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinctive words of all respondents' names."""
    names = cases(spark, sf_dir).select("company").distinct()
    return names.select(F.explode(own_words(F.col("company"), GENERIC_WORDS)).alias("word")).groupBy("word").agg(F.count("*").alias("n_spellings"))


def self_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many validation cases name their own respondent in the text, by respondent."""
    rows = cases(spark, sf_dir).where("split = 'validation' and label <> 'excluded'").select("company", "narrative")
    own = own_words(F.col("company"), GENERIC_WORDS)
    rows = rows.withColumn("own", own).where(F.size("own") > 0)
    return rows.groupBy("company").agg(F.count("*").alias("n"), F.count_if(mentions_own(F.col("narrative"), F.col("own"))).alias("n_named"))


def mask_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-cased texts with every respondent's distinctive words masked."""
    words = name_words(spark, sf_dir).select("word")
    return mask(cases(spark, sf_dir).select("complaint_id", F.lower("narrative").alias("text")), "complaint_id", "text", words, "word", "COMPANYNAME")


def agent_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be seen before the outcome; the respondent isn't shown."""
    seen = ["complaint_id", "date_received", "canonical_product", "product_label", "sub_product", "issue", "sub_issue", "narrative", "state", "zip_code", "tags", "submitted_via"]
    return cases(spark, sf_dir).select(*seen, F.lit(None).cast("string").alias("company"))


def render_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as lines of name and value, absent values as a dash."""
    shown = ["complaint_id", "date_received", "canonical_product", "sub_product", "issue", "sub_issue", "submitted_via", "tags", "state"]
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in shown]
    return cases(spark, sf_dir).select("complaint_id", F.concat_ws("\n", *lines, F.concat(F.lit("narrative: "), F.col("narrative"))).alias("text"))


def resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes, for evaluation only."""
    return cases(spark, sf_dir).where(F.col("split").isin(EVAL_SPLITS)).select("complaint_id", "company_response", "label", "timely", "date_sent_to_company")


def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per text: how many of its terms are in the vocabulary of its product, and the largest and the sum of their weights."""
    corpus = eligible(spark, sf_dir).select("canonical_product", "complaint_id", "narrative")
    sizes = corpus.groupBy("canonical_product").agg(F.count("*").alias("n"))
    postings = checkpointed(R.counts(corpus, "canonical_product", "complaint_id", "narrative"))
    weights = R.weighted(postings, R.vocabulary(postings, "canonical_product", sizes, 2), "canonical_product", "complaint_id")
    return weights.groupBy("complaint_id").agg(F.count("*").alias("n_terms"), F.round(F.max("w"), 6).alias("w_max"), F.round(F.sum("w"), 6).alias("w_sum"))


def similar_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier similar cases for every case."""
    columns = ["canonical_product", "complaint_id", "date_received", "narrative"]
    return R.similar(eligible(spark, sf_dir).select(columns), cases(spark, sf_dir).select(columns), "canonical_product", "complaint_id", "date_received", "narrative", fingerprint(F.col("narrative")), K)


def find_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precedents as they are shown: with outcome, similarity to four digits."""
    found = similar_to(spark, sf_dir)
    info = eligible(spark, sf_dir).select(F.col("complaint_id").alias("neighbour"), "label", "issue")
    return found.join(info, "neighbour").select("query", "neighbour", "label", "issue", F.round("similarity", 4).alias("similarity"), "rank")


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(company), '[^a-z0-9]+'), lambda w: length(w) > 2 and w not in (" + ", ".join(f"'{w}'" for w in GENERIC_WORDS) + ")))"
_FP = "md5(replace(replace(replace(regexp_replace(regexp_replace(upper(narrative), '\\s+', ' ', 'g'), '^ | $', '', 'g'), 'XXXX', 'X'), 'XXX', 'X'), 'XX', 'X'))"
_TERMS = r"""c as (select canonical_product as g, complaint_id as id, regexp_extract_all(lower(strip_accents(narrative)), '[\p{L}\p{N}_]{2,}') as w from complaints where split = 'train' and label <> 'excluded'),
t as (select g, id, unnest(w || case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else [] end) as term from c),
p as (select g, id, term, count(*) as tf from t group by all), n as (select g, count(*) as n from c group by g),
v as (select p.g, term, ln((1 + any_value(n)) / (1 + count(*))) + 1 as idf from p join n using (g) group by p.g, term having count(*) >= 2),
r as (select p.g, id, term, (1 + ln(tf)) * idf as w from p join v using (g, term)),
z as (select id, sqrt(sum(w * w)) as z from r group by id)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "eligible_corpus": eligible_corpus, "evidence_flags": evidence_flags, "amounts": amounts_found, "fingerprint_groups": fingerprint_groups, "name_tokens": name_words, "self_naming": self_naming,
    "mask_names": mask_names, "agent_view": agent_view, "render_view": render_view, "resolution": resolution, "tfidf_weights": tfidf_weights, "similar_to": similar_to, "find_objects": find_objects,
}
_SEEN = "complaint_id, date_received, canonical_product, product_label, sub_product, issue, sub_issue, narrative, state, zip_code, tags, submitted_via"
ORACLES = {
    "eligible_corpus": "select canonical_product, count(*) as n from complaints where split = 'train' and label <> 'excluded' group by 1",
    "evidence_flags": f"select complaint_id, a as has_amount, ra as has_redacted_amount, d as has_date, rd as has_redacted_date, a or ra as mentions_amount, d or rd as mentions_date from (select complaint_id, regexp_matches(narrative, '{AMOUNT}') as a, regexp_matches(narrative, '{REDACTED_AMOUNT}') as ra, regexp_matches(narrative, '{DATE}') as d, regexp_matches(narrative, '{REDACTED_DATE}') as rd from complaints)",
    "amounts": f"select complaint_id, list_transform(regexp_extract_all(narrative, '{AMOUNT}', 1), lambda x: cast(replace(x, ',', '') as double)) as amounts from complaints",
    "fingerprint_groups": f"select {_FP} as fp, count(*) as n, min(complaint_id) as first_id, count(distinct split) as n_splits from complaints group by 1 having count(*) > 1",
    "name_tokens": f"select word, count(*) as n_spellings from (select unnest({_WORDS}) as word from (select distinct company from complaints)) group by 1",
    "self_naming": f"select company, count(*) as n, count(*) filter (where len(list_filter(own, lambda w: regexp_matches(lower(narrative), '\\b' || w || '\\b'))) > 0) as n_named from (select company, narrative, {_WORDS} as own from complaints where split = 'validation' and label <> 'excluded') where len(own) > 0 group by 1",
    "mask_names": f"select complaint_id, regexp_replace(lower(narrative), (select '\\b(' || string_agg(word, '|' order by length(word) desc, word) || ')\\b' from (select distinct unnest({_WORDS}) as word from complaints)), 'COMPANYNAME', 'g') as text from complaints",
    "agent_view": f"select {_SEEN}, cast(null as varchar) as company from complaints",
    "render_view": "select complaint_id, concat_ws(chr(10), " + ", ".join(f"'{c}: ' || coalesce(cast({c} as varchar), '-')" for c in ["complaint_id", "date_received", "canonical_product", "sub_product", "issue", "sub_issue", "submitted_via", "tags", "state"]) + ", 'narrative: ' || narrative) as text from complaints",
    "resolution": "select complaint_id, company_response, label, timely, date_sent_to_company from complaints where split in ('validation', 'test')",
    "tfidf_weights": f"with {_TERMS} select id as complaint_id, count(*) as n_terms, round(max(w / z), 6) as w_max, round(sum(w / z), 6) as w_sum from r join z using (id) group by id",
}
