"""Queries that measure a decider. The decider goes by each respondent's own past: the more of its earlier cases needed a human, the
less sure it is that one can close unattended."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quernstone.functions.expressions import company_key
from quernstone.functions.vocabulary import EVAL_SPLITS, RETIRED_LABEL
from quernstone.operators import bootstrap as B, metrics as M
from quernstone.operators.delivery import blank_to_null
from quernstone.operators.history import as_of, rate
from quernstone.operators.samples import filled, first_per_cell, shuffled, stratified
from quernstone.plans.ingest import cases, scratch
from quernstone.plans.session import checkpointed
from quernstone.sources import transcripts

SEED, PER_CLASS, DRAWS = "20250701", 100, 20
#: The reference's number of draws. bootstrap_arr and paired_auc keep DRAWS, which their SQL states.
FULL_DRAWS = 1000
#: The reference's sizes of samples; the queries ending in _full use them, the others PER_CLASS and 500, which their SQL states.
FULL_PER_CLASS, FULL_COVERAGE = 250, 3000
TARGETS = [0.01, 0.02, 0.05, 0.10, 0.15, 0.20, 0.25]


def company_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case with what its respondent's earlier train cases were."""
    rows = cases(spark, sf_dir).select("complaint_id", "split", "label", "date_received", company_key(F.col("company")).alias("company_id"))
    history = (F.col("split") == "train") & (F.col("label") != "excluded")
    one = lambda c: F.when(c, 1).otherwise(0)
    out = as_of(rows, "company_id", "date_received", {"n_prior": one(history), "n_prior_human": one(history & (F.col("label") == "needed_human"))})
    return out.select("complaint_id", "split", "label", "company_id", "n_prior", "n_prior_human", F.round(rate(F.col("n_prior_human"), F.col("n_prior")), 6).alias("prior_rate"))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(complaint_id, split, c, y) of evaluation cases with an outcome."""
    rows = company_asof(spark, sf_dir).where(F.col("split").isin(EVAL_SPLITS) & (F.col("label") != "excluded"))
    c = F.round(1 - (F.col("n_prior_human") + 1) / (F.col("n_prior") + 2), 6)
    return rows.select("complaint_id", "split", c.alias("c"), F.when(F.col("label") == "needed_human", 1).otherwise(0).alias("y"))


def _validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).where("split = 'validation'")


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.frontier(_validation(spark, sf_dir))


def best_at_frr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpointed(_validation(spark, sf_dir))
    best = M.best_at(M.frontier(rows), TARGETS, rows.count())
    return best.select("target", "tau", "n_auto", "n_false", F.round("arr", 6).alias("arr"), F.round("frr", 6).alias("frr"))


def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.reliability(_validation(spark, sf_dir)).select("bin", "n", F.round("stated", 6).alias("stated"), F.round("observed", 6).alias("observed"))


def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ece(_validation(spark, sf_dir)).select(F.round("ece", 6).alias("ece"))


def auc_ap_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decided(spark, sf_dir).withColumn("p", F.round(1 - F.col("c"), 6))
    return M.ranking(rows, "p", "y", ["split"]).select("split", *[F.round(c, 6).alias(c) for c in ("auc", "average_precision", "brier")])


def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpointed(_validation(spark, sf_dir))
    return M.envelope(M.frontier(rows), rows.count()).select(F.round("budget", 6).alias("budget"), F.round("arr", 6).alias("arr"))


def tau_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.sweep(_validation(spark, sf_dir))


def stratified_sample(spark: SparkSession, sf_dir: str, per_class: int = PER_CLASS) -> DataFrame:
    rows = _validation(spark, sf_dir)
    return stratified(rows, "y", "complaint_id", per_class, SEED).select("complaint_id", "y", F.round("weight", 6).alias("weight"))


def eval_join(spark: SparkSession, sf_dir: str, per_class: int = PER_CLASS) -> DataFrame:
    """Sampled cases with confidence, truth and weight."""
    sample = stratified_sample(spark, sf_dir, per_class).select("complaint_id", "weight")
    return _validation(spark, sf_dir).join(sample, "complaint_id").select("complaint_id", "c", "y", "weight")


def base_rate(spark: SparkSession, sf_dir: str, per_class: int = PER_CLASS) -> DataFrame:
    return eval_join(spark, sf_dir, per_class).agg(F.round(F.sum(F.col("weight") * F.col("y")) / F.sum("weight"), 6).alias("base_rate"))


def eval_summary(spark: SparkSession, sf_dir: str, per_class: int = PER_CLASS) -> DataFrame:
    """Sampled decisions by disposition: how many, what weight, how many wrong."""
    rows = eval_join(spark, sf_dir, per_class).withColumn("disposition", F.when(F.col("c") >= 0.8, "close").otherwise("hand_over"))
    return rows.groupBy("disposition").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"), F.sum(F.when(F.col("disposition") == "close", F.col("y")).otherwise(1 - F.col("y"))).alias("n_wrong"))


def scores_semi(spark: SparkSession, sf_dir: str, per_class: int = PER_CLASS) -> DataFrame:
    return decided(spark, sf_dir).join(stratified_sample(spark, sf_dir, per_class), "complaint_id", "left_semi")


def resume_anti(spark: SparkSession, sf_dir: str, per_class: int = PER_CLASS) -> DataFrame:
    """Evaluation cases that no sample holds yet, counted per split."""
    return decided(spark, sf_dir).join(stratified_sample(spark, sf_dir, per_class), "complaint_id", "left_anti").groupBy("split").agg(F.count("*").alias("n"))


def missing_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered ids that no typed case has."""
    raw = spark.read.parquet(f"{sf_dir}/raw_records.parquet").select(blank_to_null(F.col("complaint_id")).alias("complaint_id")).where("complaint_id is not null").distinct()
    return raw.join(cases(spark, sf_dir).select("complaint_id"), "complaint_id", "left_anti")


def bootstrap_arr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the share that can close unattended at a budget of 0.25; the threshold is chosen anew in each draw."""
    rows = checkpointed(_validation(spark, sf_dir))
    n = rows.count()
    points = M.frontier(M.resampled(rows, ["complaint_id"], DRAWS, SEED), w="k", by=["draw"])
    best = points.where(F.col("n_false") <= 0.25 * F.col("n_auto")).groupBy("draw").agg(F.max("n_auto").alias("n_auto"))
    arr = spark.range(DRAWS).withColumnRenamed("id", "draw").join(best, "draw", "left").select((F.coalesce("n_auto", F.lit(0)) / F.lit(float(max(n, 1)))).alias("arr"))
    return arr.agg(F.round(F.avg("arr"), 6).alias("mean"), F.round(F.percentile("arr", 0.025), 6).alias("low"), F.round(F.percentile("arr", 0.975), 6).alias("high"))


def paired_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain in area of the decider over one that goes by the length of the respondent's history, on the same draws."""
    rows = company_asof(spark, sf_dir).where("split = 'validation' and label <> 'excluded'")
    p = F.round((F.col("n_prior_human") + 1) / (F.col("n_prior") + 2), 6)
    rows = checkpointed(rows.select("complaint_id", p.alias("p"), (-F.col("n_prior")).cast("double").alias("q"), F.when(F.col("label") == "needed_human", 1).otherwise(0).alias("y")))
    drawn = checkpointed(M.resampled(rows, ["complaint_id"], DRAWS, SEED))
    each = drawn.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("k"))))
    a = M.ranking(each, "p", "y", ["draw"]).select("draw", F.col("auc").alias("a"))
    b = M.ranking(each, "q", "y", ["draw"]).select("draw", F.col("auc").alias("b"))
    gain = a.join(b, "draw").where("a is not null").select((F.col("a") - F.col("b")).alias("gain"))
    return gain.agg(F.round(F.avg("gain"), 6).alias("mean"), F.round(F.percentile("gain", 0.025), 6).alias("low"), F.round(F.percentile("gain", 0.975), 6).alias("high"))


def _interval(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and 95 % percentile interval over draws."""
    return df.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.percentile(value, 0.025), 6).alias("low"), F.round(F.percentile(value, 0.975), 6).alias("high"))


def bootstrap_arr_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each budget the share that can close unattended, with its interval over the reference's number of draws; nulls where no
    threshold holds the budget."""
    rows = checkpointed(_validation(spark, sf_dir))
    best = M.best_at(M.frontier(rows), TARGETS, rows.count()).select("target", F.round("arr", 6).alias("arr"))
    drawn = _interval(B.shares(rows, "complaint_id", "c", "y", TARGETS, FULL_DRAWS, SEED), ["target"], "arr")
    reached = lambda c: F.when(F.col("arr").isNotNull(), F.col(c)).alias(c)
    return best.join(drawn, "target", "left").select("target", "arr", reached("mean"), reached("low"), reached("high"))


def paired_auc_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gain of paired_auc over the reference's number of draws."""
    rows = company_asof(spark, sf_dir).where("split = 'validation' and label <> 'excluded'")
    p = F.round((F.col("n_prior_human") + 1) / (F.col("n_prior") + 2), 6)
    rows = checkpointed(rows.select("complaint_id", p.alias("p"), (-F.col("n_prior")).cast("double").alias("q"), F.when(F.col("label") == "needed_human", 1).otherwise(0).alias("y")))
    return _interval(B.gains(rows, "complaint_id", "y", [("q", "p")], FULL_DRAWS, SEED), [], "gain")


def trace_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three cases of readable length for each outcome, in seeded order."""
    rows = cases(spark, sf_dir).where(F.col("split").isin(EVAL_SPLITS) & F.length("narrative").between(400, 2000)).select("complaint_id", "label")
    w = Window.partitionBy("label").orderBy(shuffled(SEED, F.col("complaint_id")), "complaint_id")
    return rows.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3")


def _cells() -> F.Column:
    col, lit = F.col, F.lit
    cell = lambda name, *parts: F.concat_ws("/", lit(name), *parts)
    flag = lambda c: F.when(c, "true").otherwise("false")
    cells = F.array(
        cell("split_product_label", col("split"), col("canonical_product"), col("label")), cell("response", col("company_response")), cell("submitted_via", col("submitted_via")),
        cell("redacted", flag(F.contains("narrative", lit("XX")))), cell("has_sub_issue", flag(col("sub_issue").isNotNull())), cell("has_tags", flag(col("tags").isNotNull())),
        cell("has_public_response", flag(col("company_public_response").isNotNull())), F.when(col("product_label") == RETIRED_LABEL, cell("retired_label", col("canonical_product"))),
    )
    return F.filter(cells, lambda c: c.isNotNull())


def coverage_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select(F.explode(_cells()).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))


def coverage_sample(spark: SparkSession, sf_dir: str, target: int = 500) -> DataFrame:
    """The first three cases of every cell, filled to ``target`` in seeded order."""
    rows = cases(spark, sf_dir)
    chosen = checkpointed(first_per_cell(rows, _cells(), "complaint_id", F.col("complaint_id").cast("long"), 3))
    return filled(rows.select("complaint_id", "split", "label"), chosen, "complaint_id", target, SEED)


def transcript_replay(spark: SparkSession, sf_dir: str, per_class: int = PER_CLASS) -> DataFrame:
    """Episodes of the sampled cases written as JSON lines, read back, scored: accepted, undecided and broken off."""
    rows = eval_join(spark, sf_dir, per_class)
    block = F.to_json(F.struct(F.when(F.col("c") >= 0.8, "close").otherwise("hand_over").alias("disposition"), F.col("c").alias("confidence")))
    kind = F.pmod(F.xxhash64("complaint_id"), F.lit(10))
    episodes = rows.select("complaint_id", F.when(kind == 0, F.array(F.lit("no decision"))).otherwise(F.array(F.lit("let me see"), block)).alias("responses"), F.when(kind == 1, "timeout").alias("error"))
    path = scratch(spark)
    transcripts.write(episodes, path)
    decided_ = transcripts.decisions(transcripts.read(spark, path))
    return decided_.groupBy("disposition", F.coalesce("rejection", F.lit("accepted")).alias("rejection")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constant decider: the share of train cases that needed a human, for every evaluation case."""
    rate_ = cases(spark, sf_dir).where("split = 'train' and label <> 'excluded'").agg(F.round(F.avg(F.when(F.col("label") == "needed_human", 1).otherwise(0)), 6)).first()[0]
    return decided(spark, sf_dir).select("complaint_id", F.round(1 - F.lit(rate_), 6).alias("c"), "y")


def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per evaluation case, a confidence column per decider."""
    return decided(spark, sf_dir).select("complaint_id", "split", F.col("y").alias("needed_human"), F.col("c").alias("c_company_only")).join(majority(spark, sf_dir).select("complaint_id", F.col("c").alias("c_majority_class")), "complaint_id")


def shape_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.functions.expressions import redactions

    chars, red = F.length("narrative"), redactions(F.col("narrative"))
    return cases(spark, sf_dir).select("complaint_id", F.round(F.log1p(chars), 6).alias("log_chars"), F.round(F.log1p(red), 6).alias("log_redactions"), F.round(red / F.greatest(chars, F.lit(1)), 6).alias("density"))


#: What is known when a case arrives, and what only its outcome shows.
INTAKE = ["product_label", "sub_product", "issue", "sub_issue", "submitted_via", "tags", "state", "company"]
WITHHELD = {"company_response", "date_sent_to_company", "timely", "company_public_response"}


def feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intake columns only, nulls named, with the outcome as a number; a withheld column among them raises."""
    rows = cases(spark, sf_dir).where("label <> 'excluded'").select("complaint_id", "split", "date_received", *[F.coalesce(F.col(c), F.lit("(none)")).alias(c) for c in INTAKE], F.when(F.col("label") == "needed_human", 1).otherwise(0).alias("y"))
    if leaked := WITHHELD & {*rows.columns}:
        raise ValueError(f"withheld columns: {sorted(leaked)}")
    return rows


def onehot_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each intake column in train, rare ones (under five) in one bucket, numbered by frequency."""
    train = feature_frame(spark, sf_dir).where("split = 'train'")
    counts = train.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in INTAKE]), F.array(*INTAKE))).alias("column_name", "value")).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    merged = counts.groupBy("column_name", F.when(F.col("n") >= 5, F.col("value")).otherwise("(rare)").alias("value")).agg(F.sum("n").alias("n"))
    return merged.withColumn("code", F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value")).cast("long") - 1)


_ONE_PAST = "select complaint_id, split, label, date_received, regexp_replace(upper(company), '[^A-Z0-9]+', '', 'g') as company_id from complaints"
_ASOF = f"""r as ({_ONE_PAST}), a as (select *,
  cast(coalesce(sum(case when split = 'train' and label <> 'excluded' then 1 else 0 end) over w, 0) as bigint) as n_prior,
  cast(coalesce(sum(case when split = 'train' and label = 'needed_human' then 1 else 0 end) over w, 0) as bigint) as n_prior_human
  from r window w as (partition by company_id order by date_received range between unbounded preceding and interval 1 day preceding))"""
_DECIDED = f"""{_ASOF}, d as (select complaint_id, split, round(1 - (n_prior_human + 1) / (n_prior + 2), 6) as c, case when label = 'needed_human' then 1 else 0 end as y, n_prior, n_prior_human
  from a where split in ('validation', 'test') and label <> 'excluded'), v as (select * from d where split = 'validation')"""
_POINTS = f"with {_DECIDED}, g as (select c, count(*) as w, sum(y) as wy from v group by c), p as (select c as tau, cast(sum(w) over o as bigint) as n_auto, cast(sum(wy) over o as bigint) as n_false from g window o as (order by c desc))"
_SAMPLE = f"s as (select complaint_id, y, round(n / least(n, {PER_CLASS}), 6) as weight from (select *, row_number() over (partition by y order by md5('{SEED}:' || complaint_id), complaint_id) as k, count(*) over (partition by y) as n from v) where k <= {PER_CLASS})"
_PICKS = f"t as (select *, row_number() over (order by complaint_id) - 1 as i, count(*) over () as n from v), k as (select draw, cast('0x' || substr(md5('{SEED}:' || draw || ':' || j), 1, 8) as bigint) % (select max(n) from t) as i from range({DRAWS}) x(draw), range((select max(n) from t)) y(j)), z as (select * from k join t using (i))"
_FULL_PICKS = _PICKS.replace(f"range({DRAWS})", f"range({FULL_DRAWS})")
_RANK = "(select draw, sum(case when y = 1 then below + same / 2 else 0 end) / (sum(y) * sum(1 - y)) as auc from (select draw, y, sum(1 - y) over (partition by draw order by {0} range between unbounded preceding and current row) - sum(1 - y) over (partition by draw, {0}) as below, sum(1 - y) over (partition by draw, {0}) as same from z2) group by draw)"
_BY_SPLIT = "(select split, sum(case when y = 1 then below + same / 2 else 0 end) / (sum(y) * sum(1 - y)) as auc, sum(case when y = 1 then pos_at / all_at end) / sum(y) as ap, avg((p - y) * (p - y)) as brier from (select *, sum(1 - y) over (partition by split order by p range between unbounded preceding and current row) - sum(1 - y) over (partition by split, p) as below, sum(1 - y) over (partition by split, p) as same, sum(y) over (partition by split order by p desc range between unbounded preceding and current row) as pos_at, count(*) over (partition by split order by p desc range between unbounded preceding and current row) as all_at from q) group by split)"
_BIN = "least(greatest(cast(ceil(round(c * 10, 9)) as int) - 1, 0), 9)"
_CELLS = f"""select complaint_id, unnest(list_filter([concat_ws('/', 'split_product_label', split, canonical_product, label), concat_ws('/', 'response', company_response), concat_ws('/', 'submitted_via', submitted_via),
  'redacted/' || (narrative like '%XX%'), 'has_sub_issue/' || (sub_issue is not null), 'has_tags/' || (tags is not null), 'has_public_response/' || (company_public_response is not null),
  case when product_label = '{RETIRED_LABEL}' then 'retired_label/' || canonical_product end], lambda x: x is not null)) as cell from complaints"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "company_asof": company_asof, "frontier": frontier, "best_at_frr": best_at_frr, "reliability": reliability, "ece": ece, "auc_ap_brier": auc_ap_brier, "envelope": envelope, "tau_sweep": tau_sweep,
    "stratified_sample": stratified_sample, "eval_join": eval_join, "base_rate": base_rate, "eval_summary": eval_summary, "scores_semi": scores_semi, "resume_anti": resume_anti, "missing_anti": missing_anti,
    "bootstrap_arr": bootstrap_arr, "paired_auc": paired_auc, "bootstrap_arr_full": bootstrap_arr_full, "paired_auc_full": paired_auc_full, "trace_pick": trace_pick, "coverage_cells": coverage_cells, "coverage_sample": coverage_sample, "majority": majority, "score_table": score_table, "transcript_replay": transcript_replay,
    "shape_features": shape_features, "feature_frame": feature_frame, "onehot_vocab": onehot_vocab,
}
_FEATURES = "select complaint_id, split, date_received, " + ", ".join(f"coalesce({c}, '(none)') as {c}" for c in INTAKE) + ", case when label = 'needed_human' then 1 else 0 end as y from complaints where label <> 'excluded'"
_MAJORITY = "(select round(1 - round(avg(case when label = 'needed_human' then 1 else 0 end), 6), 6) from complaints where split = 'train' and label <> 'excluded')"
ORACLES = {
    "company_asof": f"with {_ASOF} select complaint_id, split, label, company_id, n_prior, n_prior_human, case when n_prior >= 30 then round(n_prior_human / n_prior, 6) end as prior_rate from a",
    "frontier": f"{_POINTS} select tau, n_auto, n_false from p",
    "best_at_frr": f"{_POINTS}, t as (select unnest({TARGETS}::double[]) as target), b as (select target, max(struct_pack(a := n_auto, tau := tau, f := n_false)) as s from t join p on n_false <= target * n_auto group by target) select target, s.tau as tau, s.a as n_auto, s.f as n_false, round(s.a / (select count(*) from v), 6) as arr, round(s.f / s.a, 6) as frr from t left join b using (target)",
    "reliability": f"with {_DECIDED} select {_BIN} as bin, count(*) as n, round(avg(c), 6) as stated, round(avg(1 - y), 6) as observed from v group by 1",
    "ece": f"with {_DECIDED}, b as (select count(*) as n, avg(c) as s, avg(1 - y) as o from v group by {_BIN}) select round(coalesce(sum(n * abs(s - o)) / sum(n), 0), 6) as ece from b",
    "auc_ap_brier": f"with {_DECIDED}, q as (select split, y, round(1 - c, 6) as p from d) select split, round(auc, 6) as auc, round(ap, 6) as average_precision, round(brier, 6) as brier from {_BY_SPLIT}",
    "envelope": f"{_POINTS}, e as (select cast(ceil(round(n_false / n_auto * 300 / 0.30, 9)) as int) as b, max(n_auto) as m from p group by 1), gg as (select b from range(301) x(b)) select round(gg.b * 0.30 / 300, 6) as budget, round(coalesce(max(e.m), 0) / (select count(*) from v), 6) as arr from gg left join e on e.b <= gg.b group by gg.b",
    "tau_sweep": f"with {_DECIDED}, t as (select round(1 - i / 399, 6) as tau from range(400) x(i)) select tau, count(c) as n_auto, cast(coalesce(sum(y), 0) as bigint) as n_false from t left join v on c >= tau group by tau",
    "stratified_sample": f"with {_DECIDED}, {_SAMPLE} select complaint_id, y, weight from s",
    "eval_join": f"with {_DECIDED}, {_SAMPLE} select complaint_id, c, v.y, weight from v join s using (complaint_id)",
    "base_rate": f"with {_DECIDED}, {_SAMPLE} select round(sum(weight * y) / sum(weight), 6) as base_rate from s",
    "eval_summary": f"with {_DECIDED}, {_SAMPLE}, j as (select case when c >= 0.8 then 'close' else 'hand_over' end as disposition, s.y, weight from v join s using (complaint_id)) select disposition, count(*) as n, round(sum(weight), 6) as weight, cast(sum(case when disposition = 'close' then y else 1 - y end) as bigint) as n_wrong from j group by 1",
    "scores_semi": f"with {_DECIDED}, {_SAMPLE} select complaint_id, split, c, y from d where complaint_id in (select complaint_id from s)",
    "resume_anti": f"with {_DECIDED}, {_SAMPLE} select split, count(*) as n from d where complaint_id not in (select complaint_id from s) group by 1",
    "missing_anti": "select distinct trim(complaint_id, ' \t\n\r') as complaint_id from raw_records where trim(coalesce(complaint_id, ''), ' \t\n\r') <> '' and trim(complaint_id, ' \t\n\r') not in (select complaint_id from complaints)",
    "bootstrap_arr": f"with {_DECIDED}, {_PICKS}, g as (select draw, c, count(*) as w, sum(y) as wy from z group by all), p as (select draw, sum(w) over o as n_auto, sum(wy) over o as n_false from g window o as (partition by draw order by c desc)), b as (select draw, max(n_auto) as m from p where n_false <= 0.25 * n_auto group by draw), rr as (select coalesce(m, 0) / (select count(*) from v) as arr from range({DRAWS}) x(draw) left join b using (draw)) select round(avg(arr), 6) as mean, round(quantile_cont(arr, 0.025), 6) as low, round(quantile_cont(arr, 0.975), 6) as high from rr",
    "paired_auc": f"with {_DECIDED}, {_PICKS}, z2 as (select draw, y, round((n_prior_human + 1) / (n_prior + 2), 6) as p, -n_prior as q from z), ra as {_RANK.format('p')}, rb as {_RANK.format('q')}, rr as (select ra.auc - rb.auc as gain from ra join rb using (draw)) select round(avg(gain), 6) as mean, round(quantile_cont(gain, 0.025), 6) as low, round(quantile_cont(gain, 0.975), 6) as high from rr",
    "bootstrap_arr_full": f"{_POINTS}, {_FULL_PICKS}, t7 as (select unnest({TARGETS}::double[]) as target), b7 as (select target, max(n_auto) / (select count(*) from v) as arr from t7 join p on n_false <= target * n_auto group by target), gd as (select draw, c, count(*) as w, sum(y) as wy from z group by all), pd as (select draw, sum(w) over o as n_auto, sum(wy) over o as n_false from gd window o as (partition by draw order by c desc)), bd as (select target, draw, max(n_auto) as m from t7 join pd on n_false <= target * n_auto group by target, draw), rd as (select target, coalesce(m, 0) / (select count(*) from v) as a from t7 cross join range({FULL_DRAWS}) x(draw) left join bd using (target, draw)), id as (select target, avg(a) as m, quantile_cont(a, 0.025) as l, quantile_cont(a, 0.975) as h from rd group by target) select target, round(arr, 6) as arr, case when arr is not null then round(m, 6) end as mean, case when arr is not null then round(l, 6) end as low, case when arr is not null then round(h, 6) end as high from id left join b7 using (target)",
    "paired_auc_full": f"with {_DECIDED}, {_FULL_PICKS}, z2 as (select draw, y, round((n_prior_human + 1) / (n_prior + 2), 6) as p, -n_prior as q from z), ra as {_RANK.format('p')}, rb as {_RANK.format('q')}, rr as (select ra.auc - rb.auc as gain from ra join rb using (draw)) select round(avg(gain), 6) as mean, round(quantile_cont(gain, 0.025), 6) as low, round(quantile_cont(gain, 0.975), 6) as high from rr",
    "trace_pick": f"select complaint_id, label, place from (select complaint_id, label, row_number() over (partition by label order by md5('{SEED}:' || complaint_id), complaint_id) as place from complaints where split in ('validation', 'test') and length(narrative) between 400 and 2000) where place <= 3",
    "coverage_cells": f"select cell, count(*) as n from ({_CELLS}) group by 1",
    "coverage_sample": f"with e as ({_CELLS}), f as (select distinct complaint_id from (select *, row_number() over (partition by cell order by cast(complaint_id as bigint)) as k from e) where k <= 3), o as (select complaint_id, row_number() over (order by md5('{SEED}:' || complaint_id), complaint_id) as k from complaints where complaint_id not in (select complaint_id from f)) select complaint_id, split, label from complaints where complaint_id in (select complaint_id from f) or complaint_id in (select complaint_id from o where k <= greatest(0, 500 - (select count(*) from f)))",
    "majority": f"with {_DECIDED} select complaint_id, {_MAJORITY} as c, y from d",
    "score_table": f"with {_DECIDED} select complaint_id, split, y as needed_human, c as c_company_only, {_MAJORITY} as c_majority_class from d",
    "shape_features": "with r as (select complaint_id, length(narrative) as n, len(regexp_extract_all(narrative, 'X{2,}')) as x from complaints) select complaint_id, round(ln(1 + n), 6) as log_chars, round(ln(1 + x), 6) as log_redactions, round(x / greatest(n, 1), 6) as density from r",
    "feature_frame": _FEATURES,
    "onehot_vocab": f"with f as ({_FEATURES}), u as (" + " union all ".join(f"select '{c}' as column_name, {c} as value from f where split = 'train'" for c in INTAKE) + "), g as (select column_name, value, count(*) as n from u group by all), m as (select column_name, case when n >= 5 then value else '(rare)' end as value, sum(n) as n from g group by all) select column_name, value, cast(n as bigint) as n, row_number() over (partition by column_name order by n desc, value) - 1 as code from m",
}
_FULL_SAMPLE = _SAMPLE.replace(f"least(n, {PER_CLASS})", f"least(n, {FULL_PER_CLASS})").replace(f"k <= {PER_CLASS}", f"k <= {FULL_PER_CLASS}")
SAMPLED = {f.__name__: f for f in (stratified_sample, eval_join, base_rate, eval_summary, scores_semi, resume_anti, transcript_replay)}
QUERIES |= {f"{name}_full": partial(f, per_class=FULL_PER_CLASS) for name, f in SAMPLED.items()} | {"coverage_sample_full": partial(coverage_sample, target=FULL_COVERAGE)}
ORACLES |= {f"{name}_full": ORACLES[name].replace(_SAMPLE, _FULL_SAMPLE) for name in SAMPLED if name in ORACLES}
ORACLES["coverage_sample_full"] = ORACLES["coverage_sample"].replace("greatest(0, 500 -", f"greatest(0, {FULL_COVERAGE} -")
