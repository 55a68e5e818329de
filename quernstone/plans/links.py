"""Links from cases to what they belong to, as edges; links that lead to the outcome are refused to whoever decides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.functions.expressions import category_id, company_key
from quernstone.plans.ingest import cases


class HiddenLink(PermissionError):
    """A link that must not be followed before the decision."""


def _category() -> list:
    return [F.col(c) for c in ("canonical_product", "sub_product", "issue", "sub_issue")]


def _contains(rows: DataFrame, every: DataFrame) -> DataFrame:
    of = every.select("canonical_product", category_id(*_category()).alias("target")).distinct()
    return rows.select("complaint_id", "canonical_product").join(of, "canonical_product").select("complaint_id", "target")


#: link -> edges (complaint_id, target) of some cases, given all cases.
LINKS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "filed_against": lambda rows, every: rows.select("complaint_id", company_key(F.col("company")).alias("target")),
    "categorized_as": lambda rows, every: rows.select("complaint_id", category_id(*_category()).alias("target")),
    "contains": _contains,
    "resolved_as": lambda rows, every: rows.select("complaint_id", F.col("company_response").alias("target")),
}
#: Links shown unless they are named here: a new link is seen by default, one that leads to the outcome must be listed.
HIDDEN = frozenset({"resolved_as"})


def visible(company_shown: bool = True) -> list[str]:
    """Links that may be followed, by name."""
    return sorted({*LINKS} - HIDDEN - (set() if company_shown else {"filed_against"}))


def follow(rows: DataFrame, every: DataFrame, link: str, company_shown: bool = True) -> DataFrame:
    """Edges (complaint_id, target) of ``rows`` by one link; ``contains`` leads to all categories of the case's product.

    A hidden link raises HiddenLink, another name ValueError: similar cases come from retrieval, not from a link. Null keys give
    edges with null ends. Empty tables give no edges.
    """
    if link not in LINKS:
        raise ValueError(f"{link!r} does not start at a case; there are {sorted(LINKS)}")
    if link not in visible(company_shown):
        raise HiddenLink(f"{link!r} may not be followed before the decision; may be: {visible(company_shown)}")
    return LINKS[link](rows, every)


def answer(rows: DataFrame, every: DataFrame, link: str, company_shown: bool = True, most: int = 1000) -> dict:
    """What following a link gives, as a result that can be read: ``ok`` and targets in order, or not ``ok`` and what was wrong.

    For single cases: more than ``most`` targets are an error of the caller's and no answer. Errors of the engine are raised.
    """
    try:
        edges = follow(rows, every, link, company_shown)
    except (HiddenLink, ValueError) as e:
        return {"ok": False, "error": str(e)}
    found = edges.select("target").distinct().orderBy("target").limit(most + 1).collect()
    if len(found) > most:
        return {"ok": False, "error": f"more than {most} targets"}
    return {"ok": True, "link": link, "targets": [r["target"] for r in found]}


def case_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge from a case to its respondent and category, by visible links."""
    every = cases(spark, sf_dir)
    one, two = (follow(every, every, link).withColumn("link", F.lit(link)) for link in ("filed_against", "categorized_as"))
    return one.unionByName(two).select("complaint_id", "link", "target")


def product_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many categories the product of each case contains."""
    every = cases(spark, sf_dir)
    wide = every.select("canonical_product").distinct().withColumn("complaint_id", F.col("canonical_product"))
    per = follow(wide, every, "contains").groupBy("complaint_id").agg(F.count("*").alias("n_categories"))
    return every.select("complaint_id", "canonical_product").join(per.withColumnRenamed("complaint_id", "canonical_product"), "canonical_product").select("complaint_id", "n_categories")


_CATEGORY = "concat_ws(' | ', canonical_product, coalesce(nullif(sub_product, ''), '-'), coalesce(nullif(issue, ''), '-'), coalesce(nullif(sub_issue, ''), '-'))"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"case_links": case_links, "product_links": product_links}
ORACLES = {
    "case_links": f"select complaint_id, 'filed_against' as link, regexp_replace(upper(company), '[^A-Z0-9]+', '', 'g') as target from complaints union all select complaint_id, 'categorized_as', {_CATEGORY} from complaints",
    "product_links": f"select complaint_id, n_categories from complaints join (select canonical_product, count(distinct {_CATEGORY}) as n_categories from complaints group by 1) using (canonical_product)",
}
