"""From raw records to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quernstone.functions.expressions import canonical_product, iso_date, label_for, present, split_for, yes_no

#: Columns of a typed row, in order of storage.
TYPED = [
    "complaint_id", "date_received", "date_sent_to_company", "product_label", "sub_product", "issue", "sub_issue", "narrative", "company", "state", "zip_code", "tags", "submitted_via",
    "company_response", "timely", "company_public_response", "canonical_product", "split", "label",
]


def _fields() -> list[tuple[str, Column, str | None]]:
    """(typed name, value, what is wrong when the value is null); a value that may be null has no complaint."""
    c = F.col
    blank = F.regexp_replace(c("complaint_what_happened"), r"(?U)^\s+|\s+$", "")
    return [
        ("complaint_id", present(F.regexp_replace(c("complaint_id"), r"(?U)^\s+|\s+$", "")), "no id"),
        ("narrative", F.when(blank != "", c("complaint_what_happened")), "no narrative"),
        ("product_label", present(c("product")), "no product"),
        ("sub_product", present(c("sub_product")), None),
        ("company_response", present(c("company_response")), "no outcome"),
        ("timely", yes_no(c("timely")), "timely is neither Yes nor No"),
        ("date_received", iso_date(c("date_received")), "no day received"),
        ("label", label_for(c("company_response"), strict=False), "unknown outcome"),
        ("date_sent_to_company", iso_date(c("date_sent_to_company")), "no day sent"),
        ("issue", present(c("issue")), "no issue"),
        ("sub_issue", present(c("sub_issue")), None),
        ("company", present(c("company")), "no company"),
        ("state", present(c("state")), None),
        ("zip_code", present(c("zip_code")), "no zip code"),
        ("tags", present(c("tags")), None),
        ("submitted_via", present(c("submitted_via")), "no channel"),
        ("company_public_response", present(c("company_public_response")), None),
        ("canonical_product", canonical_product(c("product"), present(c("sub_product")), strict=False), "unresolved product"),
        ("split", split_for(iso_date(c("date_received"))), None),
    ]


def typed(raw: DataFrame) -> DataFrame:
    """Typed columns beside ``problem``: the first thing wrong with the record, null if it can be typed. Other columns stay.

    Raw columns that have a typed namesake are replaced. An empty table gives no rows.
    """
    fields = _fields()
    problem = F.coalesce(*[F.when(v.isNull(), F.lit(why)) for _, v, why in fields if why])
    names = [n for n, _, _ in fields]
    kept = [c for c in raw.columns if c not in {*names, "problem", "product", "complaint_what_happened", "has_narrative"}]
    return raw.select(*kept, *[v.alias(n) for n, v, _ in fields], problem.alias("problem"))


def typed_or_fail(raw: DataFrame) -> DataFrame:
    """Typed rows; the first record that can't be typed ends the job with its id. The guard is a filter, so nothing prunes it."""
    rows = typed(raw)
    message = F.concat(F.lit("complaint "), F.coalesce(F.col("complaint_id"), F.lit("<unknown>")), F.lit(": "), F.col("problem"))
    return rows.where(F.when(F.col("problem").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).select(TYPED)


def typed_and_rejected(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be typed, and those that can't with their problem."""
    rows = typed(raw)
    return rows.where("problem is null").select(TYPED), rows.where("problem is not null")


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """``df`` itself; raises when a key occurs twice. Counted before anything is returned."""
    twice = df.groupBy(key).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"{key} isn't unique: {[r[key] for r in twice]}")
    return df
