"""Column functions: typing with guards, evidence in texts, keys and fingerprints. All stay inside the JVM.

A guard sits in the value itself or in a filter. A separate column that raises would be pruned when nobody selects it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from quernstone.functions.vocabulary import LABELS, OUT_OF_RANGE, PRODUCT_LABELS, SPLITS, SUB_PRODUCTS

# Patterns of redactions, amounts and dates.
REDACTION = r"X{2,}"
AMOUNT = r"\$\s?(\d[\d,]*(?:\.\d{2})?)\b"
REDACTED_AMOUNT = r"\{?\$\s?X{2,}"
DATE = r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2})\b"
REDACTED_DATE = r"\bXX/XX/(?:XXXX|\d{4})\b"
#: Digits, white space and word borders count for all scripts unless a caller needs to agree with an engine that knows ASCII only.
UNICODE = "(?U)"

_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ].*)?$"


def mapped(c: Column, table: dict[str, str], otherwise: Column | None = None) -> Column:
    """Look a value up in a fixed table; null, or ``otherwise``, where it isn't found."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    got = F.try_element_at(pairs, c)
    return got if otherwise is None else F.coalesce(got, otherwise)


def failing(message: str, c: Column) -> Column:
    """Raises with the offending value. For use as a value."""
    return F.raise_error(F.concat(F.lit(f"{message}: "), F.coalesce(c.cast("string"), F.lit("null")))).cast("string")


def present(c: Column) -> Column:
    """Empty strings become null."""
    return F.nullif(c, F.lit(""))


def iso_date(c: Column) -> Column:
    """The day as written in the timestamp's own offset; null if it isn't an ISO date. No session time zone plays a part."""
    return F.when(c.rlike(_ISO), F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))


def yes_no(c: Column) -> Column:
    return F.when(c == "Yes", True).when(c == "No", False)


def split_for(day: Column) -> Column:
    """Split of a day; out_of_range outside all windows, null for null."""
    chosen = reduce(lambda acc, s: acc.when(day.between(F.lit(s[1]).cast("date"), F.lit(s[2]).cast("date")), s[0]), SPLITS, F.when(day.isNull(), None))
    return chosen.otherwise(OUT_OF_RANGE)


def label_for(response: Column, strict: bool = True) -> Column:
    """Label of an outcome. An unknown outcome raises, or is null if not ``strict``; it never counts as negative."""
    return mapped(response, LABELS, failing("unknown outcome", response) if strict else None)


_PRODUCT_OF_SUB = {sub: product for product, subs in SUB_PRODUCTS.items() for sub in subs}
_LABELS_OF = {product: "|".join(labels) for product, labels in PRODUCT_LABELS.items()}
_ONLY_PRODUCT = {
    label: products[0]
    for label in sorted({x for labels in PRODUCT_LABELS.values() for x in labels})
    if len(products := [p for p, labels in PRODUCT_LABELS.items() if label in labels]) == 1
}


def _filed_under(label: Column, product: Column) -> Column:
    return F.array_contains(F.split(mapped(product, _LABELS_OF), r"\|"), label)


def canonical_product(label: Column, sub_product: Column, strict: bool = True) -> Column:
    """A known sub-product decides and must be filed under its label; otherwise a label with one product does. Else raises, or null."""
    by_sub = mapped(sub_product, _PRODUCT_OF_SUB)
    agreed = F.when(by_sub.isNotNull(), F.when(_filed_under(label, by_sub), by_sub)).otherwise(mapped(label, _ONLY_PRODUCT))
    return F.coalesce(agreed, failing("unresolved product", F.concat_ws(" / ", label, sub_product))) if strict else agreed


def unrecognised(label: Column, sub_product: Column) -> Column:
    """True for a sub-product that isn't known, or is filed under another label; false for null."""
    by_sub = mapped(sub_product, _PRODUCT_OF_SUB)
    return sub_product.isNotNull() & (by_sub.isNull() | ~F.coalesce(_filed_under(label, by_sub), F.lit(False)))


def company_key(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "")


def category_id(*parts: Column) -> Column:
    return F.concat_ws(" | ", *[F.coalesce(present(p), F.lit("-")) for p in parts])


def fingerprint(text: Column, unicode: bool = True) -> Column:
    """Equal for copies that differ in case, white space and how redactions were split only."""
    flat = F.regexp_replace(F.upper(text), (UNICODE if unicode else "") + r"\s+", " ")
    flat = F.regexp_replace(flat, "^ | $", "")
    return F.md5(reduce(lambda c, run: F.replace(c, F.lit(run), F.lit("X")), ["XXXX", "XXX", "XX"], flat))


def amounts(text: Column, unicode: bool = True) -> Column:
    """Dollar amounts in order of appearance."""
    found = F.regexp_extract_all(text, F.lit((UNICODE if unicode else "") + AMOUNT), 1)
    return F.filter(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")), lambda x: x.isNotNull())


def evidence(text: Column, unicode: bool = True) -> dict[str, Column]:
    """What a text still says of amounts and dates."""
    u = UNICODE if unicode else ""
    amount, no_amount = text.rlike(u + AMOUNT), text.rlike(u + REDACTED_AMOUNT)
    day, no_day = text.rlike(u + DATE), text.rlike(u + REDACTED_DATE)
    return {
        "has_amount": amount, "has_redacted_amount": no_amount, "has_date": day, "has_redacted_date": no_day,
        "mentions_amount": amount | no_amount, "mentions_date": day | no_day,
    }


def redactions(text: Column) -> Column:
    return F.regexp_count(text, F.lit(REDACTION)).cast("long")


def zip_shape(c: Column) -> Column:
    """How a zip code was left."""
    # The names of the shapes.
    return F.when(c.rlike("^[0-9]{5}$"), "full 5-digit").when(c.rlike("^[0-9]{3}XX$"), "truncated (123XX)").when(c.rlike("^[0-9]+$"), "numeric, not 5 digits").otherwise("other")


def own_words(company: Column, generic: list[str]) -> Column:
    """Words of a firm's name that tell it from others."""
    words = F.array_distinct(F.split(F.lower(company), "[^a-z0-9]+"))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(generic))


def clamp(c: Column) -> Column:
    """Into [0, 1]; NaN stays NaN."""
    return F.when(F.isnan(c), c).otherwise(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
