"""Label rules and coercions of the enrichment step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from voxlake import constants as K
from voxlake.functions.text import contains_any, strip


def _one_of(c: Column, allowed: Sequence[str], default: str) -> Column:
    label = F.lower(strip(c))
    return F.when(label.isin(*allowed), label).otherwise(default)


def sentiment_label(c: Column) -> Column:
    return _one_of(c, K.SENTIMENT_LABELS, "neutral")


def issue_category(c: Column) -> Column:
    return _one_of(c, K.ISSUE_CATEGORIES, "other")


def star_rating(c: Column) -> Column:
    """Number or numeric text, fraction cut; NULL outside 1..5."""
    value = c.try_cast("double")
    return F.when((value >= 1) & (value < 6), F.floor(value))


def competitor_list(c: Column, most: int | None = None) -> Column:
    """Trimmed names, blanks dropped, first spelling wins; `most` keeps so many."""
    names = F.filter(F.transform(c, lambda x: strip(x)), lambda x: x != "")
    lowered = F.transform(names, lambda x: F.lower(x))
    first = F.filter(names, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)
    out = F.coalesce(first, F.array().cast("array<string>"))
    return out if most is None else F.slice(out, 1, most)


def rule_sentiment(text: Column, rating: Column) -> Column:
    """Rating first, then negative words, then positive words."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(rating <= 2, "negative")
        .when(rating >= 4, "positive")
        .when(contains_any(lowered, K.NEGATIVE_WORDS), "negative")
        .when(contains_any(lowered, K.POSITIVE_WORDS), "positive")
        .otherwise("neutral")
    )


def severity(label: Column) -> Column:
    """Complaint rank of a sentiment label."""
    chain = F
    for name, rank in K.SEVERITY.items():
        chain = chain.when(label == name, rank)
    return chain.otherwise(1)


def json_flag(json: Column, path: str) -> Column:
    """JSON boolean written as true or 1."""
    return F.coalesce(F.get_json_object(json, path).isin("true", "1"), F.lit(False))
