"""Text clean-up expressions."""

from __future__ import annotations

import unicodedata

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from voxlake import constants as K

# Unicode white space plus the four ASCII separators that Java's class leaves out.
_SPACE = r"[\s\x1c-\x1f]"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Trim white space of every kind, not only blanks."""
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def clean_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?U){_SPACE}+", " "))


def is_deleted(c: Column) -> Column:
    """Empty, or nothing but one of the marks of removed content."""
    marks = "|".join("\\Q" + t + "\\E" for t in K.DELETED_TEXTS)
    return F.coalesce(c, F.lit("")).rlike(rf"(?iU)\A{_SPACE}*(?:{marks})?{_SPACE}*\z")


def tagging_text(c: Column) -> Column:
    """Lower-case single-spaced text; the empty text where the content was deleted."""
    return F.when(is_deleted(c), F.lit("")).otherwise(F.lower(clean_whitespace(c)))


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """True where any word is a substring; false for an empty word list."""
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words), F.lit(False))


def keyword_hits(c: Column, words: Sequence[str]) -> Column:
    """How many of the words occur as substrings, ignoring case."""
    text = F.lower(F.coalesce(c, F.lit("")))
    return reduce(
        lambda a, b: a + b, (F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0)
    )


def normalize_keywords(words: Sequence[str] | None) -> list[str]:
    """Job parameters: trimmed, lower-cased, blanks dropped."""
    return [w.strip().lower() for w in (words or []) if w and w.strip()]


def keyword_array(c: Column) -> Column:
    """The same clean-up for an array column."""
    return F.filter(F.transform(c, lambda x: F.lower(F.trim(x))), lambda x: x != "")


def prepared_text(title: Column, body: Column) -> Column:
    """Non-empty trimmed title and body, joined by a blank line."""
    return F.concat_ws("\n\n", blank_to_null(strip(title)), blank_to_null(strip(body)))


def drop_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", " ")


@F.pandas_udf(T.StringType())
def unescape_entities(texts: pd.Series) -> pd.Series:
    """All named and numeric HTML entities; used for feed texts only."""
    import html

    return texts.map(lambda t: html.unescape(t) if isinstance(t, str) and "&" in t else t)


def feed_text(c: Column) -> Column:
    """Feed markup to plain text."""
    return clean_whitespace(unescape_entities(drop_tags(F.coalesce(c, F.lit("")))))


def accents() -> tuple[str, str]:
    """Latin letters with marks and the letters without; marks that stand alone, at the end, have no counterpart."""
    latin = map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)))
    bare = {c: unicodedata.normalize("NFD", c)[0] for c in latin if c == c.lower() and len(unicodedata.normalize("NFD", c)) > 1}
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(bare) + marks, "".join(bare.values())


ACCENTED, UNACCENTED = accents()


def folded(c: Column) -> Column:
    """Case and accents folded; the empty text for NULL."""
    lowered = F.lower(F.coalesce(c, F.lit("")))
    # Plain ASCII texts need no accent table.
    return F.when(
        F.octet_length(lowered) > F.length(lowered), F.translate(lowered, ACCENTED, UNACCENTED)
    ).otherwise(lowered)


def words_of(c: Column) -> Column:
    """Runs of letters and digits of a folded text."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def tokens(c: Column) -> Column:
    """Search tokens: case and accents folded, runs of letters and digits."""
    return words_of(folded(c))


def fold(text: str) -> list[str]:
    """Token list of a query text, by the same rule as `tokens`."""
    import re

    folded = text.lower().translate(
        str.maketrans(ACCENTED[:len(UNACCENTED)], UNACCENTED, ACCENTED[len(UNACCENTED):]))
    return re.findall(r"[^\W_]+", folded)
