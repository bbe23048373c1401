"""Dedupe keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from voxlake import constants as K
from voxlake.functions.text import blank_to_null, clean_whitespace, strip
from voxlake.functions.urls import canonical_url


def _part(c: Column | None) -> Column:
    return F.lit("") if c is None else F.coalesce(c, F.lit(""))


def fallback_key(source: Column, external_id: Column, *, app_id: Column | None, author: Column | None,
                 created_at: Column | None, text: Column, text_chars: int | None = None) -> Column:
    """Content key for rows without an external id; NULL for all others.

    `text_chars` is for stores whose keys were made of that many characters; by default all count.
    """
    name = F.lower(strip(F.coalesce(blank_to_null(source), F.lit("unknown"))))
    payload = F.concat_ws(
        "|",
        name,
        F.lower(strip(_part(app_id))),
        F.lower(strip(_part(author))),
        strip(_part(created_at)),
        F.lower(clean_whitespace(text)) if text_chars is None else F.substring(F.lower(clean_whitespace(text)), 1, text_chars),
    )
    return F.when(
        blank_to_null(external_id).isNull(), F.concat(name, F.lit(":fallback:"), F.sha2(payload, 256))
    )


def web_key(url: Column, title: Column, content: Column) -> Column:
    """Key of an article: its canonical address and its text."""
    text = F.concat_ws(
        " ",
        blank_to_null(F.lower(strip(_part(title)))),
        blank_to_null(F.lower(strip(_part(content)))),
    )
    payload = F.concat_ws("|", F.lit(K.WEB_REVIEWS), _part(canonical_url(url)), F.sha2(text, 256))
    return F.concat(F.lit(f"{K.WEB_REVIEWS}:canonical:"), F.sha2(payload, 256))
