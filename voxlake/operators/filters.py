"""One filter set for search, insights and dashboard.

Metadata filters become predicates on typed columns, which reach the Parquet scan; filters on other
tables become semi joins, so that no document is repeated. No join is forced to broadcast: the
optimizer does that below its size threshold, and larger sides shuffle on the document id.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from enum import Enum
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from voxlake import constants as K
from voxlake.functions.dates import event_day, event_time, iso_timestamp, utc_text, utc_wall
from voxlake.functions.text import blank_to_null


class DateMode(Enum):
    """How a date range is read."""

    STRICT_INSTANT = "strict_instant"        # publication instant; undated documents drop out
    COALESCED_INSTANT = "coalesced_instant"  # event instant; a bare end date means its midnight
    COALESCED_DAY = "coalesced_day"          # whole event days, both ends included


@dataclass(frozen=True)
class Filters:
    """Empty values (None, "", 0, empty list) mean "no filter"."""

    sources: tuple[str, ...] = ()
    subreddit: str | None = None
    web_domain: str | None = None
    google_play_app: str | None = None
    rating: int | None = None
    date_from: str | None = None
    date_to: str | None = None
    tags: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    sentiment_label: str | None = None
    issue_category: str | None = None

    @classmethod
    def of(cls, raw: Mapping[str, Any] | None) -> Filters:
        """From the plain mapping a caller keeps; a source list wins over a single source."""
        raw = raw or {}
        names = tuple(str(s).strip() for s in (raw.get("sources") or []) if str(s).strip())
        if not names and raw.get("source"):
            names = (raw["source"],)
        category = raw.get("issue_category")
        return cls(
            sources=names,
            subreddit=raw.get("subreddit") or None,
            web_domain=raw.get("web_domain") or None,
            google_play_app=raw.get("google_play_app") or None,
            rating=int(raw["rating"]) if raw.get("rating") else None,
            date_from=raw.get("date_from") or None,
            date_to=raw.get("date_to") or None,
            tags={t: tuple(raw[f"{t}_tags"]) for t in K.TAG_TYPES if raw.get(f"{t}_tags")},
            sentiment_label=raw.get("sentiment_label") or None,
            issue_category=category if category and category != "All" else None,
        )

    def without(self, *names: str) -> Filters:
        """The same filters with some of them switched off."""
        blank = Filters()
        return replace(self, **{n: getattr(blank, n) for n in names})


@dataclass(frozen=True)
class Corpus:
    """The stored tables that queries read."""

    documents: DataFrame
    sources: DataFrame
    tags: DataFrame | None = None
    enrichments: DataFrame | None = None


def date_predicates(filters: Filters, mode: DateMode) -> list[Column]:
    if mode is DateMode.COALESCED_DAY:
        value = event_day()
        def bound(text: str) -> Column:
            return utc_wall(iso_timestamp(F.lit(text))).cast("date")
    else:
        value = F.col("published_at") if mode is DateMode.STRICT_INSTANT else event_time()
        def bound(text: str) -> Column:
            return iso_timestamp(F.lit(text))
    out = []
    if filters.date_from:
        out.append(value >= bound(filters.date_from))
    if filters.date_to:
        out.append(value <= bound(filters.date_to))
    return out


def layout_predicates(filters: Filters, mode: DateMode, columns: Sequence[str]) -> list[Column]:
    """What a stored layout knows of the range, in a form that reaches the files: whole months are left out of the scan,
    and of a month those row groups whose event times lie outside. Rows that were stored without an event time stay in;
    `date_predicates` decides in any case.
    """
    def instant(text: str) -> Column:
        return iso_timestamp(F.lit(text))

    def day_start(text: str, days: int) -> Column:
        day = F.date_add(utc_wall(instant(text)).cast("date"), days)
        return F.try_to_timestamp(F.concat(day.cast("string"), F.lit("T00:00:00Z")))

    whole_days = mode is DateMode.COALESCED_DAY
    out = []
    for text, later in ((filters.date_from, True), (filters.date_to, False)):
        if not text:
            continue
        if "event_month" in columns:
            month = utc_text(instant(text)).substr(1, 7)
            out.append(F.col("event_month") >= month if later else F.col("event_month") <= month)
        if "event_micros" in columns:
            known = F.col("event_micros")
            if later:
                inside = known >= F.unix_micros(day_start(text, 0) if whole_days else instant(text))
            elif whole_days:
                inside = known < F.unix_micros(day_start(text, 1))
            else:
                inside = known <= F.unix_micros(instant(text))
            out.append(known.isNull() | inside)
    return out


def apply_column_filters(documents: DataFrame, filters: Filters, mode: DateMode) -> DataFrame:
    """Filters on the documents table alone."""
    predicates = date_predicates(filters, mode) + layout_predicates(filters, mode, documents.columns)
    for column, wanted in (
        ("subreddit", filters.subreddit),
        ("community_or_channel", filters.web_domain),
        ("community_or_channel", filters.google_play_app),
        ("rating", filters.rating),
    ):
        if wanted:
            predicates.append(F.col(column) == F.lit(wanted))
    for predicate in predicates:
        documents = documents.where(predicate)
    return documents


def with_sources(documents: DataFrame, sources: DataFrame, names: tuple[str, ...]) -> DataFrame:
    wanted = sources.where(F.col("name").isin(*names)).select(F.col("id").alias("source_id"))
    return documents.join(wanted, "source_id", "left_semi")


def with_tags(documents: DataFrame, tags: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """Documents with one of the values of every type, by one pass over the tags."""
    hits = [(F.col("tag_type") == t) & F.col("tag_value").isin(*values) for t, values in wanted.items()]
    flags = [F.max(hit).alias(f"_t{i}") for i, hit in enumerate(hits)]
    found = (
        tags.where(reduce(lambda a, b: a | b, hits)).groupBy(F.col("document_id").alias("id")).agg(*flags)
        .where(reduce(lambda a, b: a & b, (F.col(f"_t{i}") for i in range(len(hits)))))
        .select("id")
    )
    return documents.join(found, "id", "left_semi")


def with_sentiment(documents: DataFrame, enrichments: DataFrame, label: str) -> DataFrame:
    """Label at either of its two places in the enrichment payload."""
    nested = F.get_json_object("metadata_json", "$.sentiment.label")
    wanted = enrichments.where((F.col("sentiment_label") == label) | (nested == label)).select(
        F.col("document_id").alias("id")
    )
    return documents.join(wanted, "id", "left_semi")


def apply_semi_joins(documents: DataFrame, corpus: Corpus, filters: Filters) -> DataFrame:
    """Filters on other tables. Large texts are best left out of `documents` here."""
    if filters.sources:
        documents = with_sources(documents, corpus.sources, filters.sources)
    if filters.tags:
        documents = with_tags(documents, corpus.tags, dict(filters.tags))
    if filters.sentiment_label:
        documents = with_sentiment(documents, corpus.enrichments, filters.sentiment_label)
    return documents


def apply_filters(corpus: Corpus, filters: Filters, mode: DateMode) -> DataFrame:
    return apply_semi_joins(apply_column_filters(corpus.documents, filters, mode), corpus, filters)


def issue_category() -> Column:
    return F.coalesce(F.col("primary_issue_category"), F.lit("other"))


def link_or_anchor(url: Column, doc_id: Column) -> Column:
    """The document's own link, or an anchor where it has none."""
    return F.coalesce(
        blank_to_null(F.trim(url)), F.concat(F.lit("#document-"), doc_id.cast("string"))
    )


def within(c: Column, start: Column, end: Column, *, keep_undated: bool) -> Column:
    """Closed window; undated rows pass or fail as told."""
    return F.coalesce(c.between(start, end), F.lit(keep_undated))
