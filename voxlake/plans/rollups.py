"""Reports from daily aggregates, which inserts and enrichments keep up to date.

See `operators/rollup.py` for the rows. A report reads days times groups, never documents. It is right for filters that
whole days decide: dates without a time, and no tags.

An enrichment report reads a bare end date as its midnight, so rows tell whether their time is a midnight.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from voxlake import constants as K
from voxlake.operators.filters import DateMode, Filters
from voxlake.operators.rollup import DOCUMENT, ENRICHED, FEATURE
from voxlake.plans.insights import _latest_days, complaints_summary, features_summary, sentiment_summary

# Filters ---------------------------------------------------------------------------------------
def answers(filters: Filters) -> bool:
    """Whether whole days and the rollup's columns decide the filters."""
    bare = all(d is None or len(d.strip()) == 10 for d in (filters.date_from, filters.date_to))
    return bare and not filters.tags


def _chosen(rollup: DataFrame, sources: DataFrame, filters: Filters, mode: DateMode) -> DataFrame:
    if not answers(filters):
        raise ValueError("these filters need the documents themselves")
    wanted = []
    if filters.date_from:
        wanted.append(F.col("day") >= F.lit(filters.date_from).cast("date"))
    if filters.date_to:
        last = F.lit(filters.date_to).cast("date")
        within = (F.col("day") <= last) if mode is DateMode.COALESCED_DAY else (F.col("day") < last) | (
            (F.col("day") == last) & F.col("at_midnight"))
        wanted.append(within)
    for column, value in (("subreddit", filters.subreddit), ("community_or_channel", filters.web_domain),
                          ("community_or_channel", filters.google_play_app), ("rating", filters.rating),
                          ("sentiment_label", filters.sentiment_label)):
        if value:
            wanted.append(F.col(column) == F.lit(value))
    rows = rollup.where(reduce(lambda a, b: a & b, wanted, F.lit(True)))
    if filters.sources:
        ids = sources.where(F.col("name").isin(*filters.sources)).select(F.col("id").alias("source_id"))
        rows = rows.join(ids, "source_id", "left_semi")
    return rows


# Reports ---------------------------------------------------------------------------------------
def _sum(where: Column | None = None) -> Column:
    return F.coalesce(F.sum(F.col("n") if where is None else F.when(where, F.col("n"))), F.lit(0)).cast("long")


def _labels() -> list[Column]:
    return [_sum(F.col("sentiment_label") == name).alias(f"{name}_count") for name in K.SENTIMENT_LABELS]


def daily_metrics(rollup: DataFrame, sources: DataFrame, filters: Filters | None = None) -> DataFrame:
    """All counts of the three insights, one row per active day."""
    rows = _chosen(rollup.where(F.col("kind") == ENRICHED), sources, filters or Filters(), DateMode.COALESCED_INSTANT)
    return rows.groupBy("day").agg(_sum().alias("docs"), *_labels(), _sum(F.col("feature_request")).alias("feature_requests"))


def sentiment_insight(rollup: DataFrame, sources: DataFrame, filters: Filters | None = None) -> dict[str, DataFrame]:
    rows = _chosen(rollup.where(F.col("kind") == ENRICHED), sources, filters or Filters(), DateMode.COALESCED_INSTANT)
    totals = rows.agg(_sum().alias("total_docs"), *_labels())
    return {"summary": sentiment_summary(totals), "totals": totals,
            "daily_sentiment_trend": _latest_days(rows.groupBy("day").agg(*_labels()), K.TREND_DAYS)}


def complaints_insight(rollup: DataFrame, sources: DataFrame, filters: Filters | None = None) -> dict[str, DataFrame]:
    rows = _chosen(rollup.where(F.col("kind") == ENRICHED), sources, filters or Filters(), DateMode.COALESCED_INSTANT)
    categories = rows.groupBy("category").agg(_sum().alias("count"))
    return {"summary": complaints_summary(categories), "totals": rows.agg(_sum().alias("complaint_docs")),
            "top_issue_categories": categories.orderBy(F.desc("count"), "category").limit(K.TOP_CATEGORIES),
            "daily_complaint_trend": _latest_days(rows.groupBy("day").agg(_sum().alias("complaint_count")), K.TREND_DAYS)}


def feature_requests_insight(rollup: DataFrame, sources: DataFrame, filters: Filters | None = None) -> dict[str, DataFrame]:
    rows = _chosen(rollup, sources, filters or Filters(), DateMode.COALESCED_INSTANT)
    asked = rows.where((F.col("kind") == ENRICHED) & F.col("feature_request"))
    named = rows.where(F.col("kind") == FEATURE)
    counts = asked.select(F.lit(None).cast("string").alias("feature"), "n").unionByName(named.select("feature", "n")).groupBy(
        "feature").agg(_sum().alias("count"))
    return {"summary": features_summary(counts), "totals": asked.agg(_sum().alias("feature_request_docs")),
            "top_requested_features": counts.where("feature IS NOT NULL").orderBy(F.desc("count"), "feature").limit(K.TOP_FEATURES),
            "daily_feature_request_trend": _latest_days(
                asked.groupBy("day").agg(_sum().alias("feature_request_count")), K.TREND_DAYS)}


def kpis(rollup: DataFrame, sources: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Dashboard figures, for stores with one enrichment for each document at most."""
    own = filters or Filters()
    kinds = rollup.where(F.col("kind").isin(DOCUMENT, ENRICHED))
    rows = _chosen(kinds if not own.sentiment_label else kinds.where(F.col("kind") == ENRICHED), sources, own, DateMode.COALESCED_DAY)
    counted = F.col("kind") == (ENRICHED if own.sentiment_label else DOCUMENT)
    return rows.agg(
        _sum(counted).alias("total_docs"), F.count_distinct(F.when(counted, F.col("subreddit"))).alias("subreddits"),
        _sum(F.col("sentiment_label") == "negative").alias("negative_docs"), _sum(F.col("feature_request")
            & (F.col("kind") == ENRICHED)).alias("feature_requests"))


def volume_by_day(rollup: DataFrame, sources: DataFrame, filters: Filters | None = None) -> DataFrame:
    own = filters or Filters()
    kind = ENRICHED if own.sentiment_label else DOCUMENT
    rows = _chosen(rollup.where(F.col("kind") == kind), sources, own, DateMode.COALESCED_DAY)
    return rows.groupBy("day").agg(_sum().alias("docs")).orderBy("day")
