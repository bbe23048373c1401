"""Sentiment, complaint and feature-request insights.

Each report is a small aggregate or a top-k over documents joined to their enrichments on the
document id. Groups are aggregated before the shuffle, so a hot day or category costs one row per
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxlake import constants as K
from voxlake.functions.dates import event_day, event_time
from voxlake.operators.filters import (
    Corpus, DateMode, Filters, apply_filters, issue_category, link_or_anchor,
)
from voxlake.operators.ranking import add_columns, narrow, page

_LABEL = "sentiment_label"


def _label_counts() -> list[Column]:
    return [F.count_if(F.col(_LABEL) == name).alias(f"{name}_count") for name in K.SENTIMENT_LABELS]


def enriched(corpus: Corpus, filters: Filters | None = None,
             mode: DateMode = DateMode.COALESCED_INSTANT) -> DataFrame:
    """Filtered documents with each of their enrichments."""
    docs = apply_filters(corpus, filters or Filters(), mode)
    found = corpus.enrichments.withColumnRenamed("document_id", "id")
    shared = [c for c in found.columns if c in docs.columns and c != "id"]
    return docs.join(found.drop(*shared), "id")


def feature_requests(corpus: Corpus, filters: Filters | None = None) -> DataFrame:
    return enriched(corpus, filters).where(F.coalesce("feature_request_flag", F.lit(False)))


# Metrics -------------------------------------------------------------------------------------
def sentiment_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total_docs"), *_label_counts())


def _per_day(rows: DataFrame, *aggregates: Column) -> DataFrame:
    return rows.groupBy(event_day().alias("day")).agg(*aggregates)


def _latest_days(daily: DataFrame, days: int) -> DataFrame:
    return daily.orderBy(F.desc_nulls_last("day")).limit(days)


def sentiment_trend(rows: DataFrame, days: int = K.TREND_DAYS) -> DataFrame:
    """Label counts of the latest active days."""
    return _latest_days(_per_day(rows, *_label_counts()), days)


def count_trend(rows: DataFrame, name: str, days: int = K.TREND_DAYS) -> DataFrame:
    """Row counts of the latest active days."""
    return _latest_days(_per_day(rows, F.count("*").alias(name)), days)


def category_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(issue_category().alias("category")).agg(F.count("*").alias("count"))


def top_categories(rows: DataFrame, n: int = K.TOP_CATEGORIES) -> DataFrame:
    return category_counts(rows).orderBy(F.desc("count"), "category").limit(n)


def feature_counts(corpus: Corpus, filters: Filters | None = None) -> DataFrame:
    """Requests of each feature, and under NULL the number of all requests, in one pass."""
    tags = corpus.tags.where(F.col("tag_type") == "feature").groupBy(F.col("document_id").alias("id")).agg(
        F.collect_list("tag_value").alias("_features"))
    none = F.array().cast("array<string>")
    each = F.concat(F.array(F.lit(None).cast("string")), F.coalesce("_features", none))
    return (
        feature_requests(corpus, filters)
        .join(tags, "id", "left")
        .select(F.explode(each).alias("feature"))
        .groupBy("feature")
        .agg(F.count("*").alias("count"))
    )


def top_features(corpus: Corpus, filters: Filters | None = None, n: int = K.TOP_FEATURES) -> DataFrame:
    return feature_counts(corpus, filters).where("feature IS NOT NULL").orderBy(F.desc("count"), "feature").limit(n)


def long_sentiment_trend(trend: DataFrame) -> DataFrame:
    """One row per day and label; label columns an older report lacks count as zero."""
    columns = [f"{name}_count" for name in K.SENTIMENT_LABELS]
    for name in K.SENTIMENT_LABELS:
        if f"{name}_count" not in trend.columns:
            old = F.col(name) if name in trend.columns else F.lit(0).cast("long")
            trend = trend.withColumn(f"{name}_count", old)
    return (
        trend.unpivot("day", columns, "sentiment", "count")
        .withColumn("sentiment", F.regexp_replace("sentiment", "_count$", ""))
        .orderBy("day", "sentiment")
    )


def daily_metrics(rows: DataFrame) -> DataFrame:
    """All counts of the three insights in one pass; one row per active day."""
    return _per_day(
        rows,
        F.count("*").alias("docs"),
        *_label_counts(),
        F.count_if(F.coalesce("feature_request_flag", F.lit(False))).alias("feature_requests"),
    )


# Evidence ------------------------------------------------------------------------------------
def evidence(rows: DataFrame, corpus: Corpus, limit: int = K.EVIDENCE_ROWS) -> DataFrame:
    """The latest rows behind a report."""
    names = corpus.sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    order = [F.desc_nulls_last("date"), F.desc("id")]
    dated = rows.withColumn("date", event_time()).select(*narrow(rows, "id", "source_id", "date", "summary"))
    top = page(dated.join(names, "source_id"), order, max(1, limit)).drop("source_id")
    return add_columns(top, corpus.documents, ["title", "url", "body"]).orderBy(*order).select(
        F.col("id").alias("doc_id"),
        "title",
        "url",
        F.substring(F.coalesce("summary", "body", F.lit("")), 1, K.EVIDENCE_CHARS).alias("snippet"),
        "date",
        "source",
        link_or_anchor(F.col("url"), F.col("id")).alias("evidence_url"),
    )


def unhappy(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(_LABEL).isin("negative", "mixed"))


# Summaries -----------------------------------------------------------------------------------
def _most_frequent(name: str) -> Column:
    """The value of the highest count, the first by name among equals; `none` without any."""
    ranked = F.when(F.col(name).isNotNull(), F.struct((-F.col("count")).alias("n"), F.col(name).alias("value")))
    return F.coalesce(F.min(ranked)["value"], F.lit("none"))


def sentiment_summary(totals: DataFrame) -> DataFrame:
    return totals.select(
        F.lit("sentiment").alias("module"),
        F.format_string(
            "Sentiment insight: %d documents analyzed; negative=%d, positive=%d, neutral=%d, mixed=%d.",
            "total_docs", "negative_count", "positive_count", "neutral_count", "mixed_count",
        ).alias("summary"),
    )


def complaints_summary(categories: DataFrame) -> DataFrame:
    """From the counts of all categories."""
    return categories.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("docs"), _most_frequent("category").alias("top")).select(
        F.lit("complaints").alias("module"),
        F.format_string(
            "Complaints insight: %d complaint-like documents, with top issue category '%s'.",
            F.col("docs"), F.col("top"),
        ).alias("summary"),
    )


def features_summary(features: DataFrame) -> DataFrame:
    """From `feature_counts`."""
    return features.agg(
        F.coalesce(F.max(F.when(F.col("feature").isNull(), F.col("count"))), F.lit(0)).alias("docs"),
        _most_frequent("feature").alias("top")).select(
        F.lit("feature_requests").alias("module"),
        F.format_string(
            "Feature request insight: %d feature request documents, top requested feature '%s'.",
            F.col("docs"), F.col("top"),
        ).alias("summary"),
    )


def total(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.count("*").alias(name))


# Whole reports -------------------------------------------------------------------------------
def sentiment_insight(corpus: Corpus, filters: Filters | None = None) -> dict[str, DataFrame]:
    rows = enriched(corpus, filters)
    totals = sentiment_totals(rows)
    return {
        "summary": sentiment_summary(totals),
        "totals": totals,
        "daily_sentiment_trend": sentiment_trend(rows),
        "evidence": evidence(unhappy(rows), corpus),
    }


def complaints_insight(corpus: Corpus, filters: Filters | None = None) -> dict[str, DataFrame]:
    """Counts every enriched document, whatever its label."""
    rows = enriched(corpus, filters)
    return {
        "summary": complaints_summary(category_counts(rows)),
        "totals": total(rows, "complaint_docs"),
        "top_issue_categories": top_categories(rows),
        "daily_complaint_trend": count_trend(rows, "complaint_count"),
        "evidence": evidence(rows, corpus),
    }


def feature_requests_insight(corpus: Corpus, filters: Filters | None = None) -> dict[str, DataFrame]:
    rows = feature_requests(corpus, filters)
    return {
        "summary": features_summary(feature_counts(corpus, filters)),
        "totals": total(rows, "feature_request_docs"),
        "top_requested_features": top_features(corpus, filters),
        "daily_feature_request_trend": count_trend(rows, "feature_request_count"),
        "evidence": evidence(rows, corpus),
    }


INSIGHTS = {
    "sentiment": sentiment_insight,
    "complaints": complaints_insight,
    "feature_requests": feature_requests_insight,
}
