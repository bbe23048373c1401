"""Dashboard figures, ranked complaints and the values offered as filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from voxlake import constants as K
from voxlake.functions.dates import event_day, event_time
from voxlake.functions.labels import severity
from voxlake.operators.filters import Corpus, DateMode, Filters, apply_filters, issue_category
from voxlake.operators.ranking import add_columns, narrow, page
from voxlake.plans.insights import enriched

_DAY = DateMode.COALESCED_DAY


def with_enrichments(corpus: Corpus, filters: Filters | None = None) -> DataFrame:
    """Filtered documents, each with its enrichments where it has any."""
    docs = apply_filters(corpus, filters or Filters(), _DAY)
    found = corpus.enrichments.select(
        F.col("document_id").alias("id"), "sentiment_label", "feature_request_flag"
    )
    return docs.join(found, "id", "left")


def kpis(corpus: Corpus, filters: Filters | None = None) -> DataFrame:
    return with_enrichments(corpus, filters).agg(
        F.count("*").alias("total_docs"),
        F.count_distinct("subreddit").alias("subreddits"),
        F.count_if(F.col("sentiment_label") == "negative").alias("negative_docs"),
        F.count_if(F.coalesce("feature_request_flag", F.lit(False))).alias("feature_requests"),
    )


def volume_by_day(corpus: Corpus, filters: Filters | None = None) -> DataFrame:
    docs = apply_filters(corpus, filters or Filters(), _DAY)
    return docs.groupBy(event_day().alias("day")).agg(F.count("*").alias("docs")).orderBy("day")


def sentiment_split(corpus: Corpus, filters: Filters | None = None) -> DataFrame:
    return (
        with_enrichments(corpus, filters)
        .groupBy(F.coalesce("sentiment_label", F.lit("unknown")).alias("sentiment"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "sentiment")
    )


def ranked_complaints(corpus: Corpus, filters: Filters | None = None, n: int = K.RANKED_COMPLAINTS) -> DataFrame:
    """The gravest documents, latest first among equals."""
    filters = filters or Filters()
    rows = enriched(corpus, filters, _DAY)
    ranked = rows.withColumns(
        {
            "published_at": event_time(),
            "issue_category": issue_category(),
            "sentiment_label": F.coalesce("sentiment_label", F.lit("neutral")),
        }
    ).select(*narrow(rows, "id", "published_at", "issue_category", "sentiment_label"))
    if filters.issue_category:
        ranked = ranked.where(F.col("issue_category") == filters.issue_category)
    order = [F.desc("severity_rank"), F.desc_nulls_last("published_at"), F.desc("id")]
    top = page(ranked.withColumn("severity_rank", severity(F.col("sentiment_label"))), order, n)
    return add_columns(top, corpus.documents, ["title", "body", "url"]).orderBy(*order).select(
        "id", "published_at", "title", "body", "url", "issue_category", "sentiment_label", "severity_rank"
    )


def visible_complaints(ranked: DataFrame, category: str | None) -> DataFrame:
    """Category choice on the list as shown, after its limit."""
    if not category or category == "All":
        return ranked
    return ranked.where(F.col("issue_category") == category)


def visible_categories(ranked: DataFrame) -> DataFrame:
    return ranked.select("issue_category").distinct().orderBy("issue_category")


def date_bounds(documents: DataFrame) -> DataFrame:
    return documents.agg(F.min(event_day()).alias("min_date"), F.max(event_day()).alias("max_date"))


def facets(corpus: Corpus) -> DataFrame:
    """Distinct values per filter, one row each: (kind, value).

    One scan of the documents serves all their kinds, and values are made distinct before the
    shuffle.
    """
    sources = corpus.sources
    docs = corpus.documents.select("source_id", "subreddit", "community_or_channel", "rating").join(
        sources.select(F.col("id").alias("source_id"), F.col("name").alias("_name"), F.col("platform").alias("_platform")),
        "source_id", "left",
    )
    in_store = F.col("_platform") == K.GOOGLE_PLAY
    community = F.col("community_or_channel")
    values = {
        "subreddit": F.col("subreddit"),
        "web_domain": F.when(F.col("_name") == K.WEB_REVIEWS, community),
        "google_play_app": F.when(in_store, community),
        "rating": F.when(in_store & F.col("rating").between(1, 5), F.col("rating").cast("string")),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in values.items()])
    parts = [
        sources.select(F.lit("source").alias("kind"), F.coalesce("name", "platform").alias("value")),
        docs.select(F.inline(pairs)),
    ]
    if corpus.tags is not None:
        parts.append(corpus.tags.select(F.col("tag_type").alias("kind"), F.col("tag_value").alias("value")))
    return (
        reduce(DataFrame.unionByName, parts)
        .where(F.coalesce(F.col("value"), F.lit("")) != "")
        .distinct()
        .orderBy("kind", "value")
    )
