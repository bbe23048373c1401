from datetime import datetime

import pytest
from pyspark.sql import functions as F

from voxlake.operators.filters import Corpus, DateMode, Filters, apply_filters
from voxlake.plans import dashboard, insights

D = datetime


@pytest.fixture(scope="module")
def corpus(spark):
    docs = [
        # id, source, title, body, url, published, subreddit, community, rating
        (1, 1, "t1", "b1", "https://u/1", D(2024, 3, 1, 10), "galaxy", None, None),
        (2, 1, "t2", "b2", " ", D(2024, 3, 2, 23, 59), "galaxy", None, None),
        (3, 2, "t3", "b3", None, D(2024, 3, 2), None, "app.one", 4),
        (4, 3, "t4", "b4", "https://u/4", None, None, "site.com", None),
        (5, 2, "t5", "x" * 400, "https://u/5", D(2024, 3, 3), None, "app.two", 5),
    ]
    documents = spark.createDataFrame(
        [(*d[:6], D(2024, 3, 4), *d[6:]) for d in docs],
        "id long, source_id long, title string, body string, url string, published_at timestamp, "
        "created_at timestamp, subreddit string, community_or_channel string, rating long")
    sources = spark.createDataFrame(
        [(1, "reddit", "reddit"), (2, "google_play", "google_play"), (3, "web_reviews", "web_reviews")],
        "id long, platform string, name string")
    tags = spark.createDataFrame(
        [(1, "product", "pixel"), (1, "issue", "battery"), (2, "product", "pixel"), (3, "feature", "dark mode"), (5, "feature", "dark mode")],
        "document_id long, tag_type string, tag_value string")
    enrichments = spark.createDataFrame(
        [(1, "negative", "bug", False, None, '{"sentiment_label":"negative"}'), (2, "mixed", "performance", True, "sum", "{}"),
         (3, "positive", None, True, None, '{"sentiment":{"label":"positive"}}'), (4, None, "sync", None, None, "{}"),
         (1, "neutral", "ux", False, None, "{}")],
        "document_id long, sentiment_label string, primary_issue_category string, feature_request_flag boolean, summary string, metadata_json string")
    return Corpus(documents, sources, tags, enrichments)


def ids(df, name="id"):
    return sorted(r[name] for r in df.select(name).collect())


@pytest.mark.parametrize("raw,mode,expected", [
    ({}, DateMode.STRICT_INSTANT, [1, 2, 3, 4, 5]),
    ({"source": "", "rating": 0, "product_tags": [], "date_from": None}, DateMode.STRICT_INSTANT, [1, 2, 3, 4, 5]),
    ({"sources": [" reddit ", ""], "source": "web_reviews"}, DateMode.STRICT_INSTANT, [1, 2]),
    ({"source": "web_reviews"}, DateMode.STRICT_INSTANT, [4]),
    ({"subreddit": "galaxy"}, DateMode.STRICT_INSTANT, [1, 2]),
    ({"web_domain": "site.com"}, DateMode.STRICT_INSTANT, [4]),
    ({"google_play_app": "app.two"}, DateMode.STRICT_INSTANT, [5]),
    ({"rating": "4"}, DateMode.STRICT_INSTANT, [3]),
    # A bare end date is its midnight; undated documents drop out or count by creation.
    ({"date_from": "2024-03-02", "date_to": "2024-03-02"}, DateMode.STRICT_INSTANT, [3]),
    ({"date_from": "2024-03-02", "date_to": "2024-03-04"}, DateMode.STRICT_INSTANT, [2, 3, 5]),
    ({"date_from": "2024-03-02", "date_to": "2024-03-04"}, DateMode.COALESCED_INSTANT, [2, 3, 4, 5]),
    ({"date_from": "2024-03-02", "date_to": "2024-03-02"}, DateMode.COALESCED_DAY, [2, 3]),
    ({"product_tags": ["pixel", "other"], "issue_tags": ["battery"]}, DateMode.STRICT_INSTANT, [1]),
    ({"feature_tags": ["dark mode"]}, DateMode.STRICT_INSTANT, [3, 5]),
    ({"sentiment_label": "positive"}, DateMode.STRICT_INSTANT, [3]),
    ({"date_from": "no date"}, DateMode.STRICT_INSTANT, []),
])
def test_filters(corpus, raw, mode, expected):
    assert ids(apply_filters(corpus, Filters.of(raw), mode)) == expected


def test_month_partitions_are_pruned(corpus):
    months = corpus.documents.withColumn("event_month", F.date_format(F.coalesce("published_at", "created_at"), "yyyy-MM"))
    pruned = Corpus(months, corpus.sources, corpus.tags, corpus.enrichments)
    chosen = Filters.of({"date_from": "2024-03-02", "date_to": "2024-03-04"})
    for mode in DateMode:
        assert ids(apply_filters(pruned, chosen, mode)) == ids(apply_filters(corpus, chosen, mode))


def test_sentiment_insight(corpus):
    parts = insights.sentiment_insight(corpus)
    t = parts["totals"].first()
    # A document with two enrichments counts twice; a missing label counts in the total only.
    assert (t.total_docs, t.positive_count, t.neutral_count, t.negative_count, t.mixed_count) == (5, 1, 1, 1, 1)
    trend = parts["daily_sentiment_trend"].collect()
    assert [str(r.day) for r in trend] == ["2024-03-04", "2024-03-02", "2024-03-01"]
    assert parts["summary"].first().summary == (
        "Sentiment insight: 5 documents analyzed; negative=1, positive=1, neutral=1, mixed=1.")
    assert [r.doc_id for r in parts["evidence"].collect()] == [2, 1]


def test_trend_keeps_fourteen_active_days(spark):
    rows = spark.createDataFrame([(D(2024, 1, 1 + 2 * i), "mixed") for i in range(15)], "published_at timestamp, sentiment_label string")
    days = [str(r.day) for r in insights.sentiment_trend(rows.withColumn("created_at", F.col("published_at"))).collect()]
    assert len(days) == 14 and days[0] == "2024-01-29" and days[-1] == "2024-01-03"


def test_complaints_and_features(corpus):
    parts = insights.complaints_insight(corpus)
    assert parts["totals"].first().complaint_docs == 5
    assert [(r.category, r["count"]) for r in parts["top_issue_categories"].collect()] == [
        ("bug", 1), ("other", 1), ("performance", 1), ("sync", 1), ("ux", 1)]
    features = insights.feature_requests_insight(corpus)
    assert features["totals"].first().feature_request_docs == 2
    assert [(r.feature, r["count"]) for r in features["top_requested_features"].collect()] == [("dark mode", 1)]
    assert "'dark mode'" in features["summary"].first().summary
    none = insights.feature_requests_insight(corpus, Filters.of({"source": "web_reviews"}))
    assert none["summary"].first().summary.endswith("0 feature request documents, top requested feature 'none'.")


def test_evidence_columns(corpus):
    rows = {r.doc_id: r for r in insights.evidence(insights.enriched(corpus), corpus, 10).collect()}
    assert rows[3].evidence_url == "#document-3" and rows[2].evidence_url == "#document-2"
    assert rows[2].snippet == "sum" and rows[1].snippet == "b1" and rows[4].source == "web_reviews"


def test_long_trend_fills_missing_labels(spark):
    old = spark.createDataFrame([("2024-01-02", 3, 1), ("2024-01-01", 2, 0)], "day string, negative long, positive_count long")
    got = [(r.day, r.sentiment, r["count"]) for r in insights.long_sentiment_trend(old).collect()]
    assert got[:4] == [("2024-01-01", "mixed", 0), ("2024-01-01", "negative", 2), ("2024-01-01", "neutral", 0), ("2024-01-01", "positive", 0)]
    assert len(got) == 8


def test_dashboard(corpus):
    k = dashboard.kpis(corpus).first()
    assert (k.total_docs, k.subreddits, k.negative_docs, k.feature_requests) == (6, 1, 1, 2)
    assert [(str(r.day), r.docs) for r in dashboard.volume_by_day(corpus).collect()] == [
        ("2024-03-01", 1), ("2024-03-02", 2), ("2024-03-03", 1), ("2024-03-04", 1)]
    assert {(r.sentiment, r["count"]) for r in dashboard.sentiment_split(corpus).collect()} == {
        ("unknown", 2), ("negative", 1), ("mixed", 1), ("positive", 1), ("neutral", 1)}
    bounds = dashboard.date_bounds(corpus.documents).first()
    assert (str(bounds.min_date), str(bounds.max_date)) == ("2024-03-01", "2024-03-04")


def test_ranked_complaints(corpus):
    ranked = dashboard.ranked_complaints(corpus)
    assert [(r.id, r.severity_rank) for r in ranked.collect()] == [(1, 3), (2, 2), (4, 1), (1, 1), (3, 0)]
    assert ids(dashboard.ranked_complaints(corpus, Filters.of({"issue_category": "other"}))) == [3]
    assert ids(dashboard.ranked_complaints(corpus, Filters.of({"issue_category": "All"}))) == [1, 1, 2, 3, 4]
    assert ids(dashboard.visible_complaints(ranked, "bug")) == [1]
    assert [r.issue_category for r in dashboard.visible_categories(ranked).collect()] == ["bug", "other", "performance", "sync", "ux"]


def test_facets(corpus):
    got = {}
    for r in dashboard.facets(corpus).collect():
        got.setdefault(r.kind, []).append(r.value)
    assert got == {
        "source": ["google_play", "reddit", "web_reviews"], "subreddit": ["galaxy"], "web_domain": ["site.com"],
        "google_play_app": ["app.one", "app.two"], "rating": ["4", "5"], "product": ["pixel"], "issue": ["battery"], "feature": ["dark mode"]}


def test_texts_stay_out_of_the_joins(corpus, spark, tmp_path):
    corpus.documents.write.parquet(str(tmp_path / "docs"))
    stored = Corpus(spark.read.parquet(str(tmp_path / "docs")), corpus.sources, corpus.tags, corpus.enrichments)
    for report in (dashboard.ranked_complaints(stored), insights.evidence(insights.enriched(stored), stored)):
        plan = report._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "ReadSchema" in line]
        # The join reads keys; texts come in by the broadcast of the finished report.
        assert sorted("body" in line for line in scans) == [False, True] and "BroadcastHashJoin" in plan
