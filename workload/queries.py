"""The registered queries: each runs library operators over whole driver tables.

Results hold plain types only (times and days as text, lists joined), so that they can be compared
with SQL results value by value.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from voxlake import constants as K
from voxlake.functions import dates, keys, labels, text, urls
from voxlake.operators import dedupe, enrich, fulltext, ingest, normalize, pages, rollup, runs, topk
from voxlake.operators.filters import Corpus, DateMode, Filters, apply_filters
from voxlake.operators.ranking import keep_first
from voxlake.operators.store import rejected_path
from voxlake.operators.tagging import tag_documents
from voxlake.plans import answers, dashboard, explore, insights, jobs, rollups, snapshots
from voxlake.session import apply_runtime_conf, shared_dir
from voxlake.sources import landing
from voxlake.sources.tables import Store
from voxlake.streaming.landing import ingest_new_files
from workload import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PERIOD = {"date_from": "2024-01-10", "date_to": "2024-02-20"}
NOW = "2024-02-25"


def portable(df: DataFrame) -> DataFrame:
    """Times and days as text, small integers as long, lists joined."""
    def shape(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        return c.alias(f.name)

    return df.select(*[shape(f) for f in df.schema.fields])


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return portable(fn(apply_runtime_conf(spark), sf))

    QUERIES[fn.__name__] = run
    return fn


def period() -> Filters:
    return Filters.of(PERIOD)


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return insights.enriched(views.corpus(spark, sf), period())


# Insights ------------------------------------------------------------------------------------
@query
def sentiment_totals(spark, sf):
    return insights.sentiment_totals(enriched(spark, sf))


@query
def sentiment_daily_trend(spark, sf):
    return insights.sentiment_trend(enriched(spark, sf))


@query
def sentiment_trend_long(spark, sf):
    return insights.long_sentiment_trend(insights.sentiment_trend(enriched(spark, sf)))


@query
def complaint_total(spark, sf):
    return insights.total(enriched(spark, sf), "complaint_docs")


@query
def complaint_categories(spark, sf):
    return insights.top_categories(enriched(spark, sf))


@query
def complaint_daily_trend(spark, sf):
    return insights.count_trend(enriched(spark, sf), "complaint_count")


@query
def feature_total(spark, sf):
    return insights.total(insights.feature_requests(views.corpus(spark, sf), period()), "feature_request_docs")


@query
def top_features(spark, sf):
    return insights.top_features(views.corpus(spark, sf, with_tags=True), period())


@query
def feature_daily_trend(spark, sf):
    rows = insights.feature_requests(views.corpus(spark, sf), period())
    return insights.count_trend(rows, "feature_request_count")


@query
def daily_metrics(spark, sf):
    return insights.daily_metrics(enriched(spark, sf))


@query
def evidence_negative(spark, sf):
    corpus = views.corpus(spark, sf)
    return insights.evidence(insights.unhappy(insights.enriched(corpus, period())), corpus)


@query
def evidence_features(spark, sf):
    corpus = views.corpus(spark, sf)
    return insights.evidence(insights.feature_requests(corpus, period()), corpus, 20)


@query
def insight_summaries(spark, sf):
    parts = [report(views.corpus(spark, sf, with_tags=True), period())["summary"] for report in insights.INSIGHTS.values()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Dashboard -----------------------------------------------------------------------------------
@query
def dashboard_kpis(spark, sf):
    return dashboard.kpis(views.corpus(spark, sf), period())


@query
def volume_by_day(spark, sf):
    return dashboard.volume_by_day(views.corpus(spark, sf))


@query
def sentiment_split(spark, sf):
    return dashboard.sentiment_split(views.corpus(spark, sf), period())


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("id", "published_at", "title", "url", "issue_category", "sentiment_label", "severity_rank",
                       F.sha2("body", 256).alias("body_hash"))


@query
def ranked_complaints(spark, sf):
    return _shown(dashboard.ranked_complaints(views.corpus(spark, sf), period()))


@query
def ranked_complaints_by_category(spark, sf):
    chosen = Filters.of({**PERIOD, "issue_category": "other"})
    return _shown(dashboard.ranked_complaints(views.corpus(spark, sf), chosen))


@query
def ranked_complaints_then_category(spark, sf):
    ranked = dashboard.ranked_complaints(views.corpus(spark, sf), period())
    return _shown(dashboard.visible_complaints(ranked, "bug"))


@query
def complaint_category_choices(spark, sf):
    return dashboard.visible_categories(dashboard.ranked_complaints(views.corpus(spark, sf), period()))


@query
def date_bounds(spark, sf):
    return dashboard.date_bounds(views.documents(spark, sf))


@query
def facets(spark, sf):
    return dashboard.facets(views.corpus(spark, sf, with_tags=True))


# Filters -------------------------------------------------------------------------------------
def _filtered(spark, sf, raw: dict, mode: DateMode = DateMode.STRICT_INSTANT) -> DataFrame:
    rows = apply_filters(views.corpus(spark, sf, with_tags=True), Filters.of(raw), mode)
    return rows.select("id", "source_id", "title", "url", "published_at")


@query
def filter_sources(spark, sf):
    return _filtered(spark, sf, {"sources": [" reddit", "google_play", ""], "source": "web_reviews"})


@query
def filter_community(spark, sf):
    return _filtered(spark, sf, {"subreddit": "fr"})


@query
def filter_domain(spark, sf):
    return _filtered(spark, sf, {"source": "web_reviews", "web_domain": "src3"})


@query
def filter_app(spark, sf):
    return _filtered(spark, sf, {"source": "google_play", "google_play_app": "src8"})


@query
def filter_rating(spark, sf):
    return _filtered(spark, sf, {"rating": 4})


@query
def filter_tags(spark, sf):
    return _filtered(spark, sf, {"product_tags": ["this", "with"], "feature_tags": ["tion"], "issue_tags": ["from"]})


@query
def filter_sentiment(spark, sf):
    return _filtered(spark, sf, {"sentiment_label": "mixed"})


@query
def date_strict_instant(spark, sf):
    return _filtered(spark, sf, PERIOD)


@query
def date_coalesced_instant(spark, sf):
    return _filtered(spark, sf, {"date_from": "2024-02-20", "date_to": "2024-03-15"}, DateMode.COALESCED_INSTANT)


@query
def date_coalesced_day(spark, sf):
    return _filtered(spark, sf, PERIOD, DateMode.COALESCED_DAY)


@query
def dates_from_store(spark, sf):
    """Whole days and instants, asked of a written store, where they reach the files."""
    store = Store(spark, _scratch(spark))
    store.append("documents", views.documents(spark, sf))
    corpus = Corpus(store.read("documents"), views.sources(spark))
    found = [
        apply_filters(corpus, Filters.of(raw), mode).select("id", "title", "published_at", F.lit(mode.value).alias("mode"))
        for raw, mode in ((PERIOD, DateMode.COALESCED_DAY), (PERIOD, DateMode.STRICT_INSTANT),
                          ({"date_from": "2024-02-20", "date_to": "2024-03-15"}, DateMode.COALESCED_INSTANT))
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query
def enrichment_promotion(spark, sf):
    return enrich.promote(views.enrichments(spark, sf)).drop("competitor_mentions", "rating")


# Search --------------------------------------------------------------------------------------
def _hits(rows: DataFrame) -> DataFrame:
    return rows.select(
        "id", "source_id", "title", "url", "published_at", F.round("fts_score", 6).alias("fts_score")
    )


def _search(spark, sf, match: fulltext.Match, *, filters: dict | None = None, limit: int = 200, offset: int = 0):
    docs = views.documents(spark, sf)
    corpus = Corpus(docs, views.sources(spark), None, views.enrichments(spark, sf))
    return _hits(explore.search_documents(corpus, match, filters, limit=limit, offset=offset))


@query
def browse_page(spark, sf):
    corpus = views.corpus(spark, sf)
    return explore.search_documents(corpus, "  ", {"sources": ["reddit"]}, limit=50, offset=20).select(
        "id", "source_id", "title", "url", "published_at"
    )


@query
def browse_after(spark, sf):
    """The same rows as browse_page shows, behind the last of the twenty before them."""
    corpus, chosen = views.corpus(spark, sf), {"sources": ["reddit"]}
    seen = explore.search_documents(corpus, "", chosen, limit=20).collect()
    place = fulltext.place_of(seen[-1]) if seen else None
    return explore.search_documents(corpus, "", chosen, limit=50, after=place).select("id", "source_id", "title", "url", "published_at")


@query
def search_after_last(spark, sf):
    """The third page of a ranked search, by the last rows of the two before it."""
    corpus, match, place = views.corpus(spark, sf), fulltext.match_any("anble inble"), None
    for _ in range(2):
        seen = explore.search_documents(corpus, match, limit=25, after=place).collect()
        place = fulltext.place_of(seen[-1]) if seen else place
    return _hits(explore.search_documents(corpus, match, limit=25, after=place))


@query
def insights_from_rollup(spark, sf):
    """Daily figures from daily counts alone, which were written source by source and merged."""
    path, corpus = f"{_scratch(spark)}/rollup", views.corpus(spark, sf, with_tags=True)
    for i in (1, 2, 3):
        docs = corpus.documents.where(F.col("source_id") == i)
        rows = rollup.of_documents(docs).unionByName(rollup.of_enrichments(docs, corpus.enrichments, corpus.tags))
        name = fulltext.new_part()
        fulltext.commit_parts(spark, path, [rollup.stage_rollup(rows, path, name)])
    rollup.merge_rollups(spark, path, fan=3)
    return rollups.daily_metrics(rollup.read_rollup(spark, path), corpus.sources, period())


@query
def features_from_rollup(spark, sf):
    path, corpus = f"{_scratch(spark)}/rollup", views.corpus(spark, sf, with_tags=True)
    rows = rollup.of_enrichments(corpus.documents, corpus.enrichments, corpus.tags)
    fulltext.commit_parts(spark, path, [rollup.stage_rollup(rows, path, fulltext.new_part())])
    counts = rollup.read_rollup(spark, path)
    return rollups.feature_requests_insight(counts, corpus.sources, period())["top_requested_features"]


@query
def fetch_by_ids(spark, sf):
    wanted = views.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("id"), (F.col("turn") * 1000000 - F.col("conv_id")).alias("position")
    )
    return explore.documents_by_positions(views.documents(spark, sf), wanted).select("id", "title", "url", "position")


@query
def search_all(spark, sf):
    return _search(spark, sf, fulltext.match_all("Ànble inblé"))


@query
def search_any(spark, sf):
    return _search(spark, sf, fulltext.match_any("anble inble reble"))


@query
def search_not(spark, sf):
    return _search(spark, sf, fulltext.match_all("anble") & fulltext.match_none("inble"))


@query
def search_prefix(spark, sf):
    return _search(spark, sf, fulltext.match_prefix("anb"))


@query
def search_phrase(spark, sf):
    return _search(spark, sf, fulltext.match_phrase("the and"))


@query
def search_column(spark, sf):
    return _search(spark, sf, fulltext.match_all("anble", "title"))


@query
def search_filtered_page(spark, sf):
    return _search(
        spark, sf, fulltext.match_any("anble inble"), limit=30, offset=10,
        filters={**PERIOD, "sources": ["reddit", "web_reviews"]},
    )


@query
def search_indexed(spark, sf):
    docs = views.documents(spark, sf)
    match = fulltext.match_any("anble reble") & fulltext.match_none("inble")
    found = explore.search_documents(
        Corpus(docs, views.sources(spark)), match, limit=200, index=fulltext.build_index(docs)
    )
    return _hits(found)


def _written(spark, sf, match, parts):
    """A search over an index that is written part by part and read back."""
    docs, path = views.documents(spark, sf), f"{_scratch(spark)}/index"
    for i, part in enumerate(parts(docs)):
        fulltext.write_index(fulltext.build_index(part), path, append=i > 0)
    index = fulltext.read_index(spark, path)
    return _hits(explore.search_documents(Corpus(docs, views.sources(spark)), match, limit=200, index=index))


@query
def search_written_index(spark, sf):
    match = fulltext.match_any("anble reble") & fulltext.match_none("inble")
    return _written(spark, sf, match, lambda docs: [docs])


@query
def search_written_prefix(spark, sf):
    return _written(spark, sf, fulltext.match_prefix("anb"), lambda docs: [docs])


@query
def search_after_insert(spark, sf):
    """The documents of each source come as an insert of their own."""
    return _written(spark, sf, fulltext.match_phrase("the and"), lambda docs: [docs.where(F.col("source_id") == i) for i in (1, 2, 3)])


@query
def search_after_merge(spark, sf):
    """Seven inserts, merged three by three: the same scores as by an index of one part."""
    docs, path = views.documents(spark, sf), f"{_scratch(spark)}/index"
    for i in range(7):
        fulltext.write_index(fulltext.build_index(docs.where(F.col("id") % 7 == i)), path, append=True)
        fulltext.merge_index(spark, path, fan=3)
    match = fulltext.match_any("anble reble") & fulltext.match_none("inble")
    index = fulltext.read_index(spark, path)
    return _hits(explore.search_documents(Corpus(docs, views.sources(spark)), match, limit=200, index=index))


@query
def search_top_k(spark, sf):
    """The first page, from the tiers of postings that can reach it."""
    docs, path = views.documents(spark, sf), f"{_scratch(spark)}/index"
    fulltext.write_index(fulltext.build_index(docs), path)
    topk.add_impacts(spark, path)
    match = fulltext.match_any("anble reble") & fulltext.match_none("inble")
    return _hits(explore.search_documents(Corpus(docs, views.sources(spark)), match, limit=20, tiers_path=path))


@query
def search_top_filtered(spark, sf):
    """A filtered later page; the last of three inserts has no tiers yet."""
    docs, path = views.documents(spark, sf), f"{_scratch(spark)}/index"
    for i in range(3):
        if i == 2:
            topk.add_impacts(spark, path)
        fulltext.write_index(fulltext.build_index(docs.where(F.col("source_id") == i + 1)), path, append=True)
    return _hits(explore.search_documents(
        Corpus(docs, views.sources(spark)), fulltext.match_any("anble inble"), {**PERIOD, "sources": ["reddit", "web_reviews"]},
        limit=30, offset=10, tiers_path=path))


@query
def index_terms(spark, sf):
    """Documents and occurrences per term of the index."""
    index = fulltext.build_index(views.documents(spark, sf))
    return index.postings.groupBy("term").agg(
        F.count_distinct("doc_id").alias("n_docs"), F.sum("tf").alias("occurrences"),
        F.min(F.col("positions")[0]).alias("first_position"),
    )


# Answers -------------------------------------------------------------------------------------
@query
def answer_evidence(spark, sf):
    docs = views.documents(spark, sf)
    found = answers.retrieve(Corpus(docs, views.sources(spark)), "anble reble?", top_n=40)
    # One source row is missing, so that its documents are of an unknown source.
    return answers.compact_evidence(found, views.sources(spark).where("name <> 'reddit'"))


@query
def cited_evidence(spark, sf):
    turns = views.table(spark, sf, "conversations")
    none = F.array().cast("array<bigint>")
    records = turns.select(
        "conv_id", "turn",
        F.when(F.col("turn") % 3 == 2, "  ").otherwise(F.col("text")).alias("question"),
        F.when(F.col("role") == "user", "").otherwise(F.concat(F.lit("Answer "), F.col("conv_id").cast("string"))).alias("answer"),
        F.split("text", "\n").alias("key_points"),
        F.array(F.concat(F.lit(" "), "role", F.lit(" ")), F.lit(""), F.lit("  ")).alias("caveats"),
        F.lit(None).cast("array<string>").alias("contradictions"),
        F.when(F.col("turn") > 0, F.sequence(F.lit(1), F.col("turn"))).otherwise(none).alias("evidence_ids"),
        F.array("turn", F.lit(99), F.lit(1), "turn").cast("array<bigint>").alias("cited_evidence_ids"),
    )
    return answers.clean_answers(records).drop("question")


# Tagging -------------------------------------------------------------------------------------
@query
def tag_all(spark, sf):
    return tag_documents(views.documents(spark, sf), views.TAXONOMY)


@query
def tag_overlapping(spark, sf):
    """17,582 aliases in one pass; phrases and their words claim places from each other, longest first."""
    return tag_documents(views.documents(spark, sf), views.large_taxonomy())


@query
def tag_competitors(spark, sf):
    rows = views.table(spark, sf, "conversations")
    turns = rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return tag_documents(turns, views.TAXONOMY, types=["competitor"], text=F.col("text"), confidence=None)


# Enrichment ----------------------------------------------------------------------------------
_MIN_CHARS = 400


def _waiting(spark, sf) -> DataFrame:
    return enrich.candidates(
        views.documents(spark, sf).drop("platform"), views.enrichments(spark, sf), views.sources(spark), limit=None
    )


@query
def enrich_candidates(spark, sf):
    return _waiting(spark, sf).select("id", "title", "platform", "rating")


@query
def enrich_first_batch(spark, sf):
    return enrich.candidates(
        views.documents(spark, sf).drop("platform"), views.enrichments(spark, sf), views.sources(spark), limit=100
    ).select("id", "platform")


@query
def rule_enrichment(spark, sf):
    rows = enrich.prepare(_waiting(spark, sf), min_chars=_MIN_CHARS)
    return enrich.rule_enrichment(rows.where("is_short"))


@query
def scored_by_plugin(spark, sf):
    rows = enrich.prepare(_waiting(spark, sf), min_chars=_MIN_CHARS)
    replies = enrich.score(rows.where("NOT is_short"), enrich.rule_scorer, batch_size=200)
    return replies.select("document_id", *enrich.clean_reply("rules"), "status")


@query
def enrichment_stats(spark, sf):
    rows = enrich.prepare(_waiting(spark, sf), min_chars=_MIN_CHARS)
    replies = enrich.score(rows.where("NOT is_short"), enrich.rule_scorer, batch_size=200)
    short = rows.where("is_short").select(F.lit("short").alias("status"), F.lit(False).alias("failed_batch"))
    return enrich.statistics(short.unionByName(replies.select("status", "failed_batch")))


@query
def classifier_reply_clean(spark, sf):
    i = F.col("doc_id")
    item = F.struct(
        i.alias("document_id"),
        F.element_at(F.array(*map(F.lit, (" Positive", "NEGATIVE", "mixed", "angry", ""))), (i % 5 + 1).cast("int")).alias("sentiment_label"),
        F.element_at(F.array(*map(F.lit, ("Bug ", "ux", "sync", "other"))), (i % 4 + 1).cast("int")).alias("primary_issue_category"),
        (i % 3 == 0).alias("feature_request_flag"),
        F.array(F.lit(" Acme"), F.lit("acme"), F.lit(" "), F.col("lang"), F.col("source"), F.upper("lang")).alias("competitor_mentions"),
        F.concat(F.lit("  "), F.col("text")).alias("summary_snippet"),
    )
    earlier = F.struct(i.alias("document_id"), F.lit("neutral").alias("sentiment_label"))
    reply = F.when(i % 17 == 0, F.lit("no json")).otherwise(
        F.to_json(F.struct(F.array(F.struct(earlier["document_id"].alias("document_id"), earlier["sentiment_label"].alias("sentiment_label"),
                                            *[F.lit(None).cast(t).alias(n) for n, t in (("primary_issue_category", "string"), ("feature_request_flag", "boolean"), ("competitor_mentions", "array<string>"), ("summary_snippet", "string"))]), item).alias("documents")))
    )
    replies = views.table(spark, sf, "documents").select(i.alias("batch_id"), reply.alias("reply"))
    parsed = enrich.last_reply(enrich.parse_replies(replies), "batch_id", "position")
    return parsed.select("document_id", *enrich.clean_reply("model-a"))


# Dedupe and URLs -----------------------------------------------------------------------------
@query
def dedupe_fallback_key(spark, sf):
    docs = views.documents(spark, sf)
    external = F.when(F.col("source_id") == 1, F.col("external_id")).when(F.col("source_id") == 2, "")
    return docs.select(
        "id",
        keys.fallback_key(
            F.col("platform"), external, app_id=F.col("community_or_channel"), author=F.col("author"),
            created_at=dates.iso_text(F.col("published_at")), text=F.col("body"),
        ).alias("dedupe_key"),
    )


@query
def dedupe_first_wins(spark, sf):
    rows = views.table(spark, sf, "documents").select(
        "doc_id", "source", F.when(F.col("lang") != "es", F.sha2("text", 256)).alias("dedupe_key")
    )
    return keep_first(rows, ["dedupe_key"], [F.asc("doc_id")], row_id="doc_id")


@query
def dedupe_against_store(spark, sf):
    """All documents arrive; the labelled ones are stored already."""
    docs = views.documents(spark, sf).select(
        "id", "source_id",
        F.when(F.col("source_id") != 2, F.sha2("title", 256)).alias("external_id"),
        F.when(F.col("source_id") != 1, F.sha2("body", 256)).alias("dedupe_key"),
    )
    stored = docs.join(views.table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return dedupe.new_documents(docs, stored, [F.asc("id")], row_id="id")


def _page_title() -> Column:
    return F.regexp_extract("html", "<title>([^<]*)</title>", 1)


@query
def web_dedupe_key(spark, sf):
    return views.table(spark, sf, "pages").select(
        "page_id", keys.web_key(F.col("url"), _page_title(), F.col("html")).alias("dedupe_key")
    )


@query
def url_forms(spark, sf):
    u = F.col("url")
    return views.table(spark, sf, "pages").select(
        "page_id", urls.normalize_url(u).alias("normalized"), urls.canonical_url(u).alias("canonical"),
        urls.domain(u).alias("domain"), urls.site_homepage(u).alias("homepage"),
        urls.last_part(urls.path(u)).alias("last_part"),
    )


@query
def editorial_pages(spark, sf):
    return views.table(spark, sf, "pages").select(
        "page_id", urls.is_non_editorial(F.col("url"), _page_title()).alias("non_editorial"),
        urls.looks_like_article(F.col("url")).alias("article_shaped"),
    )


@query
def blocked_pages(spark, sf):
    status = F.element_at(F.array(*map(F.lit, (200, 404, 403, 200, 429, 500, 301))), (F.col("page_id") % 7 + 1).cast("int"))
    return views.table(spark, sf, "pages").select("page_id", urls.is_blocked(status, F.col("html")).alias("blocked"))


# Pages ---------------------------------------------------------------------------------------
def _pages(spark, sf) -> DataFrame:
    return views.table(spark, sf, "pages")


def _linked_pages(spark, sf) -> DataFrame:
    """The pages with their menu links one folder down, where article links would be."""
    return _pages(spark, sf).withColumn("html", F.replace("html", F.lit('<a href="/'), F.lit('<a href="/reviews/')))


_WORDS = ("the", "ing", "que")


@query
def extract_articles(spark, sf):
    found = pages.extract_articles(_pages(spark, sf))
    return found.select("page_id", "page_title", "page_author", "page_published",
                        F.sha2("page_content", 256).alias("content_hash"), F.length("page_content").alias("n_chars"))


@query
def articles_normalized(spark, sf):
    docs = normalize.articles(pages.extract_articles(_pages(spark, sf)))
    return docs.select("external_id", "community_or_channel", "doc_type", "title", F.length("content").alias("n_chars"))


@query
def page_links(spark, sf):
    return pages.page_links(_linked_pages(spark, sf), _WORDS)


def _scored(spark, sf) -> DataFrame:
    links = pages.page_links(_linked_pages(spark, sf), _WORDS)
    return pages.score_links(pages.candidate_links(links), _WORDS)


@query
def link_scores(spark, sf):
    return _scored(spark, sf).select("site", "link", "page_id", "position", "anchor", "score")


@query
def link_order(spark, sf):
    return pages.ranked_links(_scored(spark, sf), per_site=12).select("site", "link", "score", "place")


@query
def link_discovery_order(spark, sf):
    return pages.first_links(_scored(spark, sf), per_site=12).select("site", "link", "place")


# Posts, comments, reviews --------------------------------------------------------------------
def _created() -> Column:
    return F.lit(1704067200.0) + F.col("conv_id") * 3600 + F.col("turn")


def _community(conv_id: str = "conv_id") -> Column:
    return F.concat(F.lit("c"), (F.col(conv_id) % 7).cast("string"))


def conversation_posts(spark, sf) -> DataFrame:
    return views.table(spark, sf, "conversations").where("turn = 0").select(
        F.concat(F.lit("p"), F.col("conv_id").cast("string")).alias("id"),
        F.when(F.col("conv_id") % 2 == 0, F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"),
        F.when(F.col("conv_id") % 3 != 0, F.col("text")).alias("selftext"),
        _community().alias("subreddit"), F.col("role").alias("author"), _created().alias("created_utc"),
        F.concat(F.lit("/r/"), _community(), F.lit("/"), F.col("conv_id").cast("string")).alias("permalink"),
        F.when(F.col("conv_id") % 5 == 0, F.lit("https://reddit.com/full")).alias("full_link"),
        F.concat(F.lit("https://reddit.com/p/"), F.col("conv_id").cast("string")).alias("url"),
        F.col("conv_id").alias("arrival"),
    )


def conversation_comments(spark, sf) -> DataFrame:
    return views.table(spark, sf, "conversations").where("turn > 0").select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("text").alias("body"),
        F.concat(F.lit("t3_p"), F.col("conv_id").cast("string")).alias("link_id"),
        _community().alias("subreddit"), F.struct(F.col("role").alias("name")).alias("author"),
        _created().alias("created_utc"),
        F.when(F.col("turn") != 2, F.concat(F.lit("/c/"), F.col("conv_id").cast("string"))).alias("permalink"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("arrival"),
    )


def document_submissions(spark, sf) -> DataFrame:
    """Documents as posts of the community of their source column."""
    return views.documents(spark, sf).select(
        F.col("external_id").alias("id"), "title", F.col("body").alias("selftext"),
        F.col("community_or_channel").alias("subreddit"), "author",
        F.unix_timestamp("published_at").cast("double").alias("created_utc"),
        F.lit(None).cast("string").alias("permalink"), F.col("url").alias("full_link"), "url",
        F.col("id").alias("arrival"),
    )


def document_reviews(spark, sf) -> DataFrame:
    """Documents as app reviews."""
    i = F.col("id")
    return views.documents(spark, sf).select(
        F.col("community_or_channel").alias("app_id"),
        F.when(i % 9 != 0, F.concat(F.lit("r"), F.col("external_id"))).alias("reviewId"),
        F.col("author").alias("userName"), F.lit("other").alias("authorName"),
        F.when(i % 4 != 0, F.col("body")).alias("content"), F.col("title").alias("userContent"),
        F.col("rating").alias("score"), F.when(i % 2 == 0, F.col("published_at")).alias("at"),
        F.unix_timestamp("published_at").cast("string").alias("timestamp"),
        F.lit("1.0").alias("reviewCreatedVersion"), F.lit(None).cast("string").alias("appVersion"),
        F.col("subreddit").alias("device"), F.lit(None).cast("string").alias("osVersion"),
        (i % 50).alias("thumbsUpCount"), F.lit(None).cast("string").alias("replyContent"),
        F.lit(None).cast("timestamp").alias("repliedAt"), i.alias("arrival"),
    )


def _doc_columns(docs: DataFrame, *extra: str) -> DataFrame:
    return docs.select(
        "external_id", "parent_external_id", "doc_type", "community_or_channel", "author", "rating", "title",
        F.sha2("content", 256).alias("content_hash"), "created_at", "url", "dedupe_key", *extra,
    )


@query
def submissions_normalized(spark, sf):
    return _doc_columns(normalize.submissions(conversation_posts(spark, sf)))


@query
def posts_normalized(spark, sf):
    nameless = conversation_posts(spark, sf).withColumn("id", F.lit(None).cast("string"))
    return _doc_columns(normalize.posts(nameless))


@query
def comments_normalized(spark, sf):
    return _doc_columns(normalize.comments(conversation_comments(spark, sf)))


@query
def reviews_normalized(spark, sf):
    docs = normalize.reviews(document_reviews(spark, sf))
    meta = [F.try_element_at("platform_metadata", F.lit(k)).alias(k) for k in ("app_id", "app_version", "device", "thumbs_up_count")]
    return docs.select("*", *meta).transform(lambda d: _doc_columns(d, "app_id", "app_version", "device", "thumbs_up_count"))


@query
def stored_documents(spark, sf):
    docs = normalize.stored_columns(normalize.submissions(conversation_posts(spark, sf)))
    return docs.select(
        "external_id", "subreddit", F.get_json_object("raw_json", "$.platform").alias("platform"),
        F.get_json_object("raw_json", "$.entity_type").alias("entity_type"),
        F.get_json_object("raw_json", "$.platform_metadata.subreddit").alias("meta_subreddit"),
        F.get_json_object("raw_json", "$.rating").alias("rating"),
    )


@query
def post_comments_capped(spark, sf):
    posts = conversation_posts(spark, sf).where(text.contains_any(F.col("permalink"), ["/c1/", "/c2/", "/c3/"]))
    return ingest.comments_of(
        conversation_comments(spark, sf), posts, per_post=3, order=[F.asc("arrival")]
    ).select("id", "parent_id", "created_utc")


@query
def post_docs_union(spark, sf):
    docs = jobs.post_and_comment_documents(
        conversation_posts(spark, sf), conversation_comments(spark, sf), ["the", "que"],
        now=F.lit("2024-01-05").cast("timestamp"), days_back=3, post_limit=40, comment_limit=2,
    )
    return docs.select("external_id", "parent_external_id", "doc_type", "community_or_channel")


@query
def adapter_statistics(spark, sf):
    posts, comments = conversation_posts(spark, sf), conversation_comments(spark, sf)
    now, order = F.lit("2024-01-05").cast("timestamp"), [F.asc("arrival")]
    matched = ingest.matched_posts(posts, ["the", "que"], now=now, days_back=3, order=order)
    docs = jobs.post_and_comment_documents(posts, comments, ["the", "que"], now=now, days_back=3)
    seen = ingest.review_statistics(document_reviews(spark, sf))
    return ingest.adapter_statistics(posts, matched, ingest.comments_of(comments, matched, order=order), docs).select(
        "*", seen.select("apps_seen").scalar().alias("apps_seen"), seen.select("reviews_seen").scalar().alias("reviews_seen"))


@query
def keyword_search(spark, sf):
    return ingest.matched_posts(
        conversation_posts(spark, sf), ["que la", " THE "], now=F.lit("2024-01-05").cast("timestamp"), days_back=2,
        order=[F.asc("arrival")],
    ).select("id", "subreddit", "created_utc")


@query
def review_ingest_capped(spark, sf):
    kept = ingest.newest_reviews(document_reviews(spark, sf), ["the", "la"], now=F.lit(NOW).cast("timestamp"), days_back=40, per_app=30)
    return kept.select("app_id", "reviewId", "userName", "score", "arrival")


@query
def epoch_window(spark, sf):
    rows = document_submissions(spark, sf)
    return ingest.in_epoch_window(rows, 1705276800, 1706745600).select("id", "created_utc")


@query
def keyword_or_recent(spark, sf):
    rows = document_submissions(spark, sf).withColumn("subreddit", F.concat_ws("-", "subreddit", "author"))
    return ingest.keyword_or_recent(rows, ["the and", "que la"], include_recent=True).select("id", "subreddit")


_GRID_WORDS = ("que la", "anble", "zzz")


@query
def query_grid_diagnostics(spark, sf):
    rows = document_submissions(spark, sf)
    communities = [f"src{i}" for i in range(20)] + ["nowhere"]
    grid = ingest.query_grid(spark, communities, _GRID_WORDS)
    hits = ingest.grid_hits(rows, _GRID_WORDS)
    fallback = rows.where(F.col("subreddit") == "src1").groupBy("subreddit").agg(F.count("*").alias("hits"))
    return ingest.fetch_diagnostics(ingest.query_counts(grid, hits), fallback)


@query
def per_query_cap(spark, sf):
    hits = ingest.grid_hits(document_submissions(spark, sf), ("the", "la"))
    return ingest.capped_hits(hits, 25).select("subreddit", "keyword", "id")


@query
def source_priority(spark, sf):
    docs = views.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    bench = views.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    chain = [("empty", bench.where(F.contains("text", F.lit("no such words")))), ("items", bench), ("documents", docs)]
    return ingest.first_with_rows(chain).select("backend", "id", F.sha2("text", 256).alias("text_hash"))


# Feeds and dates -----------------------------------------------------------------------------
def _feed_text(c: str) -> Column:
    """Letters, digits and basic marks, which XML carries unchanged."""
    return F.regexp_replace(c, r"[^\p{L}\p{N} .,]", " ")


def _xml(tag: str, body: Column, attributes: str = "") -> Column:
    return F.concat(F.lit(f"<{tag}{attributes}>"), body, F.lit(f"</{tag}>"))


@query
def atom_entries(spark, sf):
    d = views.documents(spark, sf)
    i = F.col("external_id")
    day = F.date_format(F.coalesce("published_at", "created_at"), "yyyy-MM-dd'T'HH:mm:ss")
    entry = _xml("entry", F.concat(
        _xml("id", F.concat(F.lit("tag:/t3/"), i)),
        _xml("title", F.concat(F.lit("Post "), i)),
        F.when(F.col("id") % 5 != 0, _xml("updated", F.concat(day, F.lit("+00:00")))).otherwise(
            _xml("published", F.concat(day, F.lit("Z")))),
        _xml("author", _xml("name", F.col("author"))),
        F.concat(F.lit('<category term="'), F.col("subreddit"), F.lit('"/>')),
        F.lit('<link rel="self" href="https://x.example.com/self"/>'),
        F.concat(F.lit('<link rel="alternate" href="https://www.reddit.com/r/a/'), i, F.lit('"/>')),
        F.when(F.col("id") % 7 != 0, _xml("content", F.concat(F.lit("&lt;p&gt;"), _feed_text("body"), F.lit("&lt;/p&gt; &amp;amp; more")), ' type="html"')).otherwise(""),
    ))
    parsed = d.select(F.from_xml(entry, landing.schemas.ATOM_ENTRY).alias("e")).select("e.*")
    out = landing.atom_submissions(parsed)
    return out.withColumn("selftext", F.sha2("selftext", 256)).withColumn("created_utc", F.col("created_utc").cast("long"))


@query
def rss_items(spark, sf):
    d = views.documents(spark, sf)
    i = F.col("external_id")
    item = _xml("item", F.concat(
        F.when(F.col("id") % 3 == 0, _xml("guid", F.concat(F.lit("https://x.example.com/g/"), i, F.lit("/")))).otherwise(""),
        _xml("link", F.concat(F.lit("https://www.reddit.com/r/b/"), i, F.lit("/"))),
        _xml("title", F.concat(F.lit("Item "), i)),
        _xml("description", _feed_text("body")),
        _xml("author", F.col("author")),
        _xml("category", F.col("subreddit")), _xml("category", F.lit("second")),
        _xml("pubDate", F.concat(F.lit("Mon, "), F.date_format(F.coalesce("published_at", "created_at"), "dd MMM yyyy HH:mm:ss"),
                                 F.when(F.col("id") % 2 == 0, " GMT").otherwise(" +0200"))),
    ))
    parsed = d.select(F.from_xml(item, landing.schemas.RSS_ITEM).alias("e")).select("e.*")
    out = landing.rss_submissions(parsed)
    return out.withColumn("selftext", F.sha2("selftext", 256)).withColumn("created_utc", F.col("created_utc").cast("long"))


def _date_texts(spark, sf) -> DataFrame:
    t = F.coalesce("published_at", "created_at")
    iso = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    forms = [
        F.concat(iso, F.lit("Z")), F.concat(iso, F.lit("-05:00")), iso, F.date_format(t, "yyyy-MM-dd"),
        F.unix_timestamp(t).cast("string"), F.lit("not a date"), F.lit(""),
    ]
    form = F.element_at(F.array(*forms), (F.col("id") % 7 + 1).cast("int"))
    return views.documents(spark, sf).select("id", form.alias("date_text"))


@query
def flexible_dates(spark, sf):
    parsed = dates.flexible_timestamp(F.col("date_text"))
    return _date_texts(spark, sf).select("id", parsed.alias("created_at"), F.to_date(parsed).alias("day"), dates.iso_text(parsed).alias("iso"))


@query
def ingest_window(spark, sf):
    rows = _date_texts(spark, sf).select("id", dates.flexible_timestamp(F.col("date_text")).alias("created_at"))
    start, end = (F.lit(d).cast("timestamp") for d in ("2024-01-10", "2024-02-01 05:00:00"))
    return ingest.in_time_window(rows, start, end)


@query
def clean_text(spark, sf):
    docs = views.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    turns = views.table(spark, sf, "conversations").select((-F.col("conv_id") * 100 - F.col("turn") - 1).alias("id"),
        F.when(F.col("turn") == 3, F.lit(" [Removed]\n")).when(F.col("turn") == 4, "N/A").otherwise(F.col("text")).alias("text"))
    c = F.col("text")
    return docs.unionByName(turns).select(
        "id", F.sha2(text.clean_whitespace(c), 256).alias("cleaned"), text.is_deleted(c).alias("deleted"),
        F.length(text.tagging_text(c)).alias("tagging_chars"),
        text.keyword_hits(c, ("the", "que", "und")).alias("hits"),
    )


@query
def clean_documents(spark, sf):
    docs = views.table(spark, sf, "pages").select(
        "page_id", _page_title().alias("title"), F.when(F.col("page_id") % 4 == 0, " [deleted] ").otherwise(F.col("html")).alias("content"), "url"
    )
    return jobs.clean_documents(docs).withColumn("content", F.sha2("content", 256))


# Run ledgers ---------------------------------------------------------------------------------
def run_events(spark, sf) -> DataFrame:
    """Each event is the completion of a run; the same row without an end is its start."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    stage = F.concat(
        F.lit('{"backend_used":"a","stages":{"fetch":{"status":"succeeded"},"normalize":{"status":"succeeded","count":'), k.cast("string"),
        F.lit('},"insert":{"status":"failed","error":{"class":"E","message":"user '), F.col("user_id").cast("string"), F.lit('"}}}}'),
    )
    return views.table(spark, sf, "events").select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("source_name"),
        F.col("ts").cast("timestamp").alias("completed_at"),
        F.when(F.col("value") < 2, "failed").otherwise("completed").alias("status"),
        k.alias("records_fetched"), F.floor(F.col("value")).alias("records_inserted"),
        F.when(F.col("event_id") % 3 == 0, stage).when(F.col("event_id") % 3 == 1, "plain message").alias("error_message"),
    )


@query
def run_metrics(spark, sf):
    return runs.metrics_by_platform(run_events(spark, sf))


@query
def recent_runs(spark, sf):
    return runs.recent_runs(run_events(spark, sf)).drop("error_message")


@query
def run_stage_rows(spark, sf):
    return runs.stage_rows(run_events(spark, sf))


@query
def run_state(spark, sf):
    done = run_events(spark, sf).withColumn("event_seq", F.lit(2).cast("long"))
    begun = done.withColumns({
        "event_seq": F.lit(1).cast("long"), "status": F.lit("running"), "completed_at": F.lit(None).cast("timestamp"),
        "records_fetched": F.lit(0).cast("long"), "records_inserted": F.lit(0).cast("long"),
    })
    # Runs of type `error` never completed.
    return runs.run_state(begun.unionByName(done.where("source_name <> 'error'"))).drop("error_message")


@query
def snapshot_latest_valid(spark, sf):
    saved = views.table(spark, sf, "events").select(
        F.col("event_type").alias("module"), F.col("user_id").cast("string").alias("cache_key"),
        F.col("event_id").alias("snapshot_id"), F.col("props").alias("payload"), F.col("ts").cast("timestamp").alias("created_at"),
    )
    return snapshots.latest_valid(saved, datetime(2024, 1, 20, tzinfo=timezone.utc))


# Jobs ----------------------------------------------------------------------------------------
def _scratch(spark: SparkSession) -> str:
    """A new folder in the cluster's shared folder; a local one only where none is set."""
    try:
        base = shared_dir(spark)
    except ValueError:
        if not spark.sparkContext.master.startswith("local"):
            raise
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/voxlake-{uuid.uuid4().hex}"


def _clock() -> datetime:
    return datetime(2024, 3, 15, 12, tzinfo=timezone.utc)


def _ingest(spark: SparkSession, sf: str, store: Store) -> None:
    landed = f"{store.root}/landed"
    conversation_posts(spark, sf).drop("arrival").write.json(f"{landed}/posts")
    conversation_comments(spark, sf).drop("arrival").write.json(f"{landed}/comments")
    document_reviews(spark, sf).drop("arrival").write.json(f"{landed}/reviews")
    now = F.lit(_clock())

    def grid() -> DataFrame:
        raw = landing.flat_submissions(spark, f"{landed}/posts")
        return jobs.grid_documents(raw, [f"c{i}" for i in range(7)], ["the", "que la"], start=0, end=2_000_000_000)

    def threads() -> DataFrame:
        return jobs.post_and_comment_documents(
            landing.flat_submissions(spark, f"{landed}/posts"), landing.comments(spark, f"{landed}/comments"),
            ["the", "que"], now=now, days_back=100,
        )

    def store_reviews() -> DataFrame:
        apps = [f"src{i}" for i in range(20)]
        return jobs.review_documents(landing.reviews(spark, f"{landed}/reviews"), apps, [], now=now, days_back=100)

    missing = ("dump", lambda: landing.submissions(spark, f"{landed}/none"))
    for platform, chain in (
        (K.REDDIT, [missing, ("grid", grid)]),
        (K.REDDIT, [("threads", threads)]),
        (K.GOOGLE_PLAY, [("reviews", store_reviews)]),
    ):
        jobs.refresh_platform(store, platform, chain, clock=_clock, taxonomy=views.TAXONOMY)


@query
def ingest_end_to_end(spark, sf):
    """Every stored document with its keys, text and tags."""
    store = Store(spark, _scratch(spark))
    _ingest(spark, sf, store)
    tags = store.read("document_tags").groupBy(F.col("document_id").alias("id")).agg(
        F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "tag_type", "tag_value"))), ",").alias("tags"))
    return store.read("documents").join(tags, "id", "left").select(
        "source_id", "entity_type", "external_id", "dedupe_key", "title", F.sha2("body", 256).alias("body_hash"), "subreddit",
        "community_or_channel", "author", "rating", "published_at", "url", F.coalesce("tags", F.lit("")).alias("tags"))


@query
def ingest_cleaned_tagged(spark, sf):
    """Posts that come by themselves: cleaned, stored and tagged in one call, the last half of them twice."""
    store = Store(spark, _scratch(spark))
    docs = normalize.submissions(conversation_posts(spark, sf), keep=("arrival",))
    docs = docs.withColumn("content", F.when(F.col("arrival") % 4 == 0, " [Removed]\n").otherwise(F.col("content")))
    for part in (docs, docs.where("arrival % 2 = 1")):
        jobs.ingest_documents(store, part, K.REDDIT, now=_clock(), taxonomy=views.TAXONOMY)
    tags = store.read("document_tags").groupBy(F.col("document_id").alias("id")).agg(
        F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "tag_type", "tag_value"))), ",").alias("tags"))
    return store.read("documents").join(tags, "id", "left").select(
        "external_id", "title", F.sha2("body", 256).alias("body_hash"), F.coalesce("tags", F.lit("")).alias("tags"),
        F.get_json_object("raw_json", "$.ingestion_ts").alias("ingestion_ts"))


@query
def stored_ids(spark, sf):
    """Ids of the stored documents are gapless, in the order of the runs and within them of arrival."""
    store = Store(spark, _scratch(spark))
    _ingest(spark, sf, store)
    return store.read("documents").groupBy("source_id", "entity_type").agg(
        F.count("*").alias("docs"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


def _report(store: Store) -> DataFrame:
    """The store's ledger: each run's state and its diagnostics as text."""
    return runs.run_state(store.read("ingestion_runs"))


@query
def fetch_diagnostics_ledger(spark, sf):
    """Figures of a run's own queries, read back from the ledger: `c0` finds nothing and falls back to its recent posts."""
    store = Store(spark, _scratch(spark))
    landed = f"{store.root}/landed"
    posts = conversation_posts(spark, sf).drop("arrival")
    quiet = F.col("subreddit") == "c0"
    posts.withColumns({c: F.when(quiet, F.lit("-")).otherwise(F.col(c)) for c in ("title", "selftext")}).write.json(landed)
    read, figures = jobs.grid_source(
        lambda: landing.flat_submissions(spark, landed), ["c0", "c1", "c2", "nowhere"], ["the", "que la", "zzz"],
        start=0, end=2_000_000_000)
    jobs.refresh_platform(store, K.REDDIT, [("grid", read)], clock=_clock, fetch_diagnostics=figures)
    names = ("queries_attempted", "queries_with_hits", "search_hits_total", "subreddits_with_hits", "new_fallback_hits_total")
    d = F.from_json(F.get_json_object("error_message", "$.fetch_diagnostics"),
                    ", ".join(f"{n} long" for n in names) + ", failed_or_empty_queries_top5 array<string>")
    return _report(store).select("status", "records_inserted", d.alias("d")).select("status", "records_inserted", "d.*")


@query
def landed_corrupt_rows(spark, sf):
    """Every tenth landed line is cut in its middle: it is no document, but counted in the ledger and kept with its text."""
    store = Store(spark, _scratch(spark))
    landed = f"{store.root}/landed"
    posts = conversation_posts(spark, sf)
    line = F.to_json(F.struct(*(c for c in posts.columns if c != "arrival")))
    cut = F.when(F.col("arrival") % 10 == 0, F.substr(line, F.lit(1), F.floor(F.length(line) / 2).cast("int"))).otherwise(line)
    posts.select(cut.alias("value")).write.text(landed)
    read = lambda: normalize.submissions(landing.flat_submissions(spark, landed), keep=("arrival",))
    jobs.refresh_platform(store, K.REDDIT, [("posts", read)], clock=_clock, broken=lambda: landing.broken_lines(spark, landed))
    kept = spark.read.schema("file string, line string").parquet(rejected_path(store, K.REDDIT))
    number = F.get_json_object("error_message", "$.fetch_diagnostics.broken_lines").cast("long")
    return _report(store).select("status", "records_fetched", "records_inserted", number.alias("broken_lines"),
                                 kept.where(F.col("line") != "").agg(F.count("*")).scalar().alias("kept_lines"))


@query
def empty_run_ledger(spark, sf):
    """A run over posts of which none is in its window completes with zeros, stage by stage."""
    store = Store(spark, _scratch(spark))
    late = normalize.submissions(conversation_posts(spark, sf).where("created_utc > 2000000000"), keep=("arrival",))
    jobs.refresh_platform(store, K.REDDIT, [("posts", lambda: late)], clock=_clock)
    state = _report(store)
    return runs.stage_rows(state).join(state.select("run_id", F.col("status").alias("run_status"), "records_fetched", "records_inserted"),
                                       "run_id").drop("run_id")


@query
def web_ingest_end_to_end(spark, sf):
    store = Store(spark, _scratch(spark))
    # Every page is dated and linked from the listing page of its site.
    dated = F.replace("html", F.lit("<head>"), F.lit('<head><meta property="article:published_time" content="2024-02-01T10:00:00Z">'))
    crawled = _pages(spark, sf).select("page_id", "url", dated.alias("html"))
    start, end = (F.lit(d).cast("timestamp") for d in ("2024-01-01", "2024-03-01"))
    articles = jobs.article_documents(crawled.withColumn("arrival", F.col("page_id")), start=start, end=end)
    jobs.refresh_platform(store, K.WEB_REVIEWS, [("pages", lambda: articles)], clock=_clock)
    return store.read("documents").select("id", "external_id", "community_or_channel", "published_at")


@query
def web_refresh_end_to_end(spark, sf):
    """Links found on the listing pages, crawled, refused, dated, deduped and stored.

    A link's crawled page is that of the first listing page which has it. A page of every seventh listing is refused.
    """
    store = Store(spark, _scratch(spark))
    dated = F.replace("html", F.lit("<head>"), F.lit('<head><meta property="article:published_time" content="2024-02-01T10:00:00Z">'))
    first = _scored(spark, sf).groupBy(F.col("link").alias("url")).agg(F.min("page_id").alias("page_id"))
    status = F.when(F.col("page_id") % 7 == 3, 403).otherwise(200).alias("status")
    crawled = first.join(_pages(spark, sf).select("page_id", dated.alias("html"), status), "page_id")
    start, end = (F.lit(d).cast("timestamp") for d in ("2024-01-01", "2024-03-01"))
    found = jobs.web_documents(_linked_pages(spark, sf), crawled, start=start, end=end, keywords=_WORDS, per_site=12)
    jobs.refresh_platform(store, K.WEB_REVIEWS, [("pages", lambda: found)], clock=_clock)
    body = F.sha2("body", 256).alias("body_hash")
    return store.read("documents").select("id", "external_id", "community_or_channel", "title", body, "published_at")


@query
def enrich_end_to_end(spark, sf):
    store = Store(spark, _scratch(spark))
    reviews = jobs.review_documents(
        document_reviews(spark, sf), [f"src{i}" for i in range(20)], [], now=F.lit(_clock()), days_back=100
    )
    jobs.refresh_platform(store, K.GOOGLE_PLAY, [("reviews", lambda: reviews)], clock=_clock)
    jobs.enrich_documents(store, None, clock=_clock, model_name="rules")
    keys = store.read("documents").select(F.col("id").alias("document_id"), "external_id", "dedupe_key", F.sha2("body", 256).alias("body_hash"))
    payload = F.get_json_object("metadata_json", "$.sentiment_label").alias("payload_label")
    return store.read("enrichments").join(keys, "document_id").select(
        "external_id", "dedupe_key", "body_hash", "model_name", "sentiment_label", "rating", payload)


@query
def stream_ingest_end_to_end(spark, sf):
    """Posts that land in four files, of which the last repeats a third of the first three; the stream takes in file by
    file. Each stored document, and whether the index that the stream wrote finds it by the word `the`."""
    store = Store(spark, _scratch(spark))
    landed, index = f"{store.root}/landed", f"{store.root}/index"
    posts = conversation_posts(spark, sf)
    for part in range(4):
        own = F.col("arrival") % 3 == (part if part < 3 else 0)
        posts.where(own).drop("arrival").coalesce(1).write.mode("append").json(landed)
    taken = ingest_new_files(
        store, K.REDDIT, landed, landing.schemas.SUBMISSION, normalize.submissions, clock=_clock, name=f"stream-{uuid.uuid4().hex}",
        taxonomy=views.TAXONOMY, index_path=index, identity=tuple(c for c in posts.columns if c != "arrival"), delay="7 days",
        merge_every=2, max_files=1)
    taken.awaitTermination()
    if taken.exception() is not None:
        raise taken.exception()
    hits = fulltext.score_index(fulltext.read_index(spark, index), fulltext.match_all("the")).select("id", F.lit(True).alias("found"))
    return store.read("documents").join(hits, "id", "left").select(
        "external_id", "title", F.sha2("body", 256).alias("body_hash"), "subreddit", F.coalesce("found", F.lit(False)).alias("found"))
