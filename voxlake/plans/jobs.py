"""End-to-end jobs: platform refresh, web refresh, enrichment."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from voxlake import constants as K
from voxlake.functions.dates import epoch_timestamp
from voxlake.functions.keys import web_key
from voxlake.functions.text import clean_whitespace, is_deleted
from voxlake.functions.urls import canonical_url, is_blocked, normalize_url
from voxlake.operators import enrich, ingest, normalize, pages as page_ops
from voxlake.operators.ranking import keep_first
from voxlake.operators.store import (
    complete_run, cut_lineage, ensure_source, insert_documents, insert_enrichments, rejected_path, staging,
    start_run,
)
from voxlake.operators.tagging import Taxonomy
from voxlake.sources.tables import Store

Reader = Callable[[], DataFrame]


# Documents of each platform -----------------------------------------------------------------------
def grid_fetch(raw: DataFrame, communities: Sequence[str], keywords: Sequence[str], *, start: int, end: int,
               include_recent: bool = True, per_query: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Submissions found by a community and keyword grid, and one row of figures about the queries.

    Communities without any hit fall back to their recent posts. A post found by several queries
    stays once, at its first arrival. Hits and fallback are written once, as keys; documents and figures are made of them.
    """
    known = raw.where(F.col("subreddit").isin(*communities))
    window = ingest.in_epoch_window(known, start, end)
    slim = ["id", "subreddit", "created_utc", "arrival"]
    hits = cut_lineage(ingest.capped_hits(ingest.grid_hits(window, keywords).select(*slim, "keyword"), per_query))
    quiet = window.join(hits.select("subreddit").distinct(), "subreddit", "left_anti")
    recents = cut_lineage(ingest.keyword_or_recent(quiet, keywords, include_recent=include_recent).select(*slim))
    found = hits.select(*slim).unionByName(recents).dropDuplicates(["arrival"])
    once = keep_first(found, ["id"], [F.asc("arrival")], row_id="arrival")
    # Posts were chosen on keys; their texts are read for the chosen ones alone.
    chosen = known.join(once.select("arrival"), "arrival", "left_semi")
    counts = ingest.query_counts(ingest.query_grid(raw.sparkSession, communities, keywords), hits)
    fallback = recents.groupBy("subreddit").agg(F.count("*").alias("hits"))
    return normalize.submissions(chosen, keep=("arrival",)), ingest.fetch_diagnostics(counts, fallback)


def grid_documents(raw: DataFrame, communities: Sequence[str], keywords: Sequence[str], **options: Any) -> DataFrame:
    """The documents of `grid_fetch`."""
    return grid_fetch(raw, communities, keywords, **options)[0]


def grid_source(read: Reader, communities: Sequence[str], keywords: Sequence[str], **options: Any) -> tuple[Reader, Callable[[], dict[str, Any]]]:
    """A reader for `refresh_platform` and the fetch diagnostics of what it has read, which the ledger keeps."""
    figures: dict[str, Any] = {}

    def documents() -> DataFrame:
        docs, found = grid_fetch(read(), communities, keywords, **options)
        figures.clear()
        figures.update(found.first().asDict())
        return docs

    return documents, lambda: figures


def post_and_comment_documents(posts: DataFrame, comments: DataFrame, keywords: Sequence[str], *,
                               now: Column, days_back: int, post_limit: int | None = None,
                               comment_limit: int | None = None) -> DataFrame:
    """Recent posts that match a keyword, and the comments of all matching posts."""
    by_arrival = [F.asc("arrival")]
    newest = ingest.newest_per_community(posts, post_limit)
    recent = newest.where(
        ingest.recent(epoch_timestamp(F.coalesce("created_utc", F.lit(0))), now, days_back)
    )
    matched = ingest.matched_posts(posts, keywords, now=now, days_back=days_back, order=by_arrival)
    ids = matched.select("id")
    kept = recent.join(ids, "id", "left_semi")
    replies = ingest.comments_of(comments, ids, per_post=comment_limit, order=by_arrival)
    # Posts come before comments, whichever file arrived first.
    return normalize.posts(kept, keep=("arrival",)).unionByName(
        normalize.comments(replies, keep=("arrival",))
    ).withColumn("arrival", F.struct((F.col("doc_type") == "comment").alias("late"), F.col("arrival")))


def review_documents(reviews: DataFrame, apps: Sequence[str], keywords: Sequence[str], *, now: Column,
                     days_back: int, per_app: int | None = None) -> DataFrame:
    own = reviews.where(F.col("app_id").isin(*apps))
    newest = ingest.newest_reviews(own, keywords, now=now, days_back=days_back, per_app=per_app)
    return normalize.reviews(newest, keep=("arrival",))


def web_documents(listing_pages: DataFrame, crawled: DataFrame, *, start: Column, end: Column,
                  keywords: Sequence[str] | None = None, prioritize_keywords: bool = False,
                  per_site: int | None = None, min_content_chars: int = K.MIN_ARTICLE_CHARS) -> DataFrame:
    """Articles linked from the listing pages, out of the crawled pages."""
    scored = page_ops.score_links(page_ops.candidate_links(page_ops.page_links(listing_pages, keywords)), keywords)
    order = page_ops.ranked_links if prioritize_keywords else page_ops.first_links
    chosen = order(scored, per_site=per_site).select(
        F.col("link").alias("url"), F.struct("site", "place").alias("arrival")
    )
    return article_documents(
        crawled.join(chosen, "url"), start=start, end=end, min_content_chars=min_content_chars
    )


def article_documents(crawled: DataFrame, *, start: Column, end: Column,
                      min_content_chars: int = K.MIN_ARTICLE_CHARS) -> DataFrame:
    """Crawled pages (with `arrival`, and `status` where known) to dated articles under their canonical address.

    Answers of anti-bot pages are left out.
    """
    status = F.col("status") if "status" in crawled.columns else F.lit(200)
    answered = crawled.where(~F.coalesce(is_blocked(status, F.col("html")), F.lit(False)))
    found = normalize.articles(
        page_ops.extract_articles(answered), min_content_chars=min_content_chars, keep=("arrival",)
    )
    return (
        ingest.in_time_window(found, start, end)
        .withColumn("external_id", F.coalesce(canonical_url(F.col("url")), F.col("url")))
        .withColumn("dedupe_key", web_key(F.col("url"), F.col("title"), F.col("content")))
    )


def clean_documents(docs: DataFrame) -> DataFrame:
    """Clean-up of documents that come by themselves: spacing of title and body, removed bodies, URL."""
    return docs.withColumns(
        {
            "title": clean_whitespace(F.col("title")),
            "content": F.when(is_deleted(F.col("content")), F.lit("")).otherwise(clean_whitespace(F.col("content"))),
            "url": normalize_url(F.col("url")),
        }
    )


def ingest_documents(store: Store, docs: DataFrame, platform: str, *, now: datetime, taxonomy: Taxonomy,
                     index_path: str | None = None) -> int:
    """Cleans canonical documents (with their `arrival`), stores the new ones and tags them as they are stored, all or
    nothing; how many were new. There is no ledger row: nothing was fetched."""
    with staging(store.spark):
        cleaned = cut_lineage(clean_documents(docs))
        source_id = ensure_source(store, platform, now=now)
        return insert_documents(store, cleaned, source_id, now=now, taxonomy=taxonomy, index_path=index_path)


# Platform refresh ----------------------------------------------------------------------------------
@dataclass
class Diagnostics:
    """What a run reports in its ledger row."""

    platform: str
    backend_requested: str | None = None
    backend_used: str | None = None
    config: Mapping[str, Any] = field(default_factory=dict)
    fallback_chain: list[dict[str, Any]] = field(default_factory=list)
    fetch: dict[str, Any] = field(default_factory=dict)
    stages: dict[str, dict[str, Any]] = field(
        default_factory=lambda: {s: {"status": "pending"} for s in K.RUN_STAGES}
    )
    counters: dict[str, int] = field(default_factory=dict)
    first_failing_stage: str | None = None
    error_summary: str | None = None

    def passed(self, stage: str, **values: Any) -> None:
        self.stages[stage] = {"status": "succeeded", **values}

    def failed(self, stage: str, error: Exception) -> None:
        kind = type(error).__name__
        self.stages[stage] = {
            **self.stages[stage], "status": "failed", "error": {"class": kind, "message": str(error)},
        }
        self.first_failing_stage = self.first_failing_stage or stage
        self.error_summary = f"{kind}: {error}"

    def as_dict(self) -> dict[str, Any]:
        tried = [c for c in self.fallback_chain if c["status"] != "succeeded"]
        return {
            "platform": self.platform,
            "backend_requested": self.backend_requested,
            "backend_used": self.backend_used,
            "fallback_activated": bool(tried) and self.backend_used is not None,
            "fallback_chain": self.fallback_chain,
            "effective_config": dict(self.config),
            "stages": self.stages,
            "fetch_diagnostics": self.fetch,
            "counters": self.counters,
            "first_failing_stage": self.first_failing_stage,
            "error_summary": self.error_summary,
        }


def first_available(chain: Sequence[tuple[str, Reader]], diagnostics: Diagnostics, *,
                    must_have_rows: bool = True) -> DataFrame:
    """The first source of the chain that reads and has rows; every attempt is recorded.

    Documents are made here once and kept in the shared folder, so that a source that breaks half
    way breaks in this step and the next one gets its turn. Without `must_have_rows` sources that read
    well and are empty give an empty result; with it they are an error, like broken ones.
    """
    notes = []
    nothing = None
    for name, read in chain:
        attempt: dict[str, Any] = {"backend": name, "status": "running"}
        diagnostics.fallback_chain.append(attempt)
        try:
            docs = cut_lineage(read())
            empty = docs.isEmpty()
        except Exception as error:  # a broken source must not stop the chain
            attempt |= {"status": "failed", "error": {"class": type(error).__name__, "message": str(error)}}
            notes.append(f"{name} failed: {error}")
            continue
        if not empty:
            attempt["status"] = "succeeded"
            diagnostics.backend_used = name
            return docs
        attempt["status"] = "empty"
        nothing = nothing or (name, docs)
        notes.append(f"{name} returned 0 docs")
    if nothing is not None and not must_have_rows:
        diagnostics.backend_used, docs = nothing
        return docs
    raise RuntimeError("no source returned documents (" + ("; ".join(notes) or "none configured") + ")")


def refresh_platform(store: Store, platform: str, chain: Sequence[tuple[str, Reader]], *,
                     clock: Callable[[], datetime], taxonomy: Taxonomy | None = None,
                     config: Mapping[str, Any] | None = None, must_have_rows: bool | None = None, index_path: str | None = None,
                     fetch_diagnostics: Callable[[], Mapping[str, Any]] | None = None,
                     broken: Reader | None = None) -> dict[str, int]:
    """Fetch, dedupe, insert and record one platform's documents.

    `broken` gives the lines that are no records (`landing.broken_lines`); they are kept under `rejected/` in the store and
    their number is in the ledger.

    Each reader of the chain returns canonical documents with their `arrival`. A run without new rows
    completes with zero, unless rows are asked for; a chain of several sources asks for them.
    """
    with staging(store.spark):
        return _refresh(store, platform, chain, clock, taxonomy, config, must_have_rows, index_path, fetch_diagnostics, broken)


def _refresh(store: Store, platform: str, chain: Sequence[tuple[str, Reader]], clock: Callable[[], datetime],
             taxonomy: Taxonomy | None, config: Mapping[str, Any] | None, must_have_rows: bool | None,
             index_path: str | None, fetch_diagnostics: Callable[[], Mapping[str, Any]] | None, broken: Reader | None) -> dict[str, int]:
    started = clock()
    report = Diagnostics(platform, backend_requested=chain[0][0] if chain else None, config=config or {})
    source_id = ensure_source(store, platform, now=started)
    run_id = start_run(store, "ingestion_runs", now=started, source_name=platform,
                       records_fetched=0, records_inserted=0)
    fetched = inserted = 0
    step = "fetch"
    try:
        docs = first_available(chain, report, must_have_rows=len(chain) > 1 if must_have_rows is None else must_have_rows)
        if fetch_diagnostics is not None:
            report.fetch = dict(fetch_diagnostics())
        if broken is not None:
            report.fetch["broken_lines"] = _keep_broken(store, platform, broken())
        step = "insert"
        fetched = docs.count()
        inserted = insert_documents(store, docs, source_id, now=started, taxonomy=taxonomy, index_path=index_path)
        report.passed("fetch")
        report.passed("normalize", count=fetched)
        report.passed("insert", inserted=inserted)
        report.passed("dedupe", skipped=max(fetched - inserted, 0))
        report.stages["enrich_trigger"] = {"status": "not_triggered"}
        report.counters = {
            "fetch_succeeded": fetched, "normalize_count": fetched, "inserted_count": inserted,
            "dedupe_skipped": max(fetched - inserted, 0),
            "fetch_failed": sum(c["status"] == "failed" for c in report.fallback_chain),
        }
        status = "completed"
        return {"records_fetched": fetched, "records_inserted": inserted}
    except Exception as error:
        report.failed(step, error)
        status = "failed"
        raise
    finally:
        complete_run(
            store, "ingestion_runs", run_id, started=started, now=clock(), status=status,
            diagnostics=report.as_dict(), source_name=platform,
            records_fetched=fetched, records_inserted=inserted,
        )


def _keep_broken(store: Store, platform: str, lines: DataFrame) -> int:
    lines = cut_lineage(lines)
    n = lines.count()
    if n:
        lines.write.mode("append").parquet(rejected_path(store, platform))
    return n


# Enrichment ------------------------------------------------------------------------------------------
def enrich_documents(store: Store, scorer: enrich.Scorer | None, *, clock: Callable[[], datetime],
                     model_name: str, prompt_version: str = "v1", limit: int | None = None,
                     min_chars: int = enrich.MIN_TEXT_CHARS, max_chars: int | None = None,
                     batch_size: int = enrich.BATCH_SIZE) -> dict[str, int]:
    """Label documents that have no enrichment yet; short ones by rule, the others by the scorer (None: by rule).

    The scorer runs once: its replies are checkpointed before they are stored and counted.
    """
    with staging(store.spark):
        return _enrich(store, scorer, clock, model_name, prompt_version, limit, min_chars, max_chars, batch_size)


def _enrich(store: Store, scorer: enrich.Scorer | None, clock: Callable[[], datetime], model_name: str, prompt_version: str,
            limit: int | None, min_chars: int, max_chars: int | None, batch_size: int) -> dict[str, int]:
    started = clock()
    run_id = start_run(store, "enrichment_runs", now=started)
    stats = {"candidates": 0, "enriched": 0, "skipped_short": 0, "failed_batches": 0}
    try:
        waiting = enrich.candidates(
            store.read("documents"), store.read("enrichments"), store.read("sources"), limit
        )
        rows = cut_lineage(enrich.prepare(waiting, min_chars=min_chars, max_chars=max_chars))
        by_rule = enrich.rule_enrichment(rows.where("is_short"))
        longer = rows.where("NOT is_short")
        replies = cut_lineage(
            enrich.rule_replies(longer) if scorer is None else enrich.score(longer, scorer, batch_size=batch_size)
        )
        scored = (
            replies.where("status = 'enriched'")
            .join(rows.select("document_id", "rating"), "document_id")
            .select("document_id", *enrich.clean_reply(model_name), "rating")
        )
        labelled = enrich.with_metadata(
            by_rule.unionByName(scored), prompt_version=prompt_version, enriched_at=F.lit(started)
        )
        outcome = by_rule.select(F.lit("short").alias("status"), F.lit(False).alias("failed_batch")).unionByName(
            replies.select("status", "failed_batch")
        )
        stats = enrich.statistics(outcome).first().asDict()
        insert_enrichments(store, labelled.withColumn("created_at", F.lit(started)))
        status, message = "completed", None
        return stats
    except Exception as error:
        status, message = "failed", f"{type(error).__name__}: {error}"
        raise
    finally:
        complete_run(
            store, "enrichment_runs", run_id, started=started, now=clock(), status=status,
            diagnostics=message, **stats,
        )
