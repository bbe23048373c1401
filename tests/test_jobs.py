import json
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from voxlake import schemas
from voxlake.operators import enrich, normalize, runs
from voxlake.operators.store import ensure_source, insert_documents, number_rows, retag
from voxlake.operators.tagging import Taxonomy
from voxlake.plans import answers, jobs, snapshots
from voxlake.streaming.landing import ingest_new_files

NOW = datetime(2024, 3, 10, 12, tzinfo=timezone.utc)
TAXONOMY = Taxonomy.of({"products": ["watch"], "issues": ["battery"]})


class Clock:
    def __init__(self):
        self.now = NOW

    def __call__(self):
        self.now += timedelta(seconds=1)
        return self.now


def canonical(spark, rows, platform="reddit"):
    """(arrival, external id, dedupe key, title, content)"""
    fields = {f.name: None for f in schemas.CANONICAL_DOC.fields}
    data = []
    for arrival, external, key, title, content in rows:
        doc = {**fields, "source": platform, "platform": platform, "external_id": external, "dedupe_key": key, "title": title,
               "content": content, "community_or_channel": "sub", "created_at": NOW, "entity_type": "post", "rating": 4}
        data.append((*doc.values(), arrival))
    schema = T.StructType(schemas.CANONICAL_DOC.fields + [T.StructField("arrival", T.LongType())])
    return spark.createDataFrame(data, schema)


def test_insert_is_first_wins_and_idempotent(spark, store):
    source = ensure_source(store, "reddit", now=NOW)
    assert ensure_source(store, "reddit", now=NOW) == source and ensure_source(store, "web_reviews", now=NOW) == source + 1
    docs = canonical(spark, [(3, "b", None, "late", "x"), (1, "a", None, "first watch", "battery"), (2, "a", None, "second", "x"), (4, None, "k", None, "y"), (5, None, "k", None, "z")])
    assert insert_documents(store, docs, source, now=NOW, taxonomy=TAXONOMY) == 3
    assert insert_documents(store, docs, source, now=NOW, taxonomy=TAXONOMY) == 0
    rows = store.read("documents").orderBy("id").collect()
    assert [(r.id, r.external_id, r.title) for r in rows] == [(1, "a", "first watch"), (2, "b", "late"), (3, None, None)]
    assert rows[0].event_month == "2024-03" and rows[0].subreddit == "sub" and json.loads(rows[0].raw_json)["rating"] == 4
    # The same external id of another source is another document.
    other = ensure_source(store, "web_reviews", now=NOW)
    assert insert_documents(store, canonical(spark, [(9, "a", None, "t", "c")]), other, now=NOW) == 1
    tags = {(r.document_id, r.tag_type, r.tag_value) for r in store.read("document_tags").collect()}
    assert tags == {(1, "product", "watch"), (1, "issue", "battery")}
    retag(store, TAXONOMY, now=NOW)
    assert store.read("document_tags").count() == 2


def test_ids_follow_the_order_over_partitions(spark):
    df = spark.range(1000).select((F.lit(1000) - F.col("id")).alias("arrival")).repartition(7)
    numbered, n = number_rows(df, "arrival", 11)
    assert n == 1000 and numbered.where("id <> arrival + 10").count() == 0


def test_source_chain_and_ledger(spark, store):
    docs = canonical(spark, [(1, "a", None, "t", "c"), (2, "a", None, "t", "c"), (3, "b", None, "t", "c")])

    def broken():
        raise OSError("down")

    chain = [("dump", broken), ("listing", lambda: docs.limit(0)), ("feed", lambda: docs)]
    clock = Clock()
    assert jobs.refresh_platform(store, "reddit", chain, clock=clock) == {"records_fetched": 3, "records_inserted": 2}
    run = runs.run_state(store.read("ingestion_runs")).first()
    report = json.loads(run.error_message)
    assert run.status == "completed" and (run.records_fetched, run.records_inserted) == (3, 2)
    assert [(c["backend"], c["status"]) for c in report["fallback_chain"]] == [("dump", "failed"), ("listing", "empty"), ("feed", "succeeded")]
    assert report["backend_used"] == "feed" and report["fallback_activated"] and report["counters"]["dedupe_skipped"] == 1
    stages = {r.stage: r for r in runs.stage_rows(runs.run_state(store.read("ingestion_runs"))).collect()}
    assert stages["normalize"]["count"] == 3 and stages["dedupe"].dedupe_skipped == 1 and stages["enrich_trigger"].status == "not_triggered"

    with pytest.raises(RuntimeError, match="no source returned documents"):
        jobs.refresh_platform(store, "reddit", chain[:2], clock=clock)
    last = runs.recent_runs(runs.run_state(store.read("ingestion_runs"))).first()
    report = json.loads(last.error_message)
    assert last.status == "failed" and report["first_failing_stage"] == "fetch" and "dump failed: down" in report["error_summary"]
    metrics = runs.metrics_by_platform(runs.run_state(store.read("ingestion_runs"))).first()
    assert (metrics.platform, metrics.fetched, metrics.inserted, metrics.errors) == ("reddit", 3, 2, 1)


def test_run_diagnostics_texts(spark):
    df = spark.createDataFrame([("a", "plain"), ("b", "{}"), ("c", None), ("d", "[1]"), ("e", '{"stages":{"fetch":{"status":"empty"}}}'), ("f", "{broken")], "run_id string, error_message string")
    rows = runs.stage_rows(df).collect()
    assert {r.run_id for r in rows} == {"e"} and len(rows) == 5 and rows[0].status == "empty" and rows[1].status == "unknown"


def test_enrichment_run(spark, store):
    source = ensure_source(store, "google_play", now=NOW)
    docs = canonical(spark, [(1, "a", None, None, "ok"), (2, "b", None, None, "a rather long review text"), (3, "c", None, None, "another quite long review")], "google_play")
    insert_documents(store, docs, source, now=NOW)

    def scorer(batch):
        return pd.DataFrame({"document_id": batch["document_id"], "sentiment_label": "MIXED", "primary_issue_category": "sync"})

    clock = Clock()
    stats = jobs.enrich_documents(store, scorer, clock=clock, model_name="m")
    assert stats == {"candidates": 3, "enriched": 3, "skipped_short": 1, "failed_batches": 0}
    rows = {r.document_id: r for r in store.read("enrichments").collect()}
    assert rows[1].model_name == "fallback_rules" and rows[1].sentiment_label == "positive"
    assert rows[2].sentiment_label == "mixed" and rows[2].primary_issue_category == "other" and rows[2].rating == 4
    assert json.loads(rows[2].metadata_json)["sentiment_label"] == "mixed"
    assert jobs.enrich_documents(store, scorer, clock=clock, model_name="m")["candidates"] == 0
    assert [r.status for r in runs.run_state(store.read("enrichment_runs")).collect()] == ["completed", "completed"]

    def failing(batch):
        raise ValueError("no")

    insert_documents(store, canonical(spark, [(4, "d", None, None, "yet another long review")], "google_play"), source, now=NOW)
    assert jobs.enrich_documents(store, failing, clock=clock, model_name="m") == {"candidates": 1, "enriched": 0, "skipped_short": 0, "failed_batches": 1}
    assert store.read("enrichments").count() == 3


def test_insight_snapshots(spark, store):
    source = ensure_source(store, "reddit", now=NOW)
    insert_documents(store, canonical(spark, [(1, "a", None, "t", "a bad but long enough text")]), source, now=NOW, taxonomy=TAXONOMY)
    jobs.enrich_documents(store, enrich.rule_scorer, clock=Clock(), model_name="rules")
    first = snapshots.insight(store, "sentiment", {}, now=NOW)
    assert first["metrics"]["total_docs"] == 1 and first["evidence"][0]["doc_id"] == 1
    insert_documents(store, canonical(spark, [(2, "b", None, "t", "more long enough text")]), source, now=NOW)
    jobs.enrich_documents(store, enrich.rule_scorer, clock=Clock(), model_name="rules")
    soon, later = NOW + timedelta(minutes=119), NOW + timedelta(minutes=121)
    assert snapshots.insight(store, "sentiment", {"cache_ttl_minutes": 120}, now=soon) == first
    assert snapshots.insight(store, "sentiment", {}, now=later)["metrics"]["total_docs"] == 2
    assert snapshots.insight(store, "sentiment", {"source": "web_reviews"}, now=soon)["metrics"]["total_docs"] == 0
    assert set(snapshots.rebuild(store, {}, now=soon)) == {"sentiment", "complaints", "feature_requests"}
    assert snapshots.insight(store, "sentiment", {}, now=soon)["metrics"]["total_docs"] == 2
    assert snapshots.cache_key("a", {"x": 1, "refresh_cache": True}) == snapshots.cache_key("a", {"x": 1}) != snapshots.cache_key("b", {"x": 1})


def test_web_refresh(spark, store):
    listing = "".join(f'<a href="/reviews/{n}?ref=1#c">{n}</a>' for n in "abcd") + '<a href="/about">x</a>'
    page = '<html><head><title>{t}</title><meta name="date" content="{d}"></head><body><article><p>{c}</p></article></body></html>'
    crawled = [(f"https://e.com/reviews/{n}?ref=1", page.format(t=n.upper(), d=d, c=c * 20)) for n, d, c in (
        ("a", "2024-03-01", "alpha "), ("b", "2024-03-05T23:59:59", "beta "), ("c", "2023-01-01", "old "), ("d", "", "undated "))]
    listings = spark.createDataFrame([(1, "https://e.com/", listing)], schemas.PAGE)
    pages = spark.createDataFrame(crawled, "url string, html string")
    start, end = F.lit(datetime(2024, 3, 1)), F.lit(datetime(2024, 3, 5, 23, 59, 59))
    run = lambda **o: jobs.refresh_platform(
        store, "web_reviews", [("crawl", lambda: jobs.web_documents(listings, pages, start=start, end=end, min_content_chars=50, **o))], clock=Clock())
    assert run(per_site=1)["records_inserted"] == 1
    assert run(keywords=["beta"], prioritize_keywords=True) == {"records_fetched": 2, "records_inserted": 1}
    rows = store.read("documents").orderBy("id").collect()
    assert [(r.external_id, r.title) for r in rows] == [("https://e.com/reviews/a", "A"), ("https://e.com/reviews/b", "B")]
    assert all(r.dedupe_key.startswith("web_reviews:canonical:") for r in rows)


def test_grid_documents(spark, tmp_path):
    posts = [("1", "Battery", "a", 10), ("2", "other", "a", 20), ("3", "hello", "b", 30), ("1", "Battery again", "a", 40), ("4", "late battery", "a", 99)]
    raw = spark.createDataFrame([(i, t, "", s, "u", float(c), None, None, None, n) for n, (i, t, s, c) in enumerate(posts)], "id string, title string, selftext string, subreddit string, author string, created_utc double, permalink string, full_link string, url string, arrival long")
    docs = jobs.grid_documents(raw, ["a", "b"], ["battery", "again"], start=0, end=50).collect()
    assert sorted((d.external_id, d.title) for d in docs) == [("1", "Battery"), ("3", "hello")]


def test_clean_answers(spark):
    rows = spark.createDataFrame(
        [("q", "", [" a ", "", "b"], None, None, [1, 2], [2, 9, 1, 2]), ("q", "x", [], [], [], [1], [1]), (" ", "x", [], [], [], [1, 2], [1])],
        "question string, answer string, key_points array<string>, caveats array<string>, contradictions array<string>, evidence_ids array<bigint>, cited_evidence_ids array<bigint>")
    a, b, c = answers.clean_answers(rows).collect()
    assert a.key_points == ["a", "b"] and a.cited_evidence_ids == [2, 1, 2] and a.answer.endswith("No grounded answer available.")
    assert b.insufficient_evidence and b.caveats == ["Insufficient evidence in selected filters."] and b.cited_evidence_ids == []
    assert c.caveats == ["Question is empty."]


def test_streamed_landing_folder(spark, store, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    def land(name, *ids):
        (folder / name).write_text("".join(json.dumps({"id": i, "title": f"watch {i}", "created_utc": 1709287200}) + "\n" for i in ids))
    def take_in():
        query = ingest_new_files(store, "reddit", str(folder), schemas.SUBMISSION, normalize.submissions, clock=Clock(), name=f"posts-{tmp_path.name}", taxonomy=TAXONOMY)
        query.awaitTermination(120)
        assert query.exception() is None
        return sorted(r.external_id for r in store.read("documents").collect())
    land("1.json", "a", "b")
    assert take_in() == ["a", "b"]
    land("2.json", "b", "c")
    assert take_in() == ["a", "b", "c"]
    assert store.read("document_tags").count() == 3


def test_stream_state_and_index(spark, store, tmp_path, monkeypatch):
    """Repeats of earlier batches are dropped by state, changed ones by the store; documents are found by the index."""
    from voxlake.operators import fulltext
    from voxlake.streaming import landing as stream

    folder, index, taken = tmp_path / "landing", str(tmp_path / "index"), []
    folder.mkdir()

    def land(name, *records):
        (folder / name).write_text("".join(json.dumps({"created_utc": 1709287200, **r}) + "\n" for r in records))

    def counted(own, docs, *args, **options):
        taken.append(sorted(((r.external_id, r.title) for r in docs.collect()), key=str))
        return insert_documents(own, docs, *args, **options)

    monkeypatch.setattr(stream, "insert_documents", counted)

    def take_in():
        query = stream.ingest_new_files(
            store, "reddit", str(folder), schemas.SUBMISSION, normalize.submissions, clock=Clock(), name=f"state-{tmp_path.name}",
            taxonomy=TAXONOMY, index_path=index, identity=("id", "title"), delay="1 day", merge_every=1)
        query.awaitTermination(180)
        assert query.exception() is None

    a, b, c = ({"id": i, "title": f"watch {i}"} for i in "abc")
    land("1.json", a, {**a, "title": "again"}, b, {"title": "no id"})
    take_in()
    assert taken[-1] == [("a", "again"), ("a", "watch a"), ("b", "watch b"), (None, "no id")]  # one batch, unchanged
    land("2.json", b, c, {**a, "title": "changed"}, c)
    take_in()
    assert taken[-1] == [("a", "changed"), ("c", "watch c"), ("c", "watch c")]
    rows = store.read("documents").orderBy("id").collect()
    assert [(r.external_id, r.title) for r in rows] == [("a", "watch a"), ("b", "watch b"), (None, "no id"), ("c", "watch c")]
    found = fulltext.score_index(fulltext.read_index(spark, index), fulltext.match_all("watch")).collect()
    assert sorted(r.id for r in found) == [1, 2, 4]


def test_documents_by_themselves_are_cleaned_stored_and_tagged(spark, store, tmp_path):
    from voxlake.operators import fulltext

    index = str(tmp_path / "index")
    taxonomy = Taxonomy.of({"issues": ["battery"]})
    docs = canonical(spark, [(1, "a", None, " Low  battery", "x\n\n y "), (2, "b", None, None, " [deleted] "), (3, "a", None, "again", "battery")])
    docs = docs.withColumn("url", F.lit("HTTPS://Example.com/a/?utm_source=x"))
    assert jobs.ingest_documents(store, docs, "reddit", now=NOW, taxonomy=taxonomy, index_path=index) == 2
    assert jobs.ingest_documents(store, docs, "reddit", now=NOW, taxonomy=taxonomy, index_path=index) == 0
    rows = store.read("documents").orderBy("id").collect()
    assert [(r.external_id, r.title, r.body) for r in rows] == [("a", "Low battery", "x y"), ("b", "", "")]
    assert json.loads(rows[0].raw_json)["ingestion_ts"] == dates_iso(NOW)
    assert [(r.document_id, r.tag_value) for r in store.read("document_tags").collect()] == [(1, "battery")]
    hits = fulltext.score_index(fulltext.read_index(spark, index), fulltext.match_all("battery"))
    assert [r.id for r in hits.collect()] == [1]
    assert store.read("ingestion_runs").isEmpty()


def dates_iso(at):
    return at.strftime("%Y-%m-%dT%H:%M:%S+00:00")
