import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from voxlake.operators import ingest, normalize
from voxlake.sources import landing

ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>
<entry><id>t3/abc</id><title>Hello</title><updated>2024-03-01T10:00:00+00:00</updated><author><name>/u/ann</name></author>
<category term="galaxy" label="g"/><link rel="self" href="https://x"/><link href="https://www.reddit.com/r/galaxy/abc/"/>
<content type="html">&lt;p&gt;Battery &amp;amp; life&amp;#32;ok&lt;/p&gt;</content></entry>
<entry><id>t3/def</id><title>Only title</title><published>2024-03-02T10:00:00Z</published></entry></feed>"""
RSS = """<rss><channel><title>c</title><item><guid>https://x/g/1/</guid><link>https://www.reddit.com/r/a/1</link><title>T</title>
<description>&lt;b&gt;D&lt;/b&gt;</description><category></category><category>second</category><pubDate>Fri, 01 Mar 2024 10:00:00 +0100</pubDate></item>
<item><link>https://y.com/p/2</link><title>U</title></item></channel></rss>"""


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ATOM)
    (tmp_path / "r.xml").write_text(RSS)
    atom = {r.id: r for r in landing.atom_feed(spark, str(tmp_path / "a.xml")).collect()}
    a = atom["abc"]
    assert (a.selftext, a.subreddit, a.author, a.permalink, a.created_utc) == (
        "Battery & life ok", "galaxy", "/u/ann", "/r/galaxy/abc/", 1709287200.0)
    assert atom["def"].selftext == "Only title" and atom["def"].full_link is None and atom["def"].created_utc == 1709373600.0
    rss = {r.id: r for r in landing.rss_feed(spark, str(tmp_path / "r.xml")).collect()}
    assert (rss["1"].selftext, rss["1"].subreddit, rss["1"].permalink, rss["1"].created_utc) == ("D", "second", "/r/a/1", 1709283600.0)
    assert rss["2"].selftext == "U" and rss["2"].permalink is None


def test_json_envelopes(spark, tmp_path):
    (tmp_path / "dump.json").write_text(json.dumps({"data": [{"id": "a", "title": "A", "created_utc": 1}, "junk", {"id": "b"}]}) + "\n")
    (tmp_path / "list.json").write_text(json.dumps({"data": {"children": [{"data": {"id": "c"}}, {"kind": "x"}, "odd", {"data": "text"}]}}) + "\n")
    assert [r.id for r in landing.submissions(spark, str(tmp_path / "dump.json")).orderBy("arrival").collect()] == ["a", "b"]
    assert [r.id for r in landing.listings(spark, str(tmp_path / "list.json")).collect()] == ["c"]


def test_submission_and_comment_documents(spark):
    from voxlake import schemas

    subs = spark.createDataFrame([
        ("1", "T", "", "sub", "ann", 1709287200.0, "/p", None, "u"), (None, None, None, None, None, None, None, "https://full", None)], schemas.SUBMISSION)
    a, b = sorted(normalize.submissions(subs).collect(), key=lambda r: r.external_id is None)
    assert (a.content, a.url, a.dedupe_key, str(a.created_at), a.platform_metadata["subreddit"]) == ("T", "https://reddit.com/p", None, "2024-03-01 10:00:00", "sub")
    assert b.url == "https://full" and b.dedupe_key.startswith("reddit:fallback:") and json.loads(a.raw_payload)["id"] == "1"
    coms = spark.createDataFrame([("c1", "hey", "t3_p1", "sub", ("bob",), None, None)], schemas.COMMENT)
    c = normalize.comments(coms).first()
    assert (c.parent_external_id, c.title, c.url, c.author, c.doc_type) == ("p1", None, None, "bob", "comment")
    assert normalize.comments(coms.withColumn("parent_id", F.lit("own"))).first().parent_external_id == "own"


def test_review_documents(spark):
    from voxlake import schemas

    base = dict.fromkeys(f.name for f in schemas.REVIEW.fields)
    rows = [{**base, "app_id": "com.a", "reviewId": "r1", "content": " Good ", "score": 5, "at": datetime(2024, 3, 1), "userName": "u", "thumbsUpCount": 2},
            {**base, "app_id": "com.a", "content": "", "userContent": "alt", "authorName": "v", "timestamp": "1709287200"}]
    df = spark.createDataFrame([tuple(r[f.name] for f in schemas.REVIEW.fields) for r in rows], schemas.REVIEW)
    a, b = sorted(normalize.reviews(df).collect(), key=lambda r: r.external_id is None)
    assert (a.content, a.rating, a.url, a.dedupe_key, a.platform_metadata["thumbs_up_count"]) == (
        "Good", 5, "https://play.google.com/store/apps/details?id=com.a&reviewId=r1", None, "2")
    assert (b.content, b.author, str(b.created_at), b.url) == ("alt", "v", "2024-03-01 10:00:00", "https://play.google.com/store/apps/details?id=com.a")


@pytest.fixture
def posts(spark):
    rows = [("1", "Battery", "dies", "a", 100.0), ("2", "Hi", "all", "a", 200.0), ("3", "x", None, "b", 300.0), ("4", None, "crash", "c", None), ("5", "y", "z", "b", 50.0)]
    return spark.createDataFrame(rows, "id string, title string, selftext string, subreddit string, created_utc double").withColumn("arrival", F.col("id").cast("long"))


def got(df):
    return sorted(r.id for r in df.select("id").collect())


def test_windows_and_keywords(posts):
    assert got(ingest.in_epoch_window(posts, 100, 250)) == ["1", "2", "4"]
    assert got(ingest.keyword_or_recent(posts, ["battery"], include_recent=True)) == ["1", "3", "4", "5"]
    assert got(ingest.keyword_or_recent(posts, ["battery"], include_recent=False)) == ["1"]
    assert got(ingest.keyword_or_recent(posts, [], include_recent=False)) == ["1", "2", "3", "4", "5"]
    assert got(ingest.newest_per_community(posts, 1)) == ["2", "3", "4"]
    now = F.timestamp_seconds(F.lit(300))
    assert got(ingest.matched_posts(posts, ["battery", "crash"], now=now, days_back=1, order=[F.asc("id")])) == ["1", "4"]
    assert got(ingest.matched_posts(posts, [" "], now=now, days_back=1, order=[F.asc("id")])) == []
    assert got(ingest.matched_posts(posts, ["battery", "x"], now=now, days_back=-3, order=[F.asc("id")])) == ["3"]


def test_grid_diagnostics(spark, posts):
    grid = ingest.query_grid(spark, ["a", "b", " "], ["battery", "zzz", ""])
    assert grid.count() == 4
    hits = ingest.grid_hits(posts, ["battery", "zzz"])
    fallback = spark.createDataFrame([("b", 2)], "subreddit string, hits long")
    d = ingest.fetch_diagnostics(ingest.query_counts(grid, hits), fallback).first()
    assert (d.queries_attempted, d.queries_with_hits, d.search_hits_total, d.subreddits_with_hits, d.new_fallback_hits_total) == (4, 1, 1, 2, 2)
    assert d.failed_or_empty_queries_top5 == ["r/a :: zzz", "r/b :: battery", "r/b :: zzz"]
    blank = ingest.query_grid(spark, ["a"], [])
    counts = ingest.query_counts(blank, ingest.grid_hits(posts, [])).first()
    assert (counts.keyword, counts.hits) == ("", 2)


def test_first_source_with_rows(spark):
    df = lambda n: spark.range(n).select("id")
    rows = ingest.first_with_rows([("a", df(0)), ("b", df(2)), ("c", df(3))]).collect()
    assert [r.backend for r in rows] == ["b", "b"]


def test_caps_come_before_filters(spark):
    rows = [("app", f"r{i}", "bug" if i < 3 else "fine", datetime(2024, 1, 1 + i), None, i) for i in range(6)]
    df = spark.createDataFrame(rows, "app_id string, reviewId string, content string, at timestamp, timestamp string, arrival long").withColumn("userContent", F.lit(None).cast("string"))
    now = F.lit(datetime(2024, 1, 7))
    kept = ingest.newest_reviews(df, ["BUG"], now=now, days_back=30, per_app=4)
    assert [r.reviewId for r in kept.collect()] == ["r2"]
    assert ingest.newest_reviews(df, [], now=now, days_back=2, per_app=10).count() == 2
