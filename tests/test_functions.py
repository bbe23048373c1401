from datetime import datetime

from pyspark.sql import functions as F

from voxlake.functions import dates, keys, labels, text, urls


def test_white_space_and_deleted_content(values):
    given = [None, "", "  a \n\t b  ", "a  b\x1fc", " [Deleted] ", "REMOVED", "n/a", "NA", "deleted text"]
    assert values(lambda X: text.clean_whitespace(X), given)[:4] == ["", "", "a b", "a b c"]
    assert values(lambda X: text.is_deleted(X), given) == [True, True, False, False, True, True, True, True, False]
    assert values(lambda X: text.tagging_text(X), given)[-2:] == ["", "deleted text"]


def test_tokens_fold_case_and_accents(values):
    given = ["Crème brûlée, ÉTÉ-2024!", "naïve_words", "", None, "日本語 テスト"]
    expected = [["creme", "brulee", "ete", "2024"], ["naive", "words"], [], [], ["日本語", "テスト"]]
    assert values(lambda X: text.tokens(X), given) == expected
    assert [text.fold(t or "") for t in given] == expected


def test_feed_text_unescapes_every_entity(values):
    assert values(lambda X: text.feed_text(X), ["<p>a&#32;&amp;lt; b</p>&nbsp;&hellip;", None]) == ["a &lt; b …", ""]


def test_keyword_hits_and_lists(values, spark):
    assert values(lambda X: text.keyword_hits(X, ["bug", "crash"]), ["Bug after CRASH", "none", None]) == [2, 0, 0]
    assert text.normalize_keywords([" A ", "", None, "b"]) == ["a", "b"]
    row = spark.range(1).select(text.keyword_array(F.array(F.lit(" A "), F.lit(" "))).alias("v")).first()
    assert row.v == ["a"]


def test_prepared_text(spark):
    df = spark.createDataFrame([("T ", " body"), (None, "b"), (" ", None)], "t string, b string")
    got = [r.v for r in df.select(text.prepared_text(F.col("t"), F.col("b")).alias("v")).collect()]
    assert got == ["T\n\nbody", "b", ""]


def test_normalize_url(values):
    given = [
        "HTTPS://WWW.Example.com/A?utm_source=x&b=2&FBCLID=1&a=#frag", "https://e.com/?q=a+b%20c&d", "https://e.com/p;v=1?x=~*%zz",
        "", None, "not a url", "https://e.com/a?utm_medium=1",
    ]
    assert values(lambda X: urls.normalize_url(X), given) == [
        "https://www.example.com/A?b=2&a=", "https://e.com/?q=a+b+c&d=", "https://e.com/p;v=1?x=~%2A%25zz",
        "", "", "not a url", "https://e.com/a",
    ]


def test_canonical_url_and_domain(values):
    given = ["HTTPS://User@Example.com:443/a/b//?q=1#f", "http://e.com:8080", "http://e.com/x;p", "/relative", None, "http://e.com:0/"]
    assert values(lambda X: urls.canonical_url(X), given) == [
        "https://example.com/a/b", "http://e.com:8080/", "http://e.com/x", None, None, "http://e.com/",
    ]
    assert values(lambda X: urls.domain(X), ["https://WWW.a.com:81/x", "mailto:x", None]) == ["a.com:81", None, None]
    assert values(lambda X: urls.site_homepage(X), [" g2.com ", "http://a.b/c"]) == ["https://g2.com", "http://a.b"]


def test_article_shape(values):
    given = ["https://a.b/review/x", "https://a.b/2024/x", "https://a.b/x/a-b-c-d", "https://a.b/x/a-b", "https://a.b/reviews", "https://a.b"]
    assert values(lambda X: urls.looks_like_article(X), given) == [True, True, True, False, False, False]


def test_permalink_and_last_part(values):
    given = ["https://www.reddit.com/r/a/1", "https://x.com/reddit.comments", "https://x.com"]
    assert values(lambda X: urls.permalink(X), given) == ["/r/a/1", "ments", None]
    assert values(lambda X: urls.last_part(X), ["a/b/c", "c"]) == ["c", "c"]


def test_dates(values):
    given = ["2026-03-15T23:30:00-05:00", "2026-03-15T10:00:00Z", "2026-03-15", "1700000000", "soon", "", None, "1e300"]
    got = values(lambda X: dates.flexible_timestamp(X), given)
    assert got[:4] == [datetime(2026, 3, 16, 4, 30), datetime(2026, 3, 15, 10), datetime(2026, 3, 15), datetime(2023, 11, 14, 22, 13, 20)]
    assert got[4:] == [None] * 4
    feed = ["Mon, 02 Jan 2006 15:04:05 -0700", "Tue, 3 Jan 2006 15:04:05 GMT", "2006-01-02T15:04:05Z", "x"]
    assert values(lambda X: dates.feed_timestamp(X), feed) == [
        datetime(2006, 1, 2, 22, 4, 5), datetime(2006, 1, 3, 15, 4, 5), datetime(2006, 1, 2, 15, 4, 5), None]
    assert values(lambda X: dates.iso_text(dates.iso_timestamp(X)), ["2024-01-02T03:04:05.6Z", "2024-01-02"]) == [
        "2024-01-02T03:04:05.600000+00:00", "2024-01-02T00:00:00+00:00"]


def test_labels(values, spark):
    assert values(lambda X: labels.sentiment_label(X), [" Mixed ", "angry", None, ""]) == ["mixed", "neutral", "neutral", "neutral"]
    assert values(lambda X: labels.issue_category(X), ["UX", "sync", None]) == ["ux", "other", "other"]
    assert values(lambda X: labels.star_rating(X), ["4.9", "5", "0.5", "6", "x", None, "NaN"]) == [4, 5, None, None, None, None, None]
    assert values(lambda X: labels.severity(X), ["negative", "mixed", "neutral", "positive", "odd", None]) == [3, 2, 1, 0, 1, 1]
    names = [["  Acme", "acme", "", "Beta "], None, [str(i) for i in range(30)]]
    got = values(lambda X: labels.competitor_list(X), names, "array<string>")
    assert got == [["Acme", "Beta"], [], [str(i) for i in range(30)]]
    few = values(lambda X: labels.competitor_list(X, 20), names, "array<string>")
    assert few[2] == [str(i) for i in range(20)]
    rows = spark.createDataFrame(
        [("bad", 5), ("good", 2), ("bad", 3), ("great", None), ("a crash, great", None), ("plain", None), (None, None)],
        "t string, r int")
    assert [r.v for r in rows.select(labels.rule_sentiment(F.col("t"), F.col("r")).alias("v")).collect()] == [
        "positive", "negative", "negative", "positive", "negative", "neutral", "neutral"]
    assert values(lambda X: labels.json_flag(X, "$.f"), ['{"f":true}', '{"f":1}', '{"f":false}', "{}", None]) == [True, True, False, False, False]


def test_dedupe_keys(values):
    import hashlib

    key = lambda X: keys.fallback_key(F.lit(" Reddit "), F.lit(""), app_id=F.lit("App"), author=F.lit(None), created_at=F.lit("2024"), text=X)
    long = "Ab  c" + "x" * 300
    payload = "|".join(["reddit", "app", "", "2024", " ".join(long.split()).lower()])
    assert values(key, [long]) == ["reddit:fallback:" + hashlib.sha256(payload.encode()).hexdigest()]
    known = lambda X: keys.fallback_key(F.lit("reddit"), F.lit("id1"), app_id=None, author=None, created_at=None, text=X)
    assert values(known, ["x"]) == [None]
    a, b = values(lambda X: keys.web_key(F.concat(F.lit("https://E.com/a/?q="), X), F.lit(" Title"), F.lit("Body")), ["1", "2"])
    assert a == b and a.startswith("web_reviews:canonical:")
