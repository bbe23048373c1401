import random

import pytest
from pyspark.sql import functions as F

from voxlake.functions.html import read_article, read_links
from voxlake.operators import normalize, pages

ARTICLE = """<html><head><title>Plain title</title><meta property="og:title" content="  Best  watch "/>
<meta name="author" content="Ann Lee"><meta property="article:published_time" content="2024-05-01T10:00:00Z"></head>
<body><header><p>Site header<br></p></header><nav><ul><li>Menu</ul></nav><div class="newsletter-box"><p>Join</p></div>
<article><h1>Head</h1><p>First &amp; best.</p><div>Loose text</div><script>var a="</p>";</script></article>
<div>outside</div><p>After</p><footer>(c)</footer></body></html>"""


def test_article_fields():
    title, author, published, content = read_article(ARTICLE)
    assert (title, author, published) == ("Best watch", "Ann Lee", "2024-05-01T10:00:00Z")
    assert content == "Head First & best. Loose text After"


@pytest.mark.parametrize("html,content", [
    ("<p>a<p>b", "a b"), ("<div>a</div>", ""), ('<div class="post-body">a</div>', "a"), ('<div role="main">a</div>', "a"),
    ('<nav><br><img>x</nav><p>y</p>', "y"), ("<aside><p>x</aside><li>y</li>", "y"), ("", ""), (None, ""), ('<div id="cookie"><article>x</article></div>', ""),
])
def test_content_rules(html, content):
    assert read_article(html)[3] == content


def test_links():
    html = '<a href="/a#x" title="T"> one <b>two</b></a><a href="mailto:x">m</a><a>none</a><a href="https://o.com/b">o</a><a href="c">rel'
    assert read_links("https://e.com/d/", html) == [("https://e.com/a", "T one two"), ("https://o.com/b", "o")]


def test_articles(spark):
    rows = [(1, "https://www.e.com/review/x", ARTICLE), (2, "https://e.com/tag/x", ARTICLE), (3, "https://e.com/x", "<p>short</p>")]
    found = pages.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string"))
    docs = normalize.articles(found, min_content_chars=10).collect()
    assert [(d.external_id, d.community_or_channel, d.title, d.author, str(d.created_at)) for d in docs] == [
        ("https://www.e.com/review/x", "e.com", "Best watch", "Ann Lee", "2024-05-01 10:00:00")]
    explicit = found.where("page_id = 3").withColumns({"title": F.lit("Own"), "content": F.lit("own content is long enough"), "date": F.lit("2024-01-02")})
    d = normalize.articles(explicit, min_content_chars=10).first()
    assert (d.title, d.content, str(d.created_at)) == ("Own", "own content is long enough", "2024-01-02 00:00:00")


def test_keyword_order_with_breadth(spark):
    html = "".join(f'<a href="/review/{n}">{t}</a>' for n, t in (
        ("plain", "other"), ("one", "battery life"), ("two-battery", "battery crash"), ("plain2", "x"), ("one", "again"), ("three", "crash")))
    html += '<a href="https://other.com/review/z">battery</a><a href="/home">battery</a>'
    site = spark.createDataFrame([(1, "https://e.com/", html)], "page_id long, url string, html string")
    scored = pages.score_links(pages.candidate_links(pages.page_links(site, ["Battery", "crash"])), ["Battery", "crash"])
    scores = {r.link.rsplit("/", 1)[1]: r.score for r in scored.collect()}
    assert scores == {"plain": 6, "one": 12, "two-battery": 19, "plain2": 6, "three": 12}
    assert [r.place for r in pages.first_links(scored, per_site=2).collect()] == [1, 2]
    none = pages.score_links(pages.candidate_links(pages.page_links(site)))
    assert {r.score for r in none.collect()} == {0}


def interleaved(scores):
    ranked = sorted((i for i, s in enumerate(scores) if s > 0), key=lambda i: -scores[i])
    broad = [i for i, s in enumerate(scores) if s <= 0]
    out = []
    while ranked:
        out, ranked = out + ranked[:3], ranked[3:]
        out, broad = out + broad[:1], broad[1:]
    return out + broad


def test_interleave_against_simulation(spark):
    rng = random.Random(11)
    sites = {f"s{k}": [rng.choice([0, 0, 3, 6, 9]) for _ in range(rng.randint(0, 30))] for k in range(40)}
    rows = [(s, 1, i, score) for s, scores in sites.items() for i, score in enumerate(scores)]
    df = spark.createDataFrame(rows, "site string, page_id long, position int, score long")
    for cap in (7, 1000):
        got = {}
        for r in pages.ranked_links(df, per_site=cap).orderBy("site", "place").collect():
            got.setdefault(r.site, []).append((r.place, r.position))
        for s, scores in sites.items():
            assert got.get(s, []) == list(enumerate(interleaved(scores), 1))[:cap]
