import random
import re
import sqlite3

import pyarrow as pa
import pytest

from voxlake.operators import fulltext as ft
from voxlake.operators.filters import Corpus
from voxlake.plans.answers import retrieve
from voxlake.plans.explore import documents_by_ids, result_table, search_documents

WORDS = ["battery", "crash", "refund", "screen", "café", "slow", "the", "watch", "batteries", "Crash"]
SCHEMA = ("id long, source_id long, external_id string, title string, body string, author string, url string, "
          "published_at timestamp, raw_json string, created_at timestamp, subreddit string, rating long")


def make_rows(n=60, seed=3):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, k)))
    return [(i, text(4), text(25)) for i in range(1, n + 1)]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def corpus(spark, rows):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    data = [(i, 1 + i % 2, str(i), t, b, "a", "u", t0 + timedelta(days=i % 10) if i % 7 else None, "{}", t0, "s", 1) for i, t, b in rows]
    docs = spark.createDataFrame(data, SCHEMA).cache()
    sources = spark.createDataFrame([(1, "reddit", "reddit"), (2, "google_play", "google_play")], "id long, platform string, name string")
    return Corpus(docs, sources)


@pytest.fixture(scope="module")
def fts5(rows):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(title, content, review_text)")
    except sqlite3.OperationalError:
        pytest.skip("this sqlite3 has no FTS5")
    con.executemany("INSERT INTO f(rowid, title, content, review_text) VALUES (?, ?, ?, ?)", [(i, t, b, b) for i, t, b in rows])
    return con


CASES = [
    ("battery crash", ft.match_all("battery crash")),
    ("battery OR refund", ft.match_any("battery refund")),
    ("battery NOT crash", ft.match_all("battery") & ft.match_none("crash")),
    ('"the watch"', ft.match_phrase("the watch")),
    ('"slow the" OR screen', ft.Match(optional=(ft.Unit(("slow", "the")), ft.Unit(("screen",))))),
    ("batter*", ft.match_prefix("batter")),
    ('"the batter" *', ft.match_prefix("the batter")),
    ("title : crash", ft.match_all("crash", "title")),
    ("content : crash", ft.match_all("crash", "content")),
    ("review_text : (crash OR slow)", ft.match_any("crash slow", "review_text")),
    ("cafe", ft.match_all("CAFÉ")),
]


@pytest.mark.parametrize("sql,match", CASES, ids=[c[0] for c in CASES])
def test_same_hits_and_scores_as_the_stock_index(corpus, fts5, spark, sql, match):
    want = dict(fts5.execute("SELECT rowid, bm25(f, 1.5, 1.0, 0.8) FROM f WHERE f MATCH ?", (sql,)).fetchall())
    assert want
    texts = {r.id: r.fts_score for r in ft.score_texts(corpus.documents, corpus.documents, match).collect()}
    index = {r.id: r.fts_score for r in ft.score_index(ft.build_index(corpus.documents), match).collect()}
    for got in (texts, index):
        assert got.keys() == want.keys()
        assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_written_index_is_the_same(corpus, spark, tmp_path):
    ft.write_index(ft.build_index(corpus.documents), str(tmp_path / "ix"))
    index = ft.read_index(spark, str(tmp_path / "ix"))
    match = ft.match_all("battery crash")
    a = search_documents(corpus, match, limit=10).select("id", "fts_score").collect()
    b = search_documents(corpus, match, limit=10, index=index).select("id", "fts_score").collect()
    assert [r.id for r in a] == [r.id for r in b] and a
    plan = ft._needed(index.postings, match)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_filters_narrow_the_ranking_only(corpus):
    whole = {r.id: r.fts_score for r in search_documents(corpus, "battery", limit=200).collect()}
    some = search_documents(corpus, "battery", {"sources": ["reddit"], "date_from": "2024-01-03"}, limit=200).collect()
    assert some and all(r.source_id == 1 and r.published_at is not None for r in some)
    assert all(whole[r.id] == r.fts_score for r in some)


def test_order_paging_and_limits(corpus):
    everything = search_documents(corpus, "the", limit=500).collect()
    key = [(r.fts_score, -(r.published_at or r.created_at).timestamp(), -r.id) for r in everything]
    assert key == sorted(key)
    page = search_documents(corpus, "the", limit=5, offset=5).collect()
    assert [r.id for r in page] == [r.id for r in everything[5:10]]
    assert len(search_documents(corpus, "the", limit=0).collect()) == 1


@pytest.mark.parametrize("query", ["the", "battery crash", ""])
def test_pages_go_on_behind_the_last_row(corpus, query):
    """Page by page from the last row seen, with undated documents and equal times: the same rows as by offsets."""
    everything = [r.id for r in search_documents(corpus, query, limit=500).collect()]
    seen, place = [], None
    while rows := search_documents(corpus, query, limit=7, after=place).collect():
        seen += [r.id for r in rows]
        place = ft.place_of(rows[-1])
    assert seen == everything and len(seen) > 14


@pytest.mark.parametrize("query", ["", "   ", "*", None, '"*"'])
def test_no_words_means_browsing(corpus, query):
    rows = search_documents(corpus, query, limit=4).collect()
    times = [r.published_at or r.created_at for r in rows]
    assert len(rows) == 4 and times == sorted(times, reverse=True) and all(r.fts_score is None for r in rows)


def test_unknown_words_match_nothing(corpus):
    assert search_documents(corpus, "nothing here?").collect() == []


def test_question_retrieval_keeps_the_limit_asked_for(corpus):
    found = search_documents(corpus, "the", limit=1000).count()
    assert found > 25 and retrieve(corpus, "the", top_n=found).count() == found
    assert retrieve(corpus, "the", top_n=3).count() == 3


def test_ids_keep_their_order(corpus, spark):
    got = documents_by_ids(corpus.documents, [9, 3, 9, 1000, 1]).collect()
    assert [r.id for r in got] == [9, 3, 1]


def test_result_table(corpus, tmp_path, spark):
    from voxlake.sources.tables import export_csv

    table = result_table(search_documents(corpus, "the", limit=3))
    assert table.columns == ["id", "published_at", "title", "author", "source_url", "score"]
    export_csv(table, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == table.columns


def test_index_grows_with_inserts_and_prunes_buckets(spark, store, tmp_path):
    from datetime import datetime, timezone

    from test_jobs import canonical

    now, path = datetime(2024, 3, 10, tzinfo=timezone.utc), str(tmp_path / "grown")
    from voxlake.operators.store import ensure_source, insert_documents

    source = ensure_source(store, "reddit", now=now)
    first = canonical(spark, [(1, "a", None, "Škoda battery", "the battery life"), (2, "b", None, "x", "nothing")])
    assert insert_documents(store, first, source, now=now, index_path=path) == 2
    more = canonical(spark, [(3, "c", None, "bat", "décomposé été batteries"), (1, "a", None, "again", "battery")])
    assert insert_documents(store, more, source, now=now, index_path=path) == 1
    index = ft.read_index(spark, path)
    assert index.corpus.first()["n_docs"] == 3

    def ids(match, own=index):
        return sorted(r["id"] for r in ft.score_index(own, match).collect())

    assert ids(ft.match_all("skoda")) == [1] and ids(ft.match_all("ete")) == [3]
    assert ids(ft.match_prefix("batter")) == [1, 3] and ids(ft.match_prefix("b")) == [1, 3]
    whole = ft.build_index(store.read("documents"))
    for match in (ft.match_any("battery nothing"), ft.match_prefix("bat"), ft.match_phrase("battery life")):
        assert sorted(map(tuple, ft.score_index(index, match).collect())) == sorted(map(tuple, ft.score_index(whole, match).collect()))
    plan = ft._needed(index.postings, ft.match_prefix("batter"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    ft.write_index(whole, path)
    assert ids(ft.match_all("skoda"), ft.read_index(spark, path)) == [1]


def test_postings_of_odd_texts_in_small_batches(spark, monkeypatch):
    """Made in Arrow batches, cut where a batch has many words; ids may be null or come twice, texts may be null or empty."""
    from voxlake.functions.text import fold

    rows = [(i, None if i % 5 == 0 else f"É{i % 3} the", " ".join(["the", "Café", f"w{i % 4}", "the"] * (i % 6))) for i in range(40)]
    rows += [(None, "the", None), (7, "the the", "x"), (7, "the the", "x"), (8, "", " "), (9, "\U00010428\U00010428b", "½ 三三")]
    docs = spark.createDataFrame(rows, "id long, title string, body string").coalesce(1)
    want = []
    for doc, *texts in rows:
        for in_title, text in zip((True, False), texts, strict=True):
            words = fold(text or "")
            want += [(ft.bucket_of(w), w, doc, in_title, words.count(w), [i for i, x in enumerate(words) if x == w])
                     for w in dict.fromkeys(words)]
    index = ft.build_index(docs)
    plan = index.postings._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "array_sort" not in plan
    columns = [c.split()[0] for c in ft.POSTINGS.split(", ")]
    got = [tuple(r) for r in index.postings.select(*columns).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    held = [[d, *(None if t is None or not t.isascii() else t.lower() for t in texts),
             *(None if t is not None and t.isascii() else fold(t or "") for t in texts)] for d, *texts in rows]
    cut = pa.table([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (
        pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())), strict=True)],
        names=["doc_id", "title", "body", "title_words", "body_words"])
    monkeypatch.setattr(ft, "BATCH_BYTES", 100)
    parts = list(ft._postings(iter([*cut.to_batches(), *cut.slice(0, 0).to_batches()])))
    again = [tuple(r[c] for c in columns) for p in parts for r in p.to_pylist()]
    assert len(parts) > 3 and sorted(again, key=str) == sorted(want, key=str)


def test_a_written_part_reads_each_text_once_for_postings(spark, monkeypatch, tmp_path):
    """Nothing is sampled before the write; lengths come from Arrow batches and equal the number of words, the body twice."""
    from voxlake.functions.text import fold

    rows = [(i, None if i % 5 == 0 else f"É{i % 3} the-", " ".join(["the", "Café", f"-w{i % 4}", "the."] * (i % 6))) for i in range(40)]
    rows += [(None, "the", None), (40, "", " "), (41, "\U00010428\U00010428b", "½ 三三"), (42, "x", "x"), (43, "-", "_")]
    docs = spark.createDataFrame(rows, "id long, title string, body string").repartition(4)
    seen, postings = tmp_path / "seen", ft._postings
    seen.mkdir()

    def counted(parts):
        import uuid

        for part in parts:
            (seen / uuid.uuid4().hex).write_text(" ".join(map(str, part.column("doc_id").to_pylist())))
            yield from postings(iter([part]))

    monkeypatch.setattr(ft, "_postings", counted)
    ft.write_index(ft.build_index(docs), str(tmp_path / "once"))
    assert sorted(w for f in seen.iterdir() for w in f.read_text().split()) == sorted(str(r[0]) for r in rows)
    index = ft.read_index(spark, str(tmp_path / "once"))
    want = [(d, len(fold(t or "")) + 2 * len(fold(b or ""))) for d, t, b in rows]
    assert sorted(map(tuple, index.doc_stats.collect()), key=str) == sorted(want, key=str)
    n = sum(len(set(fold(t or ""))) + len(set(fold(b or ""))) for _, t, b in rows)
    assert index.postings.count() == n


def _counted(docs, seen):
    """The same documents; a file in `seen` for each batch that is read of them."""
    seen.mkdir()

    def noted(parts):
        import uuid

        for part in parts:
            (seen / uuid.uuid4().hex).write_text(" ".join(map(str, part.column("id").to_pylist())))
            yield part

    return docs.mapInArrow(noted, docs.schema)


def _read(seen):
    return sorted(w for f in seen.iterdir() for w in f.read_text().split())


ODD = [(i, None if i % 5 == 0 else f"É{i % 3} the-", " ".join(["the", "Café", f"-w{i % 4}", "the."] * (i % 6))) for i in range(40)]
ODD += [(None, "the", None), (7, "the w1", "x"), (40, "", " "), (41, "\U00010428\U00010428b", "½ 三三"), (42, None, None), (43, "-", "_")]


def test_a_written_part_reads_each_text_once_for_all_it_holds(spark, tmp_path):
    """Lengths come out of the pass that makes the postings, and are not among these when they are read."""
    from voxlake.functions.text import fold

    docs = spark.createDataFrame(ODD, "id long, title string, body string").repartition(4)
    path = str(tmp_path / "index")
    ft.write_index(ft.build_index(_counted(docs, tmp_path / "seen")), path)
    assert _read(tmp_path / "seen") == sorted(str(r[0]) for r in ODD)
    index = ft.read_index(spark, path)
    want = [(d, len(fold(t or "")) + 2 * len(fold(b or ""))) for d, t, b in ODD]
    assert sorted(map(tuple, index.doc_stats.collect()), key=str) == sorted(want, key=str)
    assert index.corpus.first()["total_length"] == sum(n for _, n in want)
    assert index.postings.where("bucket < 0 or coalesce(term, '') = ''").count() == 0
    assert index.postings.count() == sum(len(set(fold(t or ""))) + len(set(fold(b or ""))) for _, t, b in ODD)
    empty = str(tmp_path / "empty")
    ft.write_index(ft.build_index(docs.where("id < 0")), empty)
    assert ft.read_index(spark, empty).corpus.first()["n_docs"] == 0
    assert ft.score_index(ft.read_index(spark, empty), ft.match_all("the")).collect() == []


@pytest.mark.parametrize("match", [ft.match_any("the w1") & ft.match_none("w2"), ft.match_prefix("w"), ft.match_phrase("the cafe")])
def test_a_search_without_a_written_index_reads_each_text_once(spark, tmp_path, match):
    """Hits, found documents, lengths and corpus figures are of one pass; the scores are those of a written index."""
    docs = spark.createDataFrame(ODD, "id long, title string, body string").repartition(4)
    got = ft.score_index(ft.build_index(_counted(docs, tmp_path / "seen")), match).collect()
    assert _read(tmp_path / "seen") == sorted(str(r[0]) for r in ODD)
    ft.write_index(ft.build_index(docs), str(tmp_path / "index"))
    want = ft.score_index(ft.read_index(spark, str(tmp_path / "index")), match).collect()
    assert got and sorted((r.id, round(r.fts_score, 9)) for r in got) == sorted((r.id, round(r.fts_score, 9)) for r in want)
