import random
from datetime import datetime, timedelta

import pytest

from test_fulltext import SCHEMA
from voxlake.operators import fulltext as ft, topk
from voxlake.operators.filters import Corpus
from voxlake.plans.explore import search_documents

WORDS = [f"w{i}" for i in range(12)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Word i is in about every (i + 1)-th place; some documents are equal, some are long."""
    rng = random.Random(7)
    t0 = datetime(2024, 1, 1)

    def text(k):
        return " ".join(rng.choices(WORDS, [1 / (i + 1) for i in range(12)], k=rng.randint(1, k)))

    rows = [(i, 1 + i % 2, str(i), text(4), text(rng.choice([8, 40, 200])), "a", "u",
             t0 + timedelta(days=i % 10) if i % 7 else None, "{}", t0, "s", 1) for i in range(1, 601)]
    rows += [(1000 + i, 1, str(i), "w11 w3", "w11 w5 w5", "a", "u", t0, "{}", t0, "s", 1) for i in range(30)]
    out = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{out}/documents")
    docs = spark.read.parquet(f"{out}/documents")
    sources = spark.createDataFrame([(1, "reddit", "reddit"), (2, "google_play", "google_play")], "id long, platform string, name string")
    return Corpus(docs, sources)


@pytest.fixture(scope="module")
def path(spark, corpus, tmp_path_factory):
    """Two parts with tiers and one without."""
    out = str(tmp_path_factory.mktemp("tiers"))
    for i in range(3):
        ft.write_index(ft.build_index(corpus.documents.where(f"id % 3 = {i}")), out, append=True)
        if i < 2:
            assert len(topk.add_impacts(spark, out)) == 1
    return out


@pytest.fixture(scope="module")
def whole(spark, corpus, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("whole"))
    ft.write_index(ft.build_index(corpus.documents), out)
    return ft.read_index(spark, out)


def _page(rows):
    return [(r.id, None if r.fts_score is None else round(r.fts_score, 9)) for r in rows.collect()]


MATCHES = [
    ft.match_all("w0"), ft.match_all("w11"), ft.match_all("w2 w9"), ft.match_any("w3 w10 w11"), ft.match_all("w4") & ft.match_none("w1"),
    ft.match_any("w0 w11") & ft.match_none("w2"), ft.match_all("w1") & ft.match_any("w8 w9"), ft.match_any("w5 unknown"), ft.match_all("unknown"),
]


@pytest.mark.parametrize("n, match", list(enumerate(MATCHES)))
def test_pages_equal_those_of_the_whole_index(corpus, path, whole, n, match):
    limit, offset, filters = ((5, 0, {}), (7, 12, {"sources": ["reddit"]}))[n % 2]
    assert _page(search_documents(corpus, match, filters, limit=limit, offset=offset, tiers_path=path)) == _page(
        search_documents(corpus, match, filters, limit=limit, offset=offset, index=whole))


def test_pages_go_on_behind_a_row(corpus, path, whole):
    match, seen, place = ft.match_any("w10 w11"), [], None
    for _ in range(2):
        rows = search_documents(corpus, match, limit=6, after=place, tiers_path=path).collect()
        seen += [r.id for r in rows]
        place = ft.place_of(rows[-1])
    assert seen == [r.id for r in search_documents(corpus, match, limit=12, index=whole).collect()]


def test_what_cannot_reach_the_page_is_not_read(spark, path, whole):
    match = ft.match_any("w3 w7")
    impacts = topk.read_impacts(spark, path, match)
    bounds = topk.bounds_of(impacts, match)
    best = ft.score_index(whole, match).orderBy("fts_score").limit(5).collect()
    cuts = bounds.enough(-best[-1]["fts_score"], ["w3", "w7"], bounds.first(20, ["w3", "w7"]))
    everything = sum(bounds.found.values())
    assert everything == impacts.postings.count()
    assert bounds.n_postings(cuts) < 0.6 * everything
    read = impacts.postings.where(topk._where(["w3", "w7"], cuts, True))
    assert read.count() == bounds.n_postings(cuts)
    # no document behind the cuts could have been on the page
    left = {w: bounds.left(w, cuts[w]) for w in cuts}
    assert 0 < sum(left.values()) < -best[-1]["fts_score"]


def test_bounds_hold_for_every_posting(spark, path, whole):
    for word in ("w0", "w11"):
        match = ft.match_all(word)
        impacts = topk.read_impacts(spark, path, match)
        bounds = topk.bounds_of(impacts, match)
        scores = {r["id"]: -r["fts_score"] for r in ft.score_index(whole, match).collect()}
        tier = {t.tier: t.bound for t in bounds.tiers[word]}
        rows = impacts.postings.collect()
        assert len(rows) == len(scores) and all(scores[r["doc_id"]] <= tier[r["tier"]] for r in rows)


def test_scans_are_pruned_to_buckets_and_tiers(spark, path):
    match = ft.match_all("w3")
    rows = topk.read_impacts(spark, path, match).postings.where(topk._where(["w3"], {"w3": 2}, True))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "LessThanOrEqual(tier,2)" in plan


def test_broken_and_gone_parts(spark, corpus, whole, tmp_path):
    from voxlake.sources import files

    out, match = str(tmp_path / "i"), ft.match_any("w1 w2")
    expected = _page(search_documents(corpus, match, limit=9, index=whole))
    assert search_documents(corpus, match, limit=9, tiers_path=out).collect() == []
    for i in range(2):
        ft.write_index(ft.build_index(corpus.documents.where(f"id % 2 = {i}")), out, append=True)
    parts = topk.add_impacts(spark, out)
    assert len(parts) == 2 and topk.add_impacts(spark, out) == []
    files.delete(spark, f"{out}/impact_stats/part={parts[0]}/_SUCCESS")    # as if the run had ended there
    assert _page(search_documents(corpus, match, limit=9, tiers_path=out)) == expected
    assert topk.add_impacts(spark, out) == parts[:1]
    ft.merge_index(spark, out, fan=2)
    assert _page(search_documents(corpus, match, limit=9, tiers_path=out)) == expected
    assert len(topk.add_impacts(spark, out)) == 1
    assert not set(parts) & {n.removeprefix("part=") for n in files.names(spark, f"{out}/impact_stats")}
    assert _page(search_documents(corpus, match, limit=9, tiers_path=out)) == expected


# Disk ----------------------------------------------------------------------------------------
ODD = [(i, None if i % 5 == 0 else f"\u00c9{i % 3} the w{i % 7}", " ".join(["the", "Caf\u00e9", f"w{i % 4}", "the"] * (i % 6))) for i in range(60)]
ODD += [(None, "the", "the w1"), (7, "the w1", "x"), (7, "the w1", "x"), (8, None, "the"), (60, "", " "), (61, None, None)]


@pytest.fixture
def odd(spark, tmp_path):
    """A part with ids that are null or come more than once, packed in small steps."""
    path = str(tmp_path / "odd")
    ft.write_index(ft.build_index(spark.createDataFrame(ODD, "id long, title string, body string").repartition(3)), path)
    return path


def _rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def test_packed_postings_come_back_as_they_were(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame(ODD, "id long, title string, body string").repartition(3)
    columns = ["bucket", "term", "doc_id", "in_title", "tf", "positions", "f", "dl"]
    want = _rows(ft.build_index(docs).postings, *columns)
    for n_packed, n_unpacked in ((1, 1), (100, 7), (1 << 20, 1 << 14)):
        monkeypatch.setattr(ft, "PACKED_ROWS", n_packed)
        monkeypatch.setattr(ft, "UNPACKED_ROWS", n_unpacked)
        path = str(tmp_path / f"i{n_packed}")
        ft.write_index(ft.build_index(docs), path)
        assert _rows(ft.read_index(spark, path).postings, *columns) == want


def test_tiers_of_a_part_are_those_of_its_summed_postings(spark, odd):
    """Of ids that are null or come twice too, of parts written before rows held weights, and of merged parts of both kinds."""
    columns = [c.split()[0] for c in topk.POSTINGS.split(", ")]
    index = ft.read_index(spark, odd)
    want = _rows(topk._postings(index), *columns)
    assert want and _rows(topk._whole_part(index), *columns) == want
    early = ft.Index(index.postings.select(*[c.split()[0] for c in ft.POSTINGS.split(", ")]), index.doc_stats, index.corpus)
    before = f"{odd}-before"
    ft.write_index(early, before)
    assert _rows(topk._whole_part(ft.read_index(spark, before)), *columns) == want
    ft.write_index(ft.build_index(spark.createDataFrame([(900, "the", "w1 w2")], "id long, title string, body string")), before, append=True)
    ft.commit_parts(spark, before, [ft.stage_part(ft.read_index(spark, before), before, "merged")], None)
    merged = ft.read_index(spark, before)
    assert merged.postings.where("doc_id = 900 AND f > 0").count() == 3
    assert _rows(topk._whole_part(merged), *columns) == _rows(topk._postings(merged), *columns)


def test_figures_of_tiers_that_are_cut_sum_up(spark, odd, monkeypatch):
    monkeypatch.setitem(topk.RUN_CONF, "spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    assert len(topk.add_impacts(spark, odd)) == 1
    match = ft.match_any("the w1 cafe")
    impacts = topk.read_impacts(spark, odd, match)
    assert impacts.stats.count() > impacts.stats.select("term", "tier").distinct().count()
    again = topk.Impacts(impacts.postings, topk._stats(impacts.postings), impacts.n_docs, impacts.total_length)
    assert topk.bounds_of(impacts, match) == topk.bounds_of(again, match)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "512"


def _shuffled(spark):
    """Bytes of shuffle files by name."""
    from pathlib import Path

    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f: f.stat().st_size for d in folders for f in Path(d).rglob("shuffle_*.data")}


def test_index_and_tiers_take_little_disk_besides(spark, tmp_path):
    """Postings are shuffled once, packed, and not for the tiers; what was shuffled goes when it is written."""
    import time

    rng = random.Random(5)
    words = [f"{a}{b}{i}" for a in "abcdefgh" for b in "rst" for i in range(100)]
    rows = [(i, " ".join(rng.choices(words, k=5)), " ".join(rng.choices(words, k=150))) for i in range(2000)]
    docs, path = spark.createDataFrame(rows, "id long, title string, body string").repartition(4), str(tmp_path / "i")
    index = ft.build_index(docs)
    n = index.postings.count()
    assert index.packed.selectExpr("sum(octet_length(rows))").first()[0] < 10 * n
    before = _shuffled(spark)
    ft.write_index(index, path)
    topk.add_impacts(spark, path)
    assert "Exchange" not in topk._whole_part(ft.read_index(spark, path))._jdf.queryExecution().executedPlan().toString()
    for _ in range(40):
        left = sum(size for f, size in _shuffled(spark).items() if f not in before)
        if left < n:
            break
        time.sleep(0.25)
    assert left < n
