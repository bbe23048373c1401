"""Inserts that break off, and an index that is merged over time."""

import shutil

import pytest
from pyspark.sql import functions as F

from test_jobs import NOW, TAXONOMY, canonical
from voxlake.operators import enrich, fulltext as ft, keyfilter, rollup, store as ops
from voxlake.operators.filters import Filters
from voxlake.plans import dashboard, insights, jobs, rollups
from voxlake.sources import files
from voxlake.sources.tables import Store


def _docs(spark, first=0, n=6):
    words = ["battery", "watch", "crash", "the"]
    return canonical(spark, [(i, f"e{i}", None, f"{words[i % 4]} title {i}", f"{words[(i + 1) % 4]} body {i} battery") for i in range(first, first + n)])


def _state(spark, store, index):
    rows = {t: sorted(map(tuple, store.read(t).collect()), key=str) for t in ("documents", "document_tags")}
    read = ft.read_index(spark, index)
    rows["postings"] = sorted(map(str, read.postings.collect()))
    rows["lengths"] = sorted(map(tuple, read.doc_stats.collect()))
    rows["corpus"] = tuple(read.corpus.first())
    counts = rollup.read_rollup(spark, ops.rollup_path(store))
    rows["counts"] = sorted(map(tuple, counts.groupBy(*rollup.DIMENSIONS).agg(F.sum("n")).collect()), key=str)
    rows["filters"] = [p["rows"] for p in ft.manifest(spark, ops.filter_path(store))["parts"]]
    return rows


def _insert(store, docs, index):
    source = ops.ensure_source(store, "reddit", now=NOW)
    return ops.insert_documents(store, docs, source, now=NOW, taxonomy=TAXONOMY, index_path=index)


@pytest.fixture(scope="module")
def first(spark, tmp_path_factory):
    """A folder with a store and its index after one insert, and what they hold."""
    folder = tmp_path_factory.mktemp("first")
    store, index = Store(spark, str(folder / "store")), str(folder / "index")
    assert _insert(store, _docs(spark), index) == 6
    return folder, _state(spark, store, index)


@pytest.fixture(scope="module")
def whole(spark, first, tmp_path_factory):
    """What they hold after a second insert without a fault."""
    store, index = _copy(spark, first, tmp_path_factory.mktemp("whole"))
    assert _insert(store, _docs(spark, 4, 6), index) == 4
    return _state(spark, store, index)


def _copy(spark, first, folder):
    for name in ("store", "index"):
        shutil.copytree(first[0] / name, folder / name)
    return Store(spark, str(folder / "store")), str(folder / "index")


# each write of an insert: (owner, name, number of the call), broken before it; before the next is after this one
WRITES = [("store", "write", 1), ("store", "write", 2), ("ops", "stage_part", 1), ("files", "write_json", 1), ("files", "move_files", 1),
          ("files", "move_files", 2), ("ops", "commit_parts", 1), ("ops", "commit_parts", 3), ("files", "delete", 1)]


@pytest.mark.parametrize("owner,name,number,after", [*((*w, False) for w in WRITES), ("files", "write_json", 1, True)])
def test_a_rerun_completes_a_broken_insert(spark, tmp_path, monkeypatch, first, whole, owner, name, number, after):
    store, index = _copy(spark, first, tmp_path)
    place = {"store": Store, "ops": ops, "files": files}[owner]
    real, calls = getattr(place, name), []

    def breaking(*args, **options):
        calls.append(1)
        if len(calls) == number and not after:
            raise OSError("broken off")
        out = real(*args, **options)
        if len(calls) == number:
            raise OSError("broken off")
        return out

    with monkeypatch.context() as patched:
        patched.setattr(place, name, breaking)
        with pytest.raises(OSError, match="broken off"):
            _insert(store, _docs(spark, 4, 6), index)
    files.delete(spark, f"{store.root}/_writer")  # a killed run leaves its claim
    decided = (name, after) == ("write_json", True) or name in ("move_files", "commit_parts", "delete")
    if not decided:
        assert _state(spark, store, index) == first[1]
    assert _insert(store, _docs(spark, 4, 6), index) == (0 if decided else 4)
    assert _state(spark, store, index) == whole
    assert files.names(spark, f"{store.root}/_inserts") == []


def test_broken_inserts_can_be_completed_alone(spark, tmp_path, monkeypatch, first, whole):
    store, index = _copy(spark, first, tmp_path)
    with monkeypatch.context() as patched:
        patched.setattr(files, "move_files", lambda *_: (_ for _ in ()).throw(OSError("broken off")))
        with pytest.raises(OSError):
            _insert(store, _docs(spark, 4, 6), index)
    assert len(ops.complete_inserts(store)) == 1 and ops.complete_inserts(store) == []
    assert _state(spark, store, index) == whole


def test_sources_are_numbered_once(spark, store):
    assert ops.ensure_source(store, "reddit", now=NOW) == 1
    with ops.only_writer(store):
        assert ops.ensure_source(store, "reddit", now=NOW) == 1  # known ones need no claim
        with pytest.raises(RuntimeError):
            ops.ensure_source(store, "web_reviews", now=NOW)


# Key filters -----------------------------------------------------------------------------------
def test_only_possible_hits_meet_the_store(spark, store):
    source = ops.ensure_source(store, "reddit", now=NOW)
    for first, n in ((0, 40), (40, 30), (60, 60)):
        rows = canonical(spark, [(i, f"e{i}", f"k{i}", "t", "b") for i in range(first, first + n)])
        ops.insert_documents(store, rows, source, now=NOW)
    ids = [(1, 40), (41, 70), (71, 120)]
    assert [(p["first"], p["last"]) for p in ft.manifest(spark, ops.filter_path(store))["parts"]] == ids
    incoming = spark.createDataFrame(
        [(source, f"e{i}", f"k{i}") for i in range(45, 50)] + [(source, f"new{i}", f"fresh{i}") for i in range(3000)]
        + [(source, None, None), (source + 1, "e1", "k1"), (source, "e2", None)], "source_id long, external_id string, dedupe_key string")
    maybe, stored = ops.possibly_stored(store, incoming, 120)
    found = {r.external_id for r in maybe.collect()}
    assert {f"e{i}" for i in range(45, 50)} | {"e1", "e2"} <= found and len(found) < 60 and None not in found
    maybe, stored = ops.possibly_stored(store, incoming.where("external_id IN ('e45', 'e46')"), 120)
    assert sorted(r.id for r in stored.collect()) == list(range(41, 71))
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,41)" in plan and "LessThanOrEqual(id,70)" in plan
    # a store that was written without filters is looked through as a whole
    assert ops.possibly_stored(store, incoming, 121)[1].count() == 120
    assert keyfilter.merge_filters(spark, ops.filter_path(store), store.read("documents"), ops.KEYS, fan=2) > 0
    parts = ft.manifest(spark, ops.filter_path(store))["parts"]
    assert sum(p["rows"] for p in parts) == 120 and len(parts) < 3
    maybe, _ = ops.possibly_stored(store, incoming, 120)
    assert {f"e{i}" for i in range(45, 50)} | {"e1", "e2"} <= {r.external_id for r in maybe.collect()}


def test_filters_never_miss_a_key(spark, tmp_path):
    hashes = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    entry = keyfilter.stage_filter(hashes, str(tmp_path), "a", 1, 20_000)
    ft.commit_parts(spark, str(tmp_path), [entry])
    asked = spark.range(10_000, 60_000).select(F.xxhash64("id").alias("h"))
    found = keyfilter.ask(spark, str(tmp_path), asked)
    assert found.join(hashes, "h", "left_semi").count() == 10_000
    assert found.count() - 10_000 < 40_000 / 100
    assert keyfilter.ask(spark, str(tmp_path / "none"), asked).count() == 0


# Daily counts ----------------------------------------------------------------------------------
def test_reports_from_daily_counts(spark, store, monkeypatch):
    from datetime import datetime, timedelta

    source = ops.ensure_source(store, "reddit", now=NOW)
    words = ["bad watch please add battery", "a great and long text", "please add this feature watch", "nothing to say here at all"]
    for start in (0, 12, 24):
        rows = canonical(spark, [(i, f"e{i}", None, "t", f"{words[i % 4]} {i}") for i in range(start, start + 12)])
        day = F.lit(datetime(2024, 3, 1)) + F.make_dt_interval(F.col("arrival").cast("int") % 5, F.when(F.col("arrival") % 3 == 0, 0).otherwise(5))
        ops.insert_documents(store, rows.withColumn("created_at", day), source, now=NOW, taxonomy=TAXONOMY)
        if start < 24:
            jobs.enrich_documents(store, None, clock=lambda: NOW, model_name="rules")
    corpus, counts = store.corpus(), rollup.read_rollup(spark, ops.rollup_path(store))

    def same(a, b):
        assert sorted(map(tuple, a.select(*b.columns).collect()), key=str) == sorted(map(tuple, b.collect()), key=str)

    for raw in ({"date_from": "2024-03-02", "date_to": "2024-03-04", "sources": ["reddit"]}, {"sentiment_label": "negative", "rating": 4}):
        chosen = Filters.of(raw)
        for name, report in insights.INSIGHTS.items():
            own = getattr(rollups, f"{name}_insight")(counts, corpus.sources, chosen)
            whole = report(corpus, chosen)
            assert set(own) == set(whole) - {"evidence"}
            for part, rows in own.items():
                same(rows, whole[part])
        same(rollups.kpis(counts, corpus.sources, chosen), dashboard.kpis(corpus, chosen))
        same(rollups.volume_by_day(counts, corpus.sources, chosen), dashboard.volume_by_day(corpus, chosen))
    assert not rollups.answers(Filters.of({"date_to": "2024-03-04T10:00:00"})) and not rollups.answers(Filters.of({"issue_tags": ["x"]}))
    with pytest.raises(ValueError):
        rollups.kpis(counts, corpus.sources, Filters.of({"issue_tags": ["x"]}))
    assert len(rollup.merge_rollups(spark, ops.rollup_path(store), fan=2)) > 0
    same(rollups.kpis(rollup.read_rollup(spark, ops.rollup_path(store)), corpus.sources), dashboard.kpis(corpus))

    # an enrichment that breaks off is completed, counts and all
    with monkeypatch.context() as patched:
        patched.setattr(ops, "commit_parts", lambda *_: (_ for _ in ()).throw(OSError("broken off")))
        with pytest.raises(OSError):
            jobs.enrich_documents(store, None, clock=lambda: NOW, model_name="rules")
    assert len(ops.complete_inserts(store)) == 1
    assert jobs.enrich_documents(store, enrich.rule_scorer, clock=lambda: NOW, model_name="rules")["candidates"] == 0
    same(rollups.kpis(rollup.read_rollup(spark, ops.rollup_path(store)), corpus.sources), dashboard.kpis(store.corpus()))


# Merges ----------------------------------------------------------------------------------------
def _parts(spark, path):
    return [p["n_docs"] for p in ft.manifest(spark, path)["parts"]]


def _grown(spark, path, sizes):
    docs = spark.range(sum(sizes)).select(
        "id", F.concat(F.lit("title "), F.col("id") % 7).alias("title"),
        F.concat_ws(" ", F.lit("battery"), F.when(F.col("id") % 3 == 0, "crash"), F.col("id").cast("string")).alias("body"))
    start = 0
    for size in sizes:
        ft.write_index(ft.build_index(docs.where(F.col("id").between(start, start + size - 1))), path, append=True)
        start += size
    return docs


def _same_as_rebuilt(spark, path, docs):
    merged, rebuilt = ft.read_index(spark, path), ft.build_index(docs)
    for match in (ft.match_all("battery crash"), ft.match_prefix("ti"), ft.match_phrase("battery crash")):
        got, want = (sorted(map(tuple, ft.score_index(i, match).collect())) for i in (merged, rebuilt))
        assert got == want and got


def test_merges_keep_few_parts_and_the_same_scores(spark, tmp_path):
    path = str(tmp_path / "ix")
    docs = _grown(spark, path, [1, 1, 1, 2, 1, 1, 3, 9])
    assert _parts(spark, path) == [1, 1, 1, 2, 1, 1, 3, 9]
    merges = ft.merge_index(spark, path, fan=3)
    # six of the first tier become one of the second, which has another one then
    assert [len(m) for m in merges] == [6] and sorted(_parts(spark, path)) == [3, 7, 9]
    _same_as_rebuilt(spark, path, docs)
    assert ft.merge_index(spark, path, fan=3) == []
    gone = ft.vacuum_index(spark, path)
    assert gone == []  # older manifests still name the merged parts
    for name in files.names(spark, f"{path}/manifests")[:-1]:
        files.delete(spark, f"{path}/manifests/{name}")
    assert sorted(ft.vacuum_index(spark, path)) == sorted(merges[0])
    _same_as_rebuilt(spark, path, docs)


def test_number_of_parts_grows_with_the_logarithm(spark, tmp_path):
    path = str(tmp_path / "ix")
    entries = [{"part": f"{i:03d}", "n_docs": 1, "total_length": 1} for i in range(40)]
    parts = []
    for entry in entries:  # the choice of parts alone, as merge_index makes it
        parts.append(entry["n_docs"])
        while True:
            tiers = {}
            for n in parts:
                tiers.setdefault(ft._tier(n, 3), []).append(n)
            full = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= 3), None)
            if full is None:
                break
            for n in full:
                parts.remove(n)
            parts.append(sum(full))
        assert len(parts) <= 2 * (ft._tier(sum(parts), 3) + 1)
    assert not files.names(spark, f"{path}/manifests")


def test_a_broken_merge_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ix")
    docs = _grown(spark, path, [2, 2, 2])
    with monkeypatch.context() as patched:
        patched.setattr(ft, "commit_parts", lambda *_: (_ for _ in ()).throw(OSError("broken off")))
        with pytest.raises(OSError):
            ft.merge_index(spark, path, fan=3)
    assert _parts(spark, path) == [2, 2, 2] and len(ft.vacuum_index(spark, path)) == 1
    assert len(ft.merge_index(spark, path, fan=3)) == 1 and _parts(spark, path) == [6]
    _same_as_rebuilt(spark, path, docs)


def test_commits_on_top_of_others(spark, tmp_path):
    path = str(tmp_path / "ix")
    entry = lambda part: {"part": part, "n_docs": 1, "total_length": 2}
    assert ft.commit_parts(spark, path, [entry("a")]) and ft.commit_parts(spark, path, [entry("b")])
    assert ft.commit_parts(spark, path, [entry("b")])  # once only
    assert not ft.commit_parts(spark, path, [entry("c")], ["a", "gone"])
    assert ft.commit_parts(spark, path, [entry("c")], ["a"])
    assert [p["part"] for p in ft.manifest(spark, path)["parts"]] == ["b", "c"]
    assert ft.commit_parts(spark, path, [entry("d")], None)
    last = ft.manifest(spark, path)
    assert [p["part"] for p in last["parts"]] == ["d"] and last["version"] == 5
    for i in range(12):
        ft.commit_parts(spark, path, [entry(f"x{i}")])
    assert len(files.names(spark, f"{path}/manifests")) <= ft.KEPT_MANIFESTS + 1
    assert ft.read_index(spark, str(tmp_path / "none")).corpus.first()["n_docs"] == 0


def test_small_files(spark, tmp_path):
    path = f"{tmp_path}/a/b.json"
    assert files.read_json(spark, path) is None and files.names(spark, f"{tmp_path}/a") == []
    assert files.write_json(spark, path, {"x": ["é", 1]}) and not files.write_json(spark, path, {})
    assert files.read_json(spark, path) == {"x": ["é", 1]} and files.names(spark, f"{tmp_path}/a") == ["b.json"]
    assert files.claim(spark, f"{tmp_path}/c") and not files.claim(spark, f"{tmp_path}/c")
