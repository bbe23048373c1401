import random
import re

from voxlake.operators.tagging import Taxonomy, matched_values, tag_documents
from voxlake.operators.tagmatch import AliasMatcher

COLLIDING = Taxonomy.of({
    "products": ["Galaxy Watch", "watch"], "product_aliases": {"galaxy watch": ["Samsung Watch"]},
    "competitors": ["google_wearables", "pixel"], "competitor_aliases": {"google_wearables": ["pixel watch", "google pixel watch"]},
    "issues": ["battery", "c++"], "features": [],
})


def model(text: str, pairs: list[tuple[str, str]]) -> list[str]:
    """Plain restatement of the claim rule on single-spaced lower-case text."""
    taken = [False] * len(text)
    found = set()
    for canonical, alias in pairs:
        for m in re.finditer(rf"(?<!\w){re.escape(alias)}(?!\w)", text):
            if not any(taken[m.start():m.end()]):
                taken[m.start():m.end()] = [True] * (m.end() - m.start())
                found.add(canonical)
                break
    return sorted(found)


def tags_of(values, texts, tag_type):
    return values(lambda x: matched_values(x, COLLIDING, tag_type), texts)


def test_longest_alias_claims_first(values):
    texts = ["my galaxy watch", "watch and samsung watch", "watches", "a watch", "galaxy watch watch"]
    assert tags_of(values, texts, "product") == [
        ["galaxy watch"], ["galaxy watch", "watch"], [], ["watch"], ["galaxy watch", "watch"]]
    texts = ["google pixel watch", "pixel watch, pixel", "pixel"]
    assert tags_of(values, texts, "competitor") == [["google_wearables"], ["google_wearables", "pixel"], ["pixel"]]


def test_words_with_marks_and_empty_types(values):
    assert tags_of(values, ["c++ code", "battery_life", "a battery!"], "issue") == [["c++"], [], ["battery"]]
    assert tags_of(values, ["anything"], "feature") == [[]]


def test_against_plain_model(values):
    rng = random.Random(7)
    parts = ["galaxy", "watch", "samsung", "pixel", "google", "x", "watchful", "élan", ",", "_watch"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(600)]
    for kind in ("product", "competitor"):
        assert tags_of(values, texts, kind) == [model(t, COLLIDING.of_type(kind)) for t in texts]


def test_rows_per_document(spark):
    docs = spark.createDataFrame(
        [(1, "Galaxy  Watch", "battery\nlow"), (2, None, "[removed]"), (3, "", "pixel")], "id long, title string, body string")
    got = {tuple(r) for r in tag_documents(docs, COLLIDING).collect()}
    assert got == {
        (1, "product", "galaxy watch", "rules", 1.0), (1, "issue", "battery", "rules", 1.0),
        (3, "competitor", "pixel", "rules", 1.0)}
    assert tag_documents(docs, COLLIDING, types=["issue"]).count() == 1


def test_taxonomy_frame(spark):
    rows = {tuple(r) for r in COLLIDING.frame(spark).collect()}
    assert ("product", "galaxy watch", "samsung watch") in rows and ("product", "watch", "watch") in rows


def test_matcher_against_plain_model():
    rng = random.Random(11)
    parts = ["galaxy", "watch", "samsung", "pixel", "google", "x", "watchful", "élan", ",", "_watch", "c++", "battery"]
    types = ["product", "competitor", "issue", "feature"]
    pairs = [(t, COLLIDING.of_type(t)) for t in types]
    matcher = AliasMatcher(pairs)
    for _ in range(2000):
        text = " ".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert matcher.tags(text) == [(t, v) for t, p in pairs for v in model(text, p)], text


def test_matcher_one_alias_of_several_values_and_long_words():
    pairs = [("product", [("b", "aa"), ("a", "aa"), ("c", "a")]), ("issue", [("z", "aa"), ("empty", "")])]
    matcher = AliasMatcher(pairs)
    assert matcher.tags("aa") == [("product", "b"), ("issue", "z")]
    assert matcher.tags("aa aa a") == [("product", "a"), ("product", "b"), ("product", "c"), ("issue", "z")]
    assert matcher.tags("aaa \U0001d400aa aa\u0301") == [("product", "b"), ("issue", "z")]
    assert matcher.tags(None) == matcher.tags("") == AliasMatcher([("product", [])]).tags("aa") == []
    long = "aa" * 200_000 + " aa"
    assert matcher.tags(long) == [("product", "b"), ("issue", "z")]


def test_large_taxonomy_equals_native_expression(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    aliases = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(150)}
    taxonomy = Taxonomy.of({"products": sorted(aliases), "issues": words[:20], "issue_aliases": {"w1": ["w1 w2", "w3 w1"]}})
    rows = [(i, rng.choice([None, "", "W1  w2"]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    docs = spark.createDataFrame(rows + [(None, "w1", None), (None, "w1", None)], "id long, title string, body string")
    native = sorted(map(str, tag_documents(docs, taxonomy, native_aliases=10_000).collect()))
    assert native == sorted(map(str, tag_documents(docs, taxonomy, native_aliases=0).collect())) and len(native) > 300
    assert tag_documents(docs.limit(0), taxonomy, native_aliases=0).count() == 0


def test_ten_thousand_aliases_stay_out_of_the_plan(spark):
    taxonomy = Taxonomy.of({"features": [f"feature {i}" for i in range(10_000)]})
    docs = spark.createDataFrame([(1, "feature 77 and feature 9999", None)], "id long, title string, body string")
    tags = tag_documents(docs, taxonomy)
    assert [r["tag_value"] for r in tags.orderBy("tag_value").collect()] == ["feature 77", "feature 9999"]
    assert "feature 77" not in tags._jdf.queryExecution().executedPlan().toString()
