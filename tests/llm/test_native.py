import zlib
from collections import defaultdict

import llm.data as data
import pytest
from pyspark.sql import functions as F

from voxlake.llm import sharding
from voxlake.llm.preference_format import parroting_pairs, preference_pairs
from voxlake.llm.queries import URL_RULES
from voxlake.llm.sharding import shards
from voxlake.llm.url_trust import host_of, host_scores, path_of, url_verdicts

RULES = URL_RULES


def test_host_and_path(values):
    urls = ["https://WWW.Example.com/En/x?y#z", "http://a.b", "http://a.b?x/y", "no scheme/x", None, "", "x://h/p://q", "HTTP://É.com#f/g"]
    assert values(host_of, urls) == ["www.example.com", "a.b", "a.b", "", "", "", "h", "É.com"]
    assert values(path_of, urls) == ["/En/x", "", "", "", "", "", "/p://q", ""]


def _verdicts(spark, pages, **options):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("trust", F.lit(1))
    return {r["page_id"]: r for r in url_verdicts(df, RULES, **options).collect()}


def test_longest_rule_wins(spark):
    got = _verdicts(spark, [
        (1, "http://example.com/en/1", None), (2, "http://www.example.com/en/1", ""), (3, "http://m.www.example.com/en/", ""),
        (4, "http://x.com/a", ""), (5, "http://x.com", ""), (6, "http://a.net/es/1", ""), (7, "http://a.net/de/1", ""),
        (8, "http://notexample.com/en/", ""), (9, None, None), (10, "http://anet/es/", "")])
    assert [got[i]["rule"] for i in range(1, 11)] == [
        "example.com/en/", "www.example.com/en/", "www.example.com/en/", "com/", None, "net/es/", None, "com/", None, None]
    assert [got[i]["verdict"] for i in (1, 2, 4, 6)] == ["block", "allow", "allow", "block"]
    assert got[5]["verdict"] == got[9]["verdict"] == "allow"


def test_distrust_runs_against_links(spark):
    bad = "http://bad.net/es/1"
    farm = '<a href="http://BAD.net/es/1">x</a> <a href=\'//bad.net/\'>y</a>'
    pages = [(1, bad, ""), (2, "http://farm.org/", farm), (3, "http://reads.org/", '<a href="http://good.com/">'), (4, "http://good.com/", ""),
             (5, "http://top.org/", '<a href="http://farm.org/x">')]
    got = _verdicts(spark, [*pages, pages[1]])
    assert got[2]["verdict"] == "block" and got[2]["distrust"] > 0.8
    assert got[5]["verdict"] == "block" and 0.5 < got[5]["distrust"] < got[2]["distrust"]
    assert got[3]["verdict"] == "allow" and got[4]["verdict"] == "allow"


def test_scores_equal_a_plain_iteration(spark):
    pages = [("a", "allow"), ("a", None), ("b", "block"), ("c", None), ("d", "allow")]
    links = [("a", "b"), ("a", "c"), ("a", "c"), ("c", "b"), ("b", "d"), ("d", "x"), ("x", "a"), ("a", "a")]
    got = {r["host"]: (r["trust"], r["distrust"]) for r in host_scores(
        spark.createDataFrame(pages, "host string, verdict string"), spark.createDataFrame(links, "source string, target string"),
        rounds=6).collect()}
    count = defaultdict(float)
    for s, t in links:
        if s != t:
            count[s, t] += 1
    out, into = defaultdict(float), defaultdict(float)
    for (s, t), n in count.items():
        out[s] += n
        into[t] += n
    share = {"a": (0.5, 0), "b": (0, 1), "c": (0, 0), "d": (1, 0)}
    now = dict(share)
    for _ in range(6):
        after = {h: list(v) for h, v in share.items()}
        for (s, t), n in count.items():
            after.setdefault(t, [0, 0])[0] += 0.85 * n / out[s] * now.get(s, (0, 0))[0]
            after.setdefault(s, [0, 0])[1] += 0.85 * n / into[t] * now.get(t, (0, 0))[1]
        now = after
    assert set(got) == set(now)
    assert all(abs(got[h][i] - now[h][i]) < 1e-9 for h in now for i in (0, 1))


def test_empty_pages(spark):
    assert _verdicts(spark, []) == {}


TURNS = "array<struct<turn:long,role:string,text:string>>"


def test_preference_pairs(spark):
    chosen = [(0, "user", "hi"), (1, "assistant", "yes"), (2, "user", "more")]
    rejected = [(0, "user", "hi"), (1, "assistant", "no")]
    rows = [(1, chosen, rejected), (2, chosen, chosen), (3, [], None), (4, [(0, None, None)], [(0, "", "")]), (5, chosen, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], f"pair_id long, chosen {TURNS}, rejected {TURNS}, prompt string")
    got = {r["pair_id"]: r for r in preference_pairs(df).collect()}
    assert tuple(got[1]) == (1, 1, "<|user|>\nhi\n", "<|assistant|>\nyes\n<|user|>\nmore\n", "<|assistant|>\nno\n", "18:1 14:0", "17:1")
    assert got[2]["n_prompt_turns"] == 3 and got[2]["chosen"] == got[2]["rejected"] == got[2]["chosen_mask"] == ""
    assert tuple(got[3])[1:] == (0, "", "", "", "", "")
    assert got[4]["n_prompt_turns"] == 1
    assert got[5]["n_prompt_turns"] == 0 and got[5]["rejected"] == ""


def test_parroting_pairs(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "user", "c"), (2, 0, "assistant", "x"), (3, 0, "user", "y"), (1, 1, "assistant", "b")]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "r"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: ([t["text"] for t in r["chosen"]], [t["text"] for t in r["rejected"]]) for r in parroting_pairs(df).collect()}
    assert got == {1: (["a", "b", "b"], ["a", "b", "b"]), 2: (["x"], [""])}
    assert parroting_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [sharding.MAX_RANGES, 3])
def test_shards_are_even_and_gapless(spark, monkeypatch, most):
    """With few ranges for many rows, every range is sliced; the hot text's slice is dealt by row number."""
    monkeypatch.setattr(sharding, "MAX_RANGES", most)
    pairs = data.rows() + [(5000 + i, "the same text " * 9) for i in range(700)] + [(7, "again")] * 300
    pairs += [(9000 + i, f"one of many {i // 3}") for i in range(6000 if most == 3 else 0)]
    got = shards(data.frame(spark, pairs), n_shards=8, range_rows=50).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(
        ((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in pairs), key=str)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    places = defaultdict(list)
    for n, r in enumerate(sorted(got, key=lambda r: (r["shard"], r["slot"]))):
        places[r["text_crc32"]].append(n)
    few = [p for p in places.values() if len(p) == 3]
    assert most != 3 or sum(max(p) - min(p) == 2 for p in few) > 0.9 * len(few) > 1500  # copies stay neighbours but for chance
    share, largest = sum(sizes.values()) / 8, max(r["size"] for r in got)
    assert all(abs(s - share) <= largest for s in sizes.values())
    assert shards(data.frame(spark, [])).count() == 0
    assert [(r["shard"], r["slot"]) for r in shards(data.frame(spark, [(1, None)])).collect()] == [(20, 0)]
