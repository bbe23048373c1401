import random

import llm.brute as brute
import llm.data as data
import pytest

from voxlake.llm import near_copies as near
from voxlake.llm.pipeline import near_dedup_stage
from voxlake.llm.simhash_dedup import simhash_dedup


def _set(text):
    words = brute.WORD.findall((text or "").translate(brute.UPPER))
    return {" ".join(words[i:i + 5]) for i in range(len(words) - 4)} or {" ".join(words)}


def _edited():
    """Texts of 30 families, each with copies of which every one has a few other words."""
    rnd = random.Random(8)
    out = []
    for _ in range(30):
        words = [f"w{rnd.randrange(3000)}" for _ in range(150)]
        for edits in (0, 1, 2, 2, 3, 3, 4, 6):
            own = words.copy()
            for at in rnd.sample(range(150), edits):
                own[at] = f"e{rnd.randrange(3000)}"
            out.append(" ".join(own))
    return out


def _components(texts):
    sets = [_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("cap", [4096, 3])
def test_components_equal_all_pairs(spark, monkeypatch, cap):
    monkeypatch.setattr(near, "CAP", cap)
    monkeypatch.setattr(near, "GROUP", cap)
    texts = _edited() + data.texts()
    roots = _components(texts)
    got = {r["doc_id"]: r["component_id"] for r in near.near_copies(data.frame(spark, list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(roots))


def test_components_of_null_and_shared_ids(spark):
    texts = _edited()
    pairs = [(None, texts[0]), (None, texts[1]), (None, texts[0]), (5, texts[8]), (5, texts[16]), (3, texts[9]), (5, None), (None, None)]
    roots = _components([t for _, t in pairs])
    least = {}
    for (doc, _), root in zip(pairs, roots, strict=True):
        known = [x for x in (doc, least.get(root)) if x is not None]
        least[root] = min(known, default=None)
    got = sorted(map(tuple, near.near_copies(data.frame(spark, pairs)).collect()), key=str)
    assert got == sorted(((d, least[r]) for (d, _), r in zip(pairs, roots, strict=True)), key=str)


def test_stage_keeps_one_row_of_each_component(spark):
    """Rows are chosen, not ids: copies of null ids and of shared ids go, other texts of these ids stay."""
    texts = _edited()
    other = [texts[40], texts[48], texts[56]]
    pairs = ([(None, texts[0]), (None, texts[0]), (7, texts[0])] + [(None, t) for t in other] + [(None, other[0])] * 3
             + [(5, texts[80]), (5, texts[88]), (5, texts[80]), (2, texts[88])])
    kept = sorted(((r["doc_id"], r["text"]) for r in near_dedup_stage(spark, data.frame(spark, pairs), "").collect()), key=str)
    assert kept == sorted([(7, texts[0]), *((None, t) for t in other), (5, texts[80]), (2, texts[88])], key=str)


def test_large_group_sends_its_texts_a_few_times(spark, monkeypatch):
    """A group of many blocks: the texts that its root does not reach meet all blocks, the others only those."""
    rnd = random.Random(12)
    base = [f"w{rnd.randrange(3000)}" for _ in range(120)]
    texts = []
    for i in range(120):
        own = base.copy()
        for at in range(i // 12):  # each twelve are one edit further off the first, so that the far ones hang on a chain
            own[at * 13] = f"e{at}"
        own[rnd.randrange(118, 120)] = f"x{i}"
        texts.append(" ".join(own))
    sent = []
    walked = near._walked

    def counting(dealt, walk):
        if walk is near.similar:
            sent.append(dealt.count())
        return walked(dealt, walk)

    monkeypatch.setattr(near, "_walked", counting)
    monkeypatch.setattr(near, "GROUP", 10)
    got = {r["doc_id"]: r["component_id"] for r in near.near_copies(data.frame(spark, list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(_components(texts)))
    assert sum(sent) < 12 * len(texts)


def test_stage_drops_copies_that_differ_in_many_bits(spark):
    texts = _edited()
    bits = [bin(brute.fingerprint(texts[0]) ^ brute.fingerprint(t)).count("1") for t in texts[1:5]]
    assert max(bits) > 4
    kept = {r["doc_id"] for r in near_dedup_stage(spark, data.frame(spark, list(enumerate(texts))), "").collect()}
    roots = _components(texts)
    assert kept == set(roots)


def test_stage_finds_copies_by_fingerprints_alone(spark, monkeypatch):
    """Without any candidate of the min-hashes, op1's components are verified: copies go, texts below 0.8 stay."""
    walked = near._walked
    monkeypatch.setattr(near, "_walked", lambda dealt, walk: (
        walked(dealt, walk).filter("a is null") if walk is near.agreeing else walked(dealt, walk)))
    rnd = random.Random(4)
    words = [f"w{rnd.randrange(3000)}" for _ in range(400)]
    texts = [" ".join(words), " ".join(["edited", *words[1:]]), " ".join([*words[:-1], "edited"]), "ab ab ab ab", "ab " * 9]
    prints = brute.components([brute.fingerprint(t) for t in texts])
    assert prints == [0, 0, 0, 3, 3] and _components(texts) == [0, 0, 0, 3, 4]
    kept = {r["doc_id"] for r in near_dedup_stage(spark, data.frame(spark, list(enumerate(texts))), "").collect()}
    assert kept == {0, 3, 4}


def test_more_bits_than_the_keys_cover_are_refused(spark):
    with pytest.raises(ValueError):
        simhash_dedup(data.frame(spark, [(1, "a")]), bits=5)


def test_a_group_is_walked_as_a_whole(spark):
    """Rows that a join has dealt by the same key are dealt for the walk nevertheless: the join's shuffle may be read in pieces."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes = spark.createDataFrame([(1, 2, "a b"), (1, 3, "a b")], "key long, node long, payload string")
        sizes = spark.createDataFrame([(1,)], "key long")
        walked = near._walked(nodes.join(sizes, "key"), near.similar)
        plan = walked._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 3 and "REPARTITION_BY_NUM" in plan
        assert [tuple(r) for r in walked.collect()] == [(3, 2)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_of_a_stage_are_shuffled_once(spark):
    """The rows that stay are dealt by their key for the join, and not again for leaving out equal rows."""
    docs = spark.createDataFrame([(1, "a b", "en", "x"), (1, "a b", "de", "x"), (None, "c", "en", "y"), (None, "c", None, "y"), (2, None, "en", "z")],
                                 "doc_id long, text string, lang string, source string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = near_dedup_stage(spark, docs, "")
        assert sorted(map(tuple, out.collect()), key=str) == sorted([
            (1, "a b", "de", "x", 3), (None, "c", None, "y", 1), (2, None, "en", "z", None)], key=str)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(no_id" in plan and "hashpartitioning(doc_id" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
