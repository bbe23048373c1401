import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import llm.brute as brute
import llm.data as data
from voxlake.llm import simhash_dedup as sim
from voxlake.llm.components import components
from voxlake.llm.substring_dedup import substring_dedup
from voxlake.llm.suffix_dedup import multikey_sort, suffix_dedup


def test_fingerprint_equals_plain_one():
    for text in data.texts():
        assert sim.fingerprint((text or "").encode()) == brute.fingerprint(text)


def test_golay_code_is_perfect_and_keys_cover_four_bits():
    rnd = np.random.default_rng(1)
    fp = rnd.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + rnd.integers(0, 2, 3000, dtype=np.uint64)
    index = sim.codeword_indices((fp & np.uint64((1 << 23) - 1)).astype(np.int64))
    assert set(np.unique([len(set(r)) for r in index.tolist()])) == {1, 6}
    other = fp.copy()
    for row in range(len(fp)):
        for bit in rnd.choice(64, rnd.integers(0, 5), replace=False):
            other[row] ^= np.uint64(1) << np.uint64(bit)
    found = []
    for prints in (fp, other):
        keys, rows = sim.golay_keys(prints)
        sets = [set() for _ in fp]
        for k, r in zip(keys.tolist(), rows.tolist(), strict=True):
            sets[r].add(k)
        found.append(sets)
    assert all(a & b for a, b in zip(*found, strict=True))


@pytest.mark.parametrize("cap", [4096, 7])
def test_simhash_components(spark, cap, monkeypatch):
    monkeypatch.setattr(sim.near_links, "__defaults__", (sim.BITS, cap))
    pairs = data.rows()
    got = sorted(map(tuple, sim.simhash_dedup(data.frame(spark, pairs)).collect()), key=str)
    prints = [brute.fingerprint(t) for _, t in pairs]
    roots = brute.components(prints)
    least = {}
    for (doc, _), root in zip(pairs, roots, strict=True):
        known = [x for x in (doc, least.get(root)) if x is not None]
        least[root] = min(known, default=None)
    want = [(doc, f"{p:016x}", least[r]) for (doc, _), p, r in zip(pairs, prints, roots, strict=True)]
    assert got == sorted(want, key=str)


def test_dense_bucket_and_chain(spark):
    """A chain of prints one bit apart, and thousands within a few bits of one another, are one component each."""
    rnd = np.random.default_rng(2)
    chain = [sum(1 << b for b in range(i)) for i in range(0, 60, 3)]
    middle = 0xF0F0_1234_5678_9ABC
    dense = {middle ^ sum(1 << int(b) for b in rnd.choice(64, 2, replace=False)) for _ in range(900)}
    prints = sorted({*chain, *dense})
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r["node"]: r["root"] for r in components(sim.near_links(nodes, 4, cap=100)).collect()}
    mine = [roots.get(p, p) for p in signed]
    want = brute.components(prints)
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_keys_are_sorted_once_and_large_buckets_passed_on():
    """Keys come in pieces; those with over cap fingerprints are handed on whole, the others linked as before."""
    rnd = np.random.default_rng(5)
    key = np.sort(np.concatenate([np.repeat([3, 900, 901], [700, 650, 40]), rnd.integers(0, 1000, 900)]))
    fp = rnd.integers(0, 1 << 12, len(key)).astype(np.int64)
    parts = [pa.RecordBatch.from_arrays([pa.array(key[i:i + 64]), pa.array(fp[i:i + 64])], names=["key", "fp"])
             for i in range(0, len(key), 64)]
    for rows in (200, 10_000):
        whole = list(sim._whole_keys(iter(parts), 100, rows))
        assert np.array_equal(np.concatenate([k for k, _ in whole]), key)
        links, passed = set(), []
        for batch in sim._links(4, 100, rows=rows)(iter(parts)):
            for row in batch.to_pylist():
                if row["key"] is None:
                    links.add((row["a"], row["b"]))
                else:
                    passed.append((row["key"], row["a"]))
        large = np.isin(key, [k for k, n in zip(*np.unique(key, return_counts=True)) if n > 100])
        assert sorted(passed) == sorted(zip(key[large].tolist(), fp[large].tolist()))
        left = [pa.RecordBatch.from_arrays([pa.array(key[~large]), pa.array(fp[~large])], names=["key", "fp"])]
        assert links == {(r["a"], r["b"]) for b in sim._links(4)(iter(left)) for r in b.to_pylist()}


def test_keys_are_neither_counted_nor_joined(spark):
    nodes = spark.range(50).selectExpr("id as fp")
    plan = sim.near_links(nodes)._jdf.queryExecution().executedPlan().toString()
    # what is joined are fingerprints that were passed on, from the checkpoint
    assert "MapInArrow _keys" not in plan and "Scan ExistingRDD" in plan


def test_components_of_empty_and_star(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    links = [(i, 7) for i in range(50)] + [(100 + i, 101 + i) for i in range(40)] + [(3, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 50)} | {i: 100 for i in range(101, 141)}


def _kept(found, join):
    return [join([x for x, g in zip(s, gone, strict=True) if not g]) for s, gone in found]


def test_substring_dedup(spark):
    pairs = data.rows()
    out = substring_dedup(data.frame(spark, pairs), keep=("g", "source"))
    assert out.columns == ["doc_id", "g", "source", "n_words", "n_removed", "kept_text"]
    found = brute.repeats(pairs, lambda t: t.encode().split(), 50, by_place=False)
    want = [(d, "g", "s", len(s), sum(g), k.decode()) for (d, _), (s, g), k in
            zip(pairs, found, _kept(found, b" ".join), strict=True)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert sum(w[4] for w in want) > 1000


@pytest.mark.parametrize("bucket", [300_000, 60])
def test_suffix_dedup(spark, bucket):
    pairs = data.rows()
    out = suffix_dedup(data.frame(spark, pairs), bucket=bucket, sample=2)
    found = brute.repeats(pairs, lambda t: t.encode(), 100, by_place=True)
    want = []
    for (d, _), (s, gone), kept in zip(pairs, found, _kept(found, bytes), strict=True):
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want.append((d, len(s), sum(gone), spans, kept))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def _same_tags():
    """Texts of 63 words without a common word, with and without one passage, whose hashes are equal in 24 bits."""
    import xxhash

    passage, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    tags = {xxhash.xxh64_intdigest(f"{passage} tail of {i}".encode(), 42) & 0xFFFFFF: i for i in range(8000)}
    return passage, *next((f"{passage} tail of {tags[t]}", f"{other} end of {j}") for j in range(10**6)
                          if (t := xxhash.xxh64_intdigest(f"{other} end of {j}".encode(), 42) & 0xFFFFFF) in tags)


def _both_equal_brute_force(spark, pairs):
    words = brute.repeats(pairs, lambda t: t.encode().split(), 50, by_place=False)
    got = sorted(map(tuple, substring_dedup(data.frame(spark, pairs)).select("doc_id", "n_removed", "kept_text").collect()), key=str)
    assert got == sorted(((d, sum(g), k.decode()) for (d, _), (_, g), k in zip(pairs, words, _kept(words, b" ".join), strict=True)), key=str)
    raw = brute.repeats(pairs, lambda t: t.encode(), 100, by_place=True)
    got = sorted(((r["doc_id"], r["n_removed"], bytes(r["kept"])) for r in suffix_dedup(data.frame(spark, pairs)).collect()), key=str)
    assert got == sorted(((d, sum(g), k) for (d, _), (_, g), k in zip(pairs, raw, _kept(raw, bytes), strict=True)), key=str)
    return words


def test_texts_under_one_id_are_told_apart(spark):
    """Equal ids, and hashes that are equal in their low 24 bits: only the text that repeats something loses it."""
    passage, repeating, fresh = _same_tags()
    for shared in (5, None):
        pairs = [(1 if shared else None, passage), (shared, repeating), (shared, fresh), (9, fresh), (9, passage)]
        found = _both_equal_brute_force(spark, pairs)
        assert not any(found[2][1])


def test_many_repeated_rows(spark, monkeypatch):
    """Equal ids with equal texts count once, whatever their number."""
    from voxlake.llm import repeats

    passage, repeating, fresh = _same_tags()
    pairs = [(None, passage)] * 60 + [(3, repeating)] * 40 + [(3, fresh)] * 5 + [(2, f"{fresh[:300]} and {passage}")] * 20
    _both_equal_brute_force(spark, pairs)
    monkeypatch.setattr(repeats, "HOT", 1)
    _both_equal_brute_force(spark, pairs)


@pytest.mark.parametrize("texts", [[f"{i} " + " ".join(f"t{(j * 7919 + i) % 99991}" for j in range(40_000)) for i in range(4)],
                                   [" ".join(f"t{j * 7919 % 99991}" for j in range(120_000))]])
def test_few_long_texts_are_cut_into_ranges(spark, texts):
    """The sample is of slices of texts, so ranges keep their bound where a sample of rows would find none."""
    from voxlake.llm import repeats, suffix_dedup as suffix

    rows = repeats.identified(data.frame(spark, list(enumerate(texts)))).select("doc", "h", "text")
    splitters = suffix.sampled_splitters(rows, suffix.WINDOW, 1000, suffix.SAMPLE)
    assert len(splitters) > 10
    sizes = [r["count"] for r in rows.mapInArrow(
        suffix._suffixes(suffix.WINDOW, splitters), "bucket long, lead long, rest long, c long, doc long, h long, loc long"
    ).groupBy("bucket").count().collect()]
    assert sum(sizes) > 10_000 and max(sizes) < 4 * 1000


def test_hot_anchors_are_compared_across_tasks(spark, monkeypatch):
    """With a small bound every anchor counts as hot, and results stay the same."""
    from voxlake.llm import repeats

    pairs = data.rows()
    plain = sorted(map(tuple, substring_dedup(data.frame(spark, pairs)).collect()), key=str)
    monkeypatch.setattr(repeats, "HOT", 2)
    assert sorted(map(tuple, substring_dedup(data.frame(spark, pairs)).collect()), key=str) == plain


def test_empty_tables(spark):
    none = data.frame(spark, [])
    for operator in (sim.simhash_dedup, substring_dedup, suffix_dedup):
        assert operator(none).count() == 0


def test_multikey_sort():
    rnd = np.random.default_rng(4)
    lanes = [rnd.integers(0, 4, 500) for _ in range(4)]
    order = multikey_sort(lanes)
    assert np.array_equal(np.stack(lanes)[:, order], np.stack(lanes)[:, np.lexsort(lanes[::-1])])


def test_long_row_is_cut_into_slices(spark, monkeypatch):
    from voxlake.llm import arrays

    monkeypatch.setattr(arrays, "CHUNK", 2000)
    monkeypatch.setattr(arrays.row_chunks, "__defaults__", (2000,))
    text = " ".join(f"w{i % 700}" for i in range(2500))
    out = substring_dedup(data.frame(spark, [(2, text), (1, "x " + text + " y")]).repartition(1))
    assert {r["doc_id"]: r["n_removed"] for r in out.collect()} == {1: 0, 2: 2500}
    kept = suffix_dedup(data.frame(spark, [(2, text), (1, "x" + text)])).filter(F.col("doc_id") == 2).first()
    assert kept["n_removed"] == len(text)
