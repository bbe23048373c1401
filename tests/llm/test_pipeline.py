import corpus_pipeline
import llm.brute as brute
import llm.data as data
from llm.test_near_copies import _components
from voxlake.llm.quality_rules import judge
from voxlake.llm.queries import tokenizer_path


def _plain(pairs, items):
    """The pipeline's documents by id, one stage after the other."""
    docs = {}
    for doc, text in pairs:
        _, _, kept, clean, _ = judge(text or "")
        if kept:
            docs[doc] = clean
    ids = sorted(docs)
    roots = _components([docs[d] for d in ids])
    docs = {d: docs[d] for i, d in enumerate(ids) if roots[i] == i}
    out = {}
    found = brute.repeats(sorted(docs.items()), lambda t: t.encode().split(), 50, by_place=False)
    for doc, (words, gone) in zip(sorted(docs), found, strict=True):
        if not all(gone):
            out[doc] = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode() if any(gone) else docs[doc]
    return {d: t for d, t in out.items() if not brute.decontaminate(t, items)[1]}


def test_pipeline_equals_plain_one(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    pairs = [(i, t) for i, t in enumerate(data.texts())]
    words = pairs[38][1].split()
    items = [(1, " ".join(words[10:24])), (2, "never seen words")]
    data.frame(spark, pairs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = _plain(pairs, items)
    assert set(got) == set(want) and 20 < len(want) < len(pairs)
    assert all(got[d] == library.encode(t, add_special_tokens=False).ids for d, t in want.items())


def test_stages_keep_the_columns_and_survive_odd_tables(spark, tmp_path):
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for pairs in ([], data.rows()):
        docs = data.frame(spark, pairs)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = docs.checkpoint()
        assert (docs.count() > 0) == bool(pairs)
