import hashlib
import random
import zlib

import numpy as np
import pytest

import llm.brute as brute
import llm.data as data
from voxlake.llm import bpe, rule_ensemble
from voxlake.llm.decontaminate import decontaminate
from voxlake.llm.quality_rules import judge, line_fails, quality_rules
from voxlake.llm.queries import tokenizer_path


def test_quality_figures(spark):
    pairs = data.rows()
    out = quality_rules(data.frame(spark, pairs))
    assert {"g", "fp", "marks", "lang"} <= set(out.columns)
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                   r["base_failed"]) for r in out.collect()), key=str)
    assert got == sorted(((d, *brute.quality(t)) for d, t in pairs), key=str)
    assert quality_rules(data.frame(spark, [])).count() == 0


def test_lines_are_removed_and_bad_texts_rejected():
    clean = "The first sentence has some words in it.\nThe second one, too, is fine (really)."
    assert judge(clean)[2:] == (True, clean, 0)
    _, _, kept, text, lost = judge(clean + "\nHome | About | Contact | Help\nAll rights reserved. Privacy policy")
    assert (kept, text, lost) == (True, clean, 12)
    assert judge("a### b*** c$$$ d%%% e&&& f### g### h### i### j### k###")[2] is False
    assert judge(clean + "\nLOUD!! WORDS!! ARE!! HERE!! AND!! MORE!! OF!! THEM!! COME!! NOW!! AND!! THEN!! UNTIL!! "
                 "ALL!! IS!! SAID!!")[2] is False
    assert judge("")[1:3] == (True, False)


@pytest.mark.parametrize("line", [
    "Paris - London", "- good morning", "* buy milk", "Yes - no", "• one more", "She baked cookies for the children.",
    "The poem has no copyright today.", "He reads the newsletter of the town every week.", "I log in the forest with an axe.",
    "La politique de confidentialité du journal a changé depuis longtemps.", "- He said - twice - that it was late, then left again.",
    "The privacy policy debate went on for several weeks.", "Das Impressum der alten Zeitung wurde gefunden.", "3 - 2",
])
def test_clean_lines_stay(line):
    assert line_fails(line, line.split()) is None


@pytest.mark.parametrize("line, rule", [
    ("We use cookies to make this site better.", "boilerplate"), ("Accept all cookies", "boilerplate"),
    ("Privacy policy", "boilerplate"), ("Log in / Sign up", "boilerplate"), ("Copyright © 2024 Example Ltd.", "boilerplate"),
    ("Copyright (c) Example", "boilerplate"), ("Subscribe to our newsletter for more", "boilerplate"),
    ("Wir verwenden Cookies, um Inhalte zu zeigen", "boilerplate"), ("Alle Rechte vorbehalten", "boilerplate"),
    ("Tous droits réservés.", "boilerplate"), ("Lire la suite", "boilerplate"),
    ("Todos los derechos reservados", "boilerplate"), ("Leer más", "boilerplate"),
    ("Home > News > Sport", "navigation"), ("Start | Über uns | Kontakt", "navigation"),
    ("https://example.com/a", "navigation"), ("### $$$ %%%", "punctuation"),
])
def test_failing_lines_go(line, rule):
    assert line_fails(line, line.split()) == rule


def test_a_text_is_kept_if_it_loses_no_more_than_half_of_its_words():
    for good, bad in ((10, 10), (10, 11), (30, 3), (12, 60)):
        words = [f"w{i}" for i in range(good)]
        notices = [f"Read more {i}" for i in range(bad // 3)] + ["Impressum"] * (bad % 3)
        figures, base, kept, text, lost = judge("\n".join([" ".join(words), *notices]))
        assert (figures[0], lost, text) == (good + bad, bad, " ".join(words))
        assert kept == (not base and 2 * bad <= good + bad)


def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_bpe_equals_library(spark):
    library = _library()
    rnd = random.Random(2)
    texts = [*data.texts(), "don't I'LL WE'RE it's", "a<|endoftext|>b <|startoftext|>", "<|endoftext", "ΑΣ ΣΑ İs ǅ ﬃ", "한국어 中文 テスト",
             "👩‍👩‍👧 ñ̃", "a" * 5000, "ab" * 3000, "!?" * 900, "\x1c a\x85b ab\x00cd", "Ⅷ ½ ٣ 12345"]
    texts += ["".join(rnd.choice("abcdeinrtsh") for _ in range(n)) for n in (80, 700, 4000)]
    texts += ["".join(chr(rnd.randrange(1, 0x600)) for _ in range(400)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)]
    for row in bpe.bpe_round_trip(data.frame(spark, rows), tokenizer_path(), keep=("g",)).collect():
        ids = library.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids
        assert row["ids"] == ids
        assert row["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.bpe_round_trip(data.frame(spark, []), tokenizer_path()).count() == 0


def test_stream_needs_no_more_than_the_lookahead():
    vocabulary = bpe.Vocabulary(tokenizer_path())
    encoder = bpe.Encoder(vocabulary)
    rnd = random.Random(9)
    for _ in range(20):
        piece = "".join(rnd.choice("theinganrs") for _ in range(3000))
        symbols = list(encoder.symbols(piece))
        pending, most = 0, 0

        def counted():
            nonlocal pending, most
            for s in symbols:
                pending += 1
                most = max(most, pending)
                yield s

        out = []
        for token in encoder.stream(counted()):
            out.append(token)
            pending -= vocabulary.sizes[token]
        assert out == encoder.merged(list(symbols))
        assert most <= 2 * (vocabulary.lookahead + vocabulary.longest) + 1


def test_sufficient_lookahead_of_small_lists():
    assert bpe.sufficient_lookahead([("a", "b")]) == 1
    # whether c follows decides on (b, c), which decides on (a, b)
    assert bpe.sufficient_lookahead([("b", "c"), ("a", "b")]) == 2


def test_decoder_is_incremental():
    vocabulary = bpe.Vocabulary(tokenizer_path())
    encoder, decoder = bpe.Encoder(vocabulary), bpe.Decoder(vocabulary)
    text = "déjà vu, 한국어 👍 it's"
    ids = np.frombuffer(encoder.encode(text), np.int32).tolist()
    out = "".join(map(decoder.push, ids)) + decoder.finish()
    assert out.replace(" ", "") == text.replace(" ", "")
    assert decoder.push(vocabulary.ids[vocabulary.characters[0xC3]]) == ""
    assert decoder.push(vocabulary.special["<|endoftext|>"]) == "�<|endoftext|>"
    assert decoder.push(1 << 20) == ""


@pytest.mark.parametrize("block", [2 << 20, 300])
def test_decontaminate(spark, block):
    pairs = data.rows()
    found = [t for _, t in pairs if t]
    long = found[39].split()
    items = [(1, " ".join(long[5:22]).upper()), (2, "zz " + " ".join(long[40:52])), (10, "one"), (11, None), (12, ""),
             (2, "zz " + " ".join(long[40:52])), (None, " ".join(long[100:112])), (13, " ".join(long[7:19])), (14, "A, b! C"), (15, "?!")]
    benchmark = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, n_words int")
    for row in decontaminate(data.frame(spark, pairs), benchmark, keep=("text", "fp"), block=block).collect():
        n, hit, ids = brute.decontaminate(row["text"], items)
        assert (row["n_words"], sum(s["end"] - s["start"] for s in row["spans"]), row["items"]) == (n, hit, ids)
        assert row["fp"] == 1
    assert decontaminate(data.frame(spark, []), benchmark).count() == 0
    clean = decontaminate(data.frame(spark, pairs), benchmark.limit(0))
    assert clean.filter("size(spans) > 0").count() == 0 and clean.count() == len(pairs)


def _labelled():
    rnd = random.Random(4)
    good = ["The " + " ".join(rnd.choice(["river", "stone", "walks", "under", "green", "light,", "and", "the"]) for _ in range(
        rnd.randrange(20, 90))) + "." for _ in range(260)]
    bad = [" ".join(rnd.choice(["BUY!!", "win$$$", "now###", "| x", "free***"]) for _ in range(rnd.randrange(20, 90))) for _ in range(90)]
    return [(i, t, int(i < 260)) for i, t in enumerate(good + bad)]


def test_quality_scores(spark):
    rows = _labelled()
    docs = data.frame(spark, [(i, t) for i, t, _ in rows] + [(None, "a b"), (9000, None), (0, rows[0][1])])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(3, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = rule_ensemble.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) + 3
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 9000]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in got if r["doc_id"] is not None)
    right = sum(r["predicted"] == (r["doc_id"] < 260) for r in held)
    assert right >= 0.97 * len(held) > 50
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_score_column_is_the_fitted_model(spark):
    rnd = np.random.default_rng(3)
    x = rnd.random((400, len(rule_ensemble.STATISTICS)))
    y = ((x[:, 3] > 0.6) & (x[:, 0] < 0.7)).astype(float)
    model = rule_ensemble.fit(x, y, trees=10)
    df = spark.createDataFrame(x.tolist(), ", ".join(f"{s} double" for s in rule_ensemble.STATISTICS))
    got = np.array([r["s"] for r in df.select(model.score().alias("s")).collect()])
    total = model.bias + sum(w * rule_ensemble._holds(x, c) for c, w in model.rules)
    assert np.allclose(got, 1 / (1 + np.exp(-total)))
    assert ((got >= 0.5) == (y == 1)).mean() > 0.95
    assert rule_ensemble.fit(x[:0], y[:0]).rules == () and rule_ensemble.fit(x, np.ones(400)).rules == ()


def test_empty_and_unlabelled(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert rule_ensemble.quality_scores(data.frame(spark, []), labels).count() == 0
    assert rule_ensemble.quality_scores(data.frame(spark, [(1, "a")]), labels).first()["score"] == pytest.approx(0.5)


def test_queries_carry_the_digests(spark, tmp_path):
    from voxlake.llm import queries

    pairs = data.rows()
    data.frame(spark, pairs).write.parquet(f"{tmp_path}/documents.parquet")
    library = _library()
    by_text = {}
    for _, text in pairs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        by_text[text] = (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(library.decode(ids, skip_special_tokens=False)))
    got = sorted(map(tuple, queries.op3_bpe_round_trip(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((d, *by_text[t]) for d, t in pairs), key=str)
    found = brute.repeats(pairs, lambda t: t.encode().split(), 50, by_place=False)
    want = [(d, len(s), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(s, g, strict=True) if not y)).hexdigest())
            for (d, _), (s, g) in zip(pairs, found, strict=True)]
    assert sorted(map(tuple, queries.op5_substring_dedup(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
