import random

import llm.data as data
import numpy as np
import pytest
import sentencepiece

import llm.brute as brute
from voxlake.llm import sentencepiece_bpe as piece
from voxlake.llm.queries import op12_sentencepiece, tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return piece.Model(PATH)


def _strings(model):
    rnd = random.Random(1)
    pools = ["ab ▁", "▁  a", "abcdefghijklmnopqrstuvwxyz      ", "éèüßñ àÿ日本語中文字𝒳😀\x00�​\n\t ", "0123456789 .,-",
             "the of and ing tion er  "]
    pieces = sorted(model.ids)
    for i in range(1500):
        if i % 5:
            pool = rnd.choice(pools)
            yield "".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 80)))
        else:
            yield "".join(rnd.choice(pieces) for _ in range(8)).replace("▁", rnd.choice([" ", "", "▁"]))
    yield from (" ", "  ", "▁", " " * 50 + "x" + " " * 40, "y" * 30_000, "abcdefgh" * 3000, "ab " * 3000, "<s></s><unk><0x41>")


def _ids(encoder, text):
    return np.frombuffer(encoder.encode_all([text])[0], np.int32)


@pytest.mark.parametrize("cache", [piece.CACHE, 7])
def test_encoding_equals_the_library(library, model, cache):
    encoder = piece.Encoder(model, cache)
    texts = list(_strings(model))[::1 if cache > 7 else 9]
    assert [_ids(encoder, t).tolist() for t in texts] == library.encode(texts)
    assert [np.frombuffer(x, np.int32).tolist() for x in piece.Encoder(model, cache).encode_all(texts)] == library.encode(texts)


def test_a_full_table_starts_anew(library, model):
    encoder = piece.Encoder(model)
    encoder.fits = piece.Fits(6)
    texts = list(_strings(model))[:400]
    assert [np.frombuffer(x, np.int32).tolist() for x in encoder.encode_all(texts)] == library.encode(texts)


def test_a_sequence_is_right_if_and_only_if_its_neighbours_are(model):
    encoder = piece.Encoder(model)
    assert encoder.compatible("", "▁the") and encoder.compatible("▁the", "▁of") and not encoder.compatible("▁", "the")
    assert encoder.pieces("▁the") == ["▁the"] and encoder.pieces("▁" * 37) == ["▁" * 16, "▁" * 16, "▁" * 5]


def test_decoding_equals_the_library(library, model):
    rnd = random.Random(2)
    encoder = piece.Encoder(model)
    lists = [_ids(encoder, t) for t in _strings(model)]
    for _ in range(3000):  # any ids: broken characters, control ids between bytes, unknown ids
        lists.append(np.array([rnd.choice([rnd.randrange(32_000), rnd.randrange(270), rnd.randrange(190, 262)])
                               for _ in range(rnd.randrange(0, 20))], np.int32))
    assert [piece.decode(model, x) for x in lists] == [library.decode(x.tolist()) for x in lists]


def test_round_trip_of_rows(spark, library):
    pairs = data.rows()
    out = piece.piece_round_trip(data.frame(spark, pairs), PATH, keep=("g", "source"))
    assert out.columns == ["doc_id", "g", "source", "ids", "decoded"]
    want = [(d, "g", "s", library.encode(t or "", add_eos=True), library.decode(library.encode(t or "", add_eos=True))) for d, t in pairs]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert piece.piece_round_trip(data.frame(spark, [(1, None)]), PATH, end=False).first()["ids"] == []
    assert piece.piece_round_trip(data.frame(spark, []), PATH).count() == 0


def test_query_carries_the_digests(spark, library, tmp_path):
    pairs = data.rows()
    data.frame(spark, pairs).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc, text in pairs:
        ids = library.encode(text or "", add_eos=True)
        want.append((doc, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(library.decode(ids))))
    assert sorted(map(tuple, op12_sentencepiece(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_models_of_another_kind_are_refused(tmp_path):
    with open(PATH, "rb") as file:
        content = file.read()
    broken = tmp_path / "unigram.model"
    broken.write_bytes(content.replace(b"tok_v0\x18\x02", b"tok_v0\x18\x01"))
    with pytest.raises(ValueError):
        piece.Model(str(broken))
