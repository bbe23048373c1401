import random
import re
import zlib
from collections import Counter

import llm.brute as brute
import llm.data as data
import numpy as np
import pytest

from voxlake.llm import spelling_variants as spell


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _plain(pairs, min_length=6, min_count=5, ratio=5, damage=199):
    count = Counter()
    for doc, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(brute.UPPER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            count[run[:h % len(run)] + run[h % len(run) + 1:] if h % damage == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= min_length and n >= min_count}
    out = {}
    for w, n in words.items():
        near = [x for x in words if _near(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        out[w] = [best if best is not None and words[best] >= ratio * n else None, w, n, len(near)]
    for w, own in out.items():
        while out[own[1]][0] is not None:
            own[1] = out[own[1]][0]
        own.append(words.get(own[0]))
    return sorted((w, *own) for w, own in out.items())


def _texts():
    """Words with misspelt forms of ever smaller counts, and words that share a half."""
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdeéÿ") for _ in range(rnd.randrange(5, 11))) for _ in range(60)]
    counts = Counter({w: rnd.choice((5, 30, 200)) for w in words})
    for w in words:
        for _ in range(6):
            at = rnd.randrange(len(w))
            counts[rnd.choice((w[:at] + w[at + 1:], w[:at] + "q" + w[at:], w[:at] + "z" + w[at + 1:]))] += rnd.choice((1, 5, 7))
    counts.update({"chainaa": 5, "chainab": 40, "chainbb": 250, "chaincb": 1600, "same" + "x" * 40: 6, "same" + "x" * 41: 6})
    counts.update({f"prefix{a}{b}": 5 for a in "abcdefg" for b in "abcdefg"})
    every = [w for w, n in counts.items() for _ in range(n)]
    rnd.shuffle(every)
    joins = [" ", "-", "\n", "×9", "1"]
    return ["".join(w.title() + rnd.choice(joins[:3] + joins[4:]) if rnd.random() < 0.1 else w + " " for w in every[i:i + 50])
            for i in range(0, len(every), 50)]


@pytest.mark.parametrize("batch", [2048, 5])
def test_variants_equal_plain_ones(spark, batch):
    pairs = list(enumerate(_texts())) + [(None, "Chainsaw chainsaw"), (None, None), (7, ""), (7, "Ünïcödé ÷÷÷÷÷÷÷")] + data.rows()
    out = spell.spelling_variants(data.frame(spark, pairs), damage=199, batch=batch)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted(map(tuple, out.collect()))
    want = _plain(pairs)
    assert got == want
    assert sum(w[1] is not None for w in want) > 30 and any(w[2] not in (w[0], w[1]) for w in want)


def test_other_bounds_and_no_damage(spark):
    pairs = list(enumerate(_texts()[:30]))
    got = sorted(map(tuple, spell.spelling_variants(data.frame(spark, pairs), min_length=2, min_count=2, ratio=3).collect()))
    assert got == _plain(pairs, 2, 2, 3, 1 << 40)
    with pytest.raises(ValueError):
        spell.spelling_variants(data.frame(spark, pairs), ratio=1)


def test_empty_table(spark):
    assert spell.spelling_variants(data.frame(spark, [])).count() == 0


def test_bitsets_find_all_near_words():
    rnd = random.Random(3)
    for letters in ("ab", "abcé", "abcdefgÿ"):
        words = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9))) for _ in range(300)})
        rnd.shuffle(words)
        a, b = spell.near_words(words)
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [
            (i, j) for i, v in enumerate(words) for j, w in enumerate(words) if _near(v, w)]
    assert not len(spell.near_words(["x" * 5000, "y"])[0]) and np.array_equal(spell.near_words(["x" * 500, "x" * 501])[0], [1, 0])
