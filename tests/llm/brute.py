"""Plain versions of the operators, for small fixtures."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(0x41, 0x5B)}


def sha(value):
    return hashlib.sha256(value if isinstance(value, bytes) else value.encode()).hexdigest()


def fingerprint(text):
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, bits=4):
    """The index of each print's component's first member."""
    prints = np.array(prints, np.uint64)
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1:] ^ prints[i]) <= bits) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    count = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    repeated = set()
    for i in range(len(words) - 4):
        if count[tuple(words[i:i + 5])] > 1:
            repeated.update(range(i, i + 5))
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(repeated),
            len(words) < 10 or 100 * len(repeated) > 20 * len(words))


def repeats(rows, symbols, length, by_place):
    """Per row of (doc_id, text): its symbols and which of them go."""
    rows = [(-(1 << 63) if d is None else d, symbols(t or "")) for d, t in rows]
    first = {}
    for doc, s in rows:
        for p in range(len(s) - length + 1):
            key, place = tuple(s[p:p + length]), (doc, p)
            first[key] = min(first.get(key, place), place)
    out = []
    for doc, s in rows:
        gone = [False] * len(s)
        for p in range(len(s) - length + 1):
            earlier = first[tuple(s[p:p + length])]
            if (earlier < (doc, p)) if by_place else (earlier[0] < doc):
                gone[p:p + length] = [True] * length
        out.append((s, gone))
    return out


def decontaminate(text, items):
    """n_words, n_hit and sorted item ids of a text against (item_id, text)."""
    owners = defaultdict(set)
    for item, content in items:
        words = BENCH_WORD.findall((content or "").translate(UPPER))
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            owners[tuple(words[i:i + n])].add(item)
    words = BENCH_WORD.findall((text or "").translate(UPPER))
    hit, found = set(), set()
    for n in {len(k) for k in owners}:
        for i in range(len(words) - n + 1):
            own = owners.get(tuple(words[i:i + n]))
            if own:
                hit.update(range(i, i + n))
                found |= own
    return len(words), len(hit), sorted(str(x) for x in found if x is not None)
