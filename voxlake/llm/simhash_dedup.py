"""Near duplicates by SimHash, with Golay-code fuzzy hashing as the candidate search.

A fingerprint's 64 bits are cut into segments of 23, 23 and 18 bits (the last filled up with zeros). The binary
Golay code [23, 12] is perfect: every 23-bit word is within 3 bits of one codeword. The codewords within 4 bits
of a segment number 1 or 6, and two segments that differ in at most 2 bits always have one of them in common,
since some word lies within 1 bit of both. A codeword's 12 message bits are its index.

Pigeonhole: of 4 differing bits over three segments, either one segment has none, and then one of the other two
has at most 2: keys are a segment as it is with an index of another (6 ordered pairs). Or each segment has one or
two, and at least two segments one: keys are an index of each of the three. Where two words differ in one bit, the
nearest codeword of either is within 4 bits of the other; so of the two segments with one bit, one fingerprint's
nearest codeword serves in the first and the other's in the second, and only triples with a nearest codeword among
them are needed. That is about 100 keys of 30 to 36 bits for each different fingerprint, so that chance companions
stay rare. Fingerprints that share a key are compared, and links are kept from 4 bits down.

Keys are sorted once and never counted or joined, as most have one fingerprint only. A bucket of a key is walked
breadth first in one task and gives links to its components' first members only, never pairs. A bucket with more than
CAP fingerprints is passed on piece by piece and dealt as pairs of blocks, so a task holds at most two.

Null and empty texts have fingerprint zero and are linked like any other. Equal fingerprints are one node, so
copies cost nothing beyond their fingerprint. A component's id is its smallest doc_id; null ids come into
account only where a component has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import cut, partitions, whole
from voxlake.llm.components import components

SHINGLE, SEED, BITS = 4, 42, 4
CAP = 4096
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
SEGMENTS = ((0, 23), (23, 23), (46, 18))
MIXED = 6


def fingerprint(text: bytes) -> int:
    """SimHash over the text's shingles of four words (fewer words: all of them as one)."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[SHINGLE - 1:] if len(words) >= SHINGLE else ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(last)
    for at in range(0, n, 1 << 16):
        spans = zip(starts[at:min(n, at + (1 << 16))].tolist(), last[at:at + (1 << 16)].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        found = np.array([fingerprint(t.as_buffer().to_pybytes()) for t in part.column("text")], np.uint64)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), pa.array(found.view(np.int64))],
                                         names=["doc_id", "node", "fp"])


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The syndrome of each low 12-bit and high 11-bit half of a word, and the flips of each syndrome.

    Flips are the errors of weight up to 4 with that syndrome: six, or one six times.
    """
    unit = []
    value = 1
    for _ in range(23):
        unit.append(value)
        value <<= 1
        if value >> 11:
            value ^= GENERATOR
    low, high = (np.zeros(1 << n, np.int64) for n in (12, 11))
    for bit in range(23):
        table, at = (low, bit) if bit < 12 else (high, bit - 12)
        table[np.flatnonzero(np.arange(len(table)) >> at & 1)] ^= unit[bit]
    flips: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= unit[b]
            known = flips[syndrome]
            if weight < 4 or bin(known[0]).count("1") == 3:
                known.append(sum(1 << b for b in bits))
    return low, high, np.array([(f * 6)[:6] for f in flips], np.int64)


_golay: list[np.ndarray] = []


def codeword_indices(segment: np.ndarray) -> np.ndarray:
    """The indices of the codewords within 4 bits of each 23-bit segment, in six columns (one may fill all)."""
    if not _golay:
        _golay.extend(golay_tables())
    low, high, flips = _golay
    syndrome = low[segment & 0xFFF] ^ high[segment >> 12]
    # the code is cyclic: 12 bits of a codeword, next to each other, determine it
    return (segment[:, None] ^ flips[syndrome]) >> 11


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of unsigned fingerprints, and of each key the place of its fingerprint."""
    parts = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    index = [codeword_indices(p) for p in parts]
    single = [i[:, 0] == i[:, 1] for i in index]
    keys, rows = [], []
    place = np.arange(len(fp))
    for kind, (exact, fuzzy) in enumerate(permutations(range(3), 2)):
        for k in range(6):
            at = place if k == 0 else place[~single[fuzzy]]
            keys.append(kind << 40 | parts[exact][at] << 12 | index[fuzzy][at, k])
            rows.append(at)
    for choice in product(range(6), repeat=3):
        if 0 in choice:  # the first index is the nearest codeword's
            at = place[np.logical_and.reduce([~s | (k == 0) for s, k in zip(single, choice, strict=True)])]
            i, j, k = (x[at, c] for x, c in zip(index, choice, strict=True))
            keys.append(MIXED << 40 | i << 24 | j << 12 | k)
            rows.append(at)
    return np.concatenate(keys), np.concatenate(rows)


def _keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        fp = np.asarray(part.column("fp"))
        for at in range(0, len(fp), 4096):
            own = fp[at:at + 4096]
            keys, rows = golay_keys(own.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[rows])], names=["key", "fp"])


def star_links(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint of a bucket with the first one of its component within the bucket."""
    root = np.arange(len(fp))
    unseen = np.arange(len(fp))
    while len(unseen):
        first, unseen = unseen[0], unseen[1:]
        queue = [first]
        while queue and len(unseen):
            near = np.bitwise_count(fp[unseen] ^ fp[queue.pop()]) <= bits
            if near.any():
                root[unseen[near]] = first
                queue.extend(unseen[near])
                unseen = unseen[~near]
    at = np.flatnonzero(root != np.arange(len(fp)))
    return fp[at], fp[root[at]]


def _links(bits: int, cap: int | None = None, small: int = 24, rows: int = 200_000):
    """Links (a, b) of the fingerprints of each key; of a key with over `cap` the fingerprints a, with their key."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = None
        for key, fp in _whole_keys(parts, cap, rows):
            links = [(fp[:0], fp[:0])]
            change = np.flatnonzero(np.diff(key)) + 1
            start = np.concatenate(([0], change))
            size = np.diff(np.concatenate((start, [len(key)])))
            over = np.zeros(len(size), bool) if cap is None else (size > cap) | (key[start] == passed)
            if over.any():
                passed = key[start[over][-1]]
                on = np.repeat(over, size)
                yield _link_rows(fp[on], None, key[on])
                key, fp, size = key[~on], fp[~on], size[~over]
                start = np.cumsum(size) - size
            big = np.repeat(size > small, size)
            for step in range(1, min(small, len(key))):
                at = np.flatnonzero((key[step:] == key[:-step]) & ~big[step:])
                if not len(at):
                    break
                at = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= bits]
                links.append((fp[at + step], fp[at]))
            for s, n in zip(start[size > small].tolist(), size[size > small].tolist(), strict=True):
                links.append(star_links(np.unique(fp[s:s + n]), bits))
            a, b = (np.concatenate(x) for x in zip(*links, strict=True))
            pairs = np.unique(np.stack((a, b)), axis=1)
            yield _link_rows(pairs[0], pairs[1], None)
    return run


def _link_rows(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(a.view(np.int64)), none if b is None else pa.array(b.view(np.int64)), none if key is None else pa.array(key)],
        names=["a", "b", "key"])


def _whole_keys(parts: Iterator[pa.RecordBatch], cap: int | None, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches sorted by key, as arrays that hold all of a key's rows; with a cap, a longer key may come in pieces, of
    which the first is longer than the cap."""
    keys, fps = [], []

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(keys), np.concatenate(fps).view(np.uint64)

    for part in parts:
        keys.append(np.asarray(part.column("key")))
        fps.append(np.asarray(part.column("fp")))
        if sum(map(len, keys)) >= rows:
            key, fp = joined()
            end = int(np.searchsorted(key, key[-1], "left"))
            if cap is not None and len(key) - end > cap:
                end = len(key)
            keys, fps = [key[end:]], [fp[end:].view(np.int64)]
            if end:
                yield key[:end], fp[:end]
    if keys and sum(map(len, keys)):
        yield joined()


def near_links(nodes: DataFrame, bits: int = BITS, cap: int = CAP) -> DataFrame:
    """Links (a, b) that connect all fingerprints `fp` of nodes within that many bits, without the pairs."""
    def walked(rows: DataFrame, most: int | None) -> DataFrame:
        return rows.select("key", "fp").repartition(partitions(nodes), "key").sortWithinPartitions("key").mapInArrow(
            _links(bits, most), "a long, b long, key long")

    # few bytes become many keys: dealt evenly first, by an expression that the grouping before does not deal by
    keys = nodes.select("fp").repartition(partitions(nodes), F.xxhash64("fp")).mapInArrow(_keys, "key long, fp long")
    first = cut(walked(keys, cap).distinct())
    passed = first.filter("key is not null").select("key", F.col("a").alias("fp"))
    blocks = F.ceil(F.col("n") / cap).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # a row of block i goes to the pairs (i, 0), (i, 1), ...
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(F.col("own"), j) * F.col("blocks")
                        + F.greatest(F.col("own"), j))
    dealt = passed.join(passed.groupBy("key").agg(F.count("*").alias("n")), "key").withColumn("blocks", blocks).withColumn(
        "own", own).select("fp", "key", F.explode(meets).alias("pair")).withColumn("key", F.xxhash64("key", "pair"))
    return first.filter("key is null").unionByName(walked(dealt, None)).select("a", "b")


def _labelled(docs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, node, fp), node being the text's hash, and fingerprints with their component's root and their
    smallest doc_id, least."""
    if bits > BITS:
        raise ValueError(f"the keys find all links of {BITS} bits, not of {bits}")
    text = whole(F.col("text"))
    found = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("node"),
                            text.alias("text")).mapInArrow(_fingerprints, "doc_id long, node long, fp long"))
    nodes = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(nodes, bits))
    return found, nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))


def text_links(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) of the hashes of different texts: each of a component with the component's smallest one."""
    found, linked = _labelled(docs, bits)
    nodes = found.select("node", "fp").distinct().join(linked.select("fp", "root"), "fp").select("node", "root")
    first = nodes.groupBy("root").agg(F.min("node").alias("b"), F.count("*").alias("n")).filter("n > 1")
    return nodes.join(first, "root").filter("node <> b").select(F.col("node").alias("a"), "b")


def simhash_dedup(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row."""
    found, linked = _labelled(docs, bits)
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = linked.join(ids, "root").select("fp", "component_id")
    return found.join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
