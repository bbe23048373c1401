"""Benchmark decontamination as a prefix-filtered set join.

A window is ten consecutive words of a benchmark item, or all words of a shorter one. Its shingles of three words
(all words of a shorter window) are ordered by rarity, counted over all documents. Exact containment needs every
shingle, so the necessary prefix is one: the rarest shingle, with its place in the window. Documents are joined on
these prefix shingles; a candidate must fit between the document's ends (length bound) at the place that the
shingle's place gives (positional bound), and is then verified word by word over the item-sized window.

Documents are never shuffled. The benchmark is taken in blocks of at most BLOCK bytes of text (a single longer item
is a block of its own), so what is sent to the executors is bounded; every block is joined with all documents.

Words are lower-cased runs of digits, ASCII letters and non-ASCII characters. Null and empty texts and items have
no words. Items with equal windows are all found. Items without an id taint documents but are not listed.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm import arrays
from voxlake.llm.common import whole

WINDOW, SHINGLE = 10, 3
BLOCK = 2 << 20
SIEVE = 1 << 22


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case by byte, and the bytes that are in no word."""
    lower = np.frombuffer(bytes(range(256)).lower(), np.uint8)
    gap = np.ones(256, bool)
    gap[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
    return lower, gap


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts, ends and hashes of the words, and each row's first word."""
    lower, gap = _tables()
    data = lower[data]
    start, end, row = arrays.word_spans(data, offsets, gap)
    bounds = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(offsets) - 1))))
    return data, start, end, arrays.word_hashes(data, start, end), bounds


def _shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of every shingle of that many words within a row."""
    at = arrays.ranges(bounds[:-1], np.maximum(np.diff(bounds) - size + 1, 0))
    mixed = np.zeros(len(at), np.uint64)
    for i in range(size):
        mixed = arrays.mix(mixed * np.uint64(31) + hashes[at + i])
    return at, mixed + np.uint64(size)


class Index:
    """The windows of a block of items, by their prefix shingle."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        self.owners: dict[tuple[bytes, ...], set[str | None]] = defaultdict(set)
        for item, text in items:
            data, start, end, _, _ = _words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            words = [data[s:e].tobytes() for s, e in zip(start, end, strict=True)]
            size = min(WINDOW, len(words))
            for i in range(len(words) - size + 1 if words else 0):
                self.owners[tuple(words[i:i + size])].add(item)
        self.windows = sorted(self.owners)
        self.sizes = np.array([len(w) for w in self.windows], np.int64)
        # shingle, place and window of every shingle
        found = []
        for number, window in enumerate(self.windows):
            joined = b" ".join(window)
            _, _, _, hashes, bounds = _words(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))
            at, shingle = _shingles(hashes, bounds, min(SHINGLE, len(window)))
            found += zip(shingle.tolist(), at.tolist(), [number] * len(at), strict=True)
        self.all = found
        self.kinds = sorted({min(SHINGLE, len(w)) for w in self.windows})
        self.set_keys(np.array(sorted({x[0] for x in found}), np.uint64))

    def set_keys(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.sieve = np.zeros(SIEVE, bool)
        self.sieve[keys % np.uint64(SIEVE)] = True

    def keep_rarest(self, counts: dict[int, int]) -> None:
        """Of each window only its rarest shingle stays (of equally rare ones the first)."""
        best: dict[int, tuple[int, int, int]] = {}
        for shingle, at, window in self.all:
            rank = (counts.get(shingle, 0), at, shingle)
            if window not in best or rank < best[window]:
                best[window] = rank
        entries = sorted((shingle, at, window) for window, (_, at, shingle) in best.items())
        self.entry_at = np.array([e[1] for e in entries], np.int64)
        self.entry_window = np.array([e[2] for e in entries], np.int64)
        self.set_keys(np.unique(np.array([e[0] for e in entries], np.uint64)))
        shingles = np.array([e[0] for e in entries], np.uint64)
        self.first = np.searchsorted(shingles, self.keys, "left")
        self.count = np.searchsorted(shingles, self.keys, "right") - self.first
        self.all = []

    def lookup(self, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in the text and numbers of the shingles of each kind that are among the keys."""
        for size in self.kinds:
            at, shingle = _shingles(hashes, bounds, size)
            near = np.flatnonzero(self.sieve[shingle % np.uint64(SIEVE)])
            number = np.minimum(np.searchsorted(self.keys, shingle[near]), len(self.keys) - 1)
            hit = self.keys[number] == shingle[near]
            yield at[near[hit]], number[hit]


def _count(index: Index):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.keys), np.int64)
        for part in parts:
            data, offsets = arrays.texts(part.column("text"))
            for first, last in arrays.row_chunks(offsets):
                own = offsets[first:last + 1]
                _, _, _, hashes, bounds = _words(data[own[0]:own[-1]], own)
                for _, number in index.lookup(hashes, bounds):
                    total += np.bincount(number, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(index.keys[at].view(np.int64)), pa.array(total[at])], names=["shingle", "n"])
    return run


def _match(index: Index, passed: list[str]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = arrays.texts(part.column("text"))
            rows = part.num_rows
            n_words = np.zeros(rows, np.int64)
            spans = [x or [] for x in part.column("spans").to_pylist()]
            items = [set(x or []) for x in part.column("items").to_pylist()]
            for first, last in arrays.row_chunks(offsets):
                own = offsets[first:last + 1]
                text, start, end, hashes, bounds = _words(data[own[0]:own[-1]], own)
                n_words[first:last] = np.diff(bounds)
                for at, number in index.lookup(hashes, bounds):
                    count = index.count[number]
                    entry = arrays.ranges(index.first[number], count)
                    begin = np.repeat(at, count) - index.entry_at[entry]
                    window = index.entry_window[entry]
                    row = np.searchsorted(bounds, np.repeat(at, count), "right") - 1
                    fits = (begin >= bounds[row]) & (begin + index.sizes[window] <= bounds[row + 1])
                    for b, w, r in zip(begin[fits].tolist(), window[fits].tolist(), row[fits].tolist(), strict=True):
                        words = index.windows[w]
                        n = len(words)
                        if all(text[s:e].tobytes() == x for s, e, x in zip(start[b:b + n], end[b:b + n], words, strict=True)):
                            place = b - int(bounds[r])
                            spans[first + r].append({"start": place, "end": place + n})
                            items[first + r].update(x for x in index.owners[words] if x is not None)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(n) for n in passed), pa.array(n_words),
                 pa.array([_merged(x) for x in spans], SPANS), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                names=[*passed, "n_words", "spans", "items"])
    return run


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merged(spans: list[dict[str, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for s in sorted(spans, key=lambda x: x["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def _blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple[str | None, bytes]]]:
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), whole(F.col("text")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block))
    for number in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        yield [(r["item_id"], r["text"].encode()) for r in own.collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """doc_id, the kept columns, n_words, spans (merged word ranges that windows cover) and items (sorted ids)."""
    text = docs.select("doc_id", whole(F.col("text")).alias("text"), *(F.col(n).alias(f"k{i}") for i, n in enumerate(keep)))
    none = "cast(array() as array<struct<start: bigint, end: bigint>>)"
    out = text.select("*", F.lit(0).cast("long").alias("n_words"), F.expr(none).alias("spans"),
                      F.expr("cast(array() as array<string>)").alias("items"))
    passed = ["doc_id", "text", *(f"k{i}" for i in range(len(keep)))]
    for items in _blocks(benchmark, block):
        index = Index(items)
        if index.windows:
            counts = text.select("text").mapInArrow(_count(index), "shingle long, n long").groupBy("shingle").agg(
                F.sum("n").alias("n")).collect()
            index.keep_rarest({r["shingle"] % (1 << 64): r["n"] for r in counts})
        else:
            index.keep_rarest({})
        out = out.mapInArrow(_match(index, passed), out.schema)
    return out.select("doc_id", *(F.col(f"k{i}").alias(n) for i, n in enumerate(keep)), "n_words", "spans", "items")
