"""Spelling variants of words, from a bit-sliced position index.

Words are counted in Arrow batches and once more by their text. Two words are near if one inserted, deleted or replaced
character makes them equal. Candidates come by pigeonhole: where the longer of two near words has M characters, the
M - 1 others lie in front of the edit or behind it, so the two share their first M // 2 characters or their last. A word
thus has four keys: its own length and the next one as M, front and back. Words of a key meet in one batch; a batch has
many small keys, and a key of more than BATCH words is dealt as pairs of blocks.

In a batch an index has one bitset over its words for each position and letter. All its words are looked up at once,
letter by letter, 64 words at a time: one bitset of each word tracks the words that are equal so far, three others those
with one error, which is a replaced letter (same position), an extra letter of theirs (position shifted up) or a missing
one (shifted down). A near pair is taken in one key only (in front where both are shared), and only a word's number of
near words and its best one leave the task, never pairs.

A word's form is its most frequent near word (ties: the first by code point) if that is RATIO times as frequent, else
null. Counts rise along forms, so they end; roots are found by pointer jumping in as many rounds as the highest count
allows.

Null and empty texts have no words. Null ids count as empty text in the checksum that chooses damaged runs. Repeated rows
count once each. Other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import cut, partitions, whole

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
BATCH = 2048
COUNTED = 200_000


def _counts(min_length: int, damage: int | None):
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % min_length)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                              names=["word", "n"])

        total: Counter[str] = Counter()
        for part in parts:
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                # of bytes only A-Z are lower-cased; a run that is long enough is found whole
                own = Counter(runs.findall(text.as_buffer().to_pybytes().lower().decode()))
                if damage:
                    start = zlib.crc32(b":" if doc is None else b"%d:" % doc)
                    for word in list(own):
                        h = zlib.crc32(word.encode(), start)
                        if h % damage == 0:
                            n, at = own.pop(word), h % len(word)
                            if len(word) > min_length:
                                total[word[:at] + word[at + 1:]] += n
                total.update(own)
                if len(total) >= COUNTED:
                    yield batch()
                    total.clear()
        yield batch()
    return run


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int | None = None) -> DataFrame:
    """word and n of the words of at least so many characters and occurrences.

    With damage, a run loses one character if that number divides the checksum of its id and text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    return rows.mapInArrow(_counts(min_length, damage), "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def near_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (both ways) of places of near words, by bitsets over the words."""
    size = np.array([len(w) for w in words])
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size)
    lanes = (len(words) + 63) // 64
    bit = np.uint64(1) << (np.arange(len(words)) % 64).astype(np.uint64)

    def bitsets(kind: np.ndarray, kinds: int, member: np.ndarray) -> np.ndarray:
        table = np.zeros((kinds, lanes), np.uint64)
        np.bitwise_or.at(table, (kind, member // 64), bit[member])
        return table

    # the index: a bitset for each (position, letter) that is there, and an empty one for all others
    keys, kind = np.unique(place << 21 | letters, return_inverse=True)
    index = np.vstack((bitsets(kind, len(keys), row), np.zeros((1, lanes), np.uint64)))
    lengths = bitsets(size, int(size.max()) + 2, np.arange(len(words)))

    def sets(at: np.ndarray, position: int, letter: np.ndarray) -> np.ndarray:
        key = position << 21 | letter
        found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return index[np.where(keys[found] == key, found, len(keys))]

    start = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")  # longest first: those still being read are the first ones
    falling = size[order]
    equal = np.full((len(words), lanes), np.iinfo(np.uint64).max)
    replaced, longer, shorter = (np.zeros((len(words), lanes), np.uint64) for _ in range(3))
    for position in range(int(size.max())):
        active = int(np.searchsorted(-falling, -position, "left"))
        at = order[:active]
        letter = letters[start[at] + position]
        here, after = sets(at, position, letter), sets(at, position + 1, letter)
        now = equal[:active]
        replaced[:active] = replaced[:active] & here | now & ~here
        longer[:active] = (longer[:active] | now) & after
        shorter[:active] = now | (shorter[:active] & sets(at, position - 1, letter) if position else np.uint64(0))
        equal[:active] = now & here
    near = replaced & lengths[falling] | (longer | equal) & lengths[falling + 1] | shorter & lengths[falling - 1]
    some = np.flatnonzero(near.any(axis=1))
    a, b = np.nonzero(np.unpackbits(near[some].view(np.uint8), axis=1, bitorder="little"))
    return order[some[a]], b


def _matches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word of a key that has near words there: their number, and the best one."""
    names = ("key", "word", "n", "own", "diagonal")

    def matched(columns: list[list]) -> pa.RecordBatch:
        key, words, n, own, diagonal = columns
        a, b = near_words(words)
        found: dict[tuple[str, str], list] = {}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if key[x] != key[y] or not (diagonal[x] or own[x] != own[y]):
                continue
            longest, side = int(key[x][:9]), key[x][9]
            v, w = words[x], words[y]
            if longest != max(len(v), len(w)) or side == "b" and v[:longest // 2] == w[:longest // 2]:
                continue
            best = found.setdefault((key[x], v), [0, n[y], w])
            best[0] += 1
            if (-n[y], w) < (-best[1], best[2]):
                best[1:] = n[y], w
        return pa.RecordBatch.from_arrays(
            [pa.array([k[1] for k in found], pa.string()), pa.array([f[0] for f in found.values()], pa.int64()),
             pa.array([f[1] for f in found.values()], pa.int64()), pa.array([f[2] for f in found.values()], pa.string())],
            names=["word", "n_near", "best_n", "best"])

    held: list[list] = [[] for _ in names]
    for part in parts:
        for column, more in zip(held, names, strict=True):
            column.extend(part.column(more).to_pylist())
        while len(held[0]) >= BATCH:
            # whole keys only: a key has at most two blocks of about BATCH words
            end = next((i for i in range(min(BATCH, len(held[0]) - 1), 0, -1) if held[0][i] != held[0][i - 1]), 0)
            if not end:
                end = next((i for i in range(BATCH, len(held[0])) if held[0][i] != held[0][i - 1]), 0)
                if not end:
                    break
            yield matched([c[:end] for c in held])
            held = [c[end:] for c in held]
    if held[0]:
        yield matched(held)


def near_counts(words: DataFrame, batch: int = BATCH) -> DataFrame:
    """word, n_near, and n and text of the best near word, of each word (word, n) that has near ones."""
    size = F.length("word")
    sides = [F.struct(m.alias("m"), F.lit(s).alias("side")) for m in (size, size + 1) for s in ("a", "b")]
    half = F.floor(F.col("k.m") / 2).cast("int")
    part = F.when(F.col("k.side") == "a", F.substr("word", F.lit(1), half)).otherwise(
        F.when(half > 0, F.substr("word", size - half + 1, half)).otherwise(""))
    keys = words.select("word", "n", F.explode(F.array(*sides)).alias("k")).select(
        F.concat(F.lpad(F.col("k.m").cast("string"), 9, "0"), "k.side", part).alias("key"), "word", "n")
    many = cut(keys.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"))
    blocks = F.ceil(F.col("members") / batch).cast("int")
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    # a row of block i goes to the pairs (i, 0), (i, 1), ...; one block: to (0, 0)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pair = F.concat(F.lit("|"), F.least("own", "other"), F.lit("|"), F.greatest("own", "other"))
    dealt = keys.join(many, "key").withColumn("blocks", blocks).withColumn("own", own).withColumn("other", other).select(
        F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.concat("key", pair)).alias("key"), "word", "n", "own",
        (F.col("own") == F.col("other")).alias("diagonal"))
    found = dealt.repartition(partitions(words), "key").sortWithinPartitions("key").mapInArrow(
        _matches, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best"))


def _roots(links: DataFrame, rounds: int) -> DataFrame:
    """word and root of the words that have a form, from (word, up): each round doubles the steps that up has gone."""
    for _ in range(rounds):
        further = links.select(F.col("word").alias("up"), F.col("up").alias("further"))
        links = cut(links.join(further, "up", "left").select("word", F.coalesce("further", "up").alias("up")))
    return links.withColumnRenamed("up", "root")


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO,
                      damage: int | None = None, batch: int = BATCH) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word."""
    if ratio < 2:
        raise ValueError("counts must rise along forms")
    words = cut(word_counts(docs, min_length, min_count, damage))
    is_form = F.col("best_n") >= ratio * F.col("n")
    judged = cut(words.join(near_counts(words, batch), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"),
        F.when(is_form, F.col("best_n")).alias("form_n")))
    # n grows by the ratio with each step, so steps are as many as its logarithm
    highest, steps = judged.agg(F.max("n")).first()[0] or 0, 0
    while min_count * ratio ** (steps + 1) <= highest:
        steps += 1
    links = judged.filter("form is not null").select("word", F.col("form").alias("up"))
    roots = _roots(links, max(steps - 1, 0).bit_length())
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
