"""Removal of text that repeats across rows, for any kind of symbol.

A window is a fixed number of consecutive symbols of one row. A window is repeated if an equal window comes
earlier in the order of the operator. The operators find anchors (arrays.winnow), and decide for most of them
at once that all windows an anchor answers for are repeated (marks). What is left are anchors whose gram
occurs in several surroundings (checks); here their windows are compared one by one, and the marked windows
are united per row.

Columns: `doc` is the document's id (null: the smallest long) and `h` the text's hash (64 bits): rows may share an id,
and a row is known by both. Rows with equal ids and texts get equal results, so their anchors and marks count once.
`loc` packs the number of windows less one and the first window's start (32 bits).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.arrays import ranges
from voxlake.llm.common import partitions, whole

NO_ID = -(1 << 63)
ANCHOR = "g long, c long, doc long, h long, loc long"
HOT = 20_000


def identified(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc, h and text of each row, with the kept columns as k0, k1, ..."""
    text = whole(F.col("text"))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(text).alias("h"), text.alias("text"),
        *(F.col(name).alias(f"k{i}") for i, name in enumerate(keep)))


def pack(start: np.ndarray, more: np.ndarray) -> np.ndarray:
    return (more << 32) | start


def loc_start(loc: Column) -> Column:
    return loc.bitwiseAND(0xFFFFFFFF)


def unpack(loc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of the first window and number of windows less one."""
    return loc & 0xFFFFFFFF, loc >> 32


def batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in columns.values()], names=list(columns))


def repeated_windows(rows: DataFrame, checks: DataFrame, payload: Callable, hashes: Callable,
                     by_place: bool) -> DataFrame:
    """Windows (doc, h, loc) of the checked anchors that an earlier window equals.

    rows: as identified() gives them. checks: g, doc, h, loc and n, the number of surroundings of this gram. payload:
    from a row's text, and each anchor's start and windows less one, what hashes needs of each anchor. hashes: from such
    payloads and their numbers of windows, the hashes of all windows.
    Earlier is: of a smaller doc, or with by_place also of the same doc and a smaller start. The windows of one
    gram meet in one task, which compares them there; the windows of a gram with more anchors than HOT are
    compared by an aggregation that combines them before its shuffle.
    """

    def payloads(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for part in parts:
            for doc, h, text, found in zip(*(part.column(n) for n in ("doc", "h", "text", "found")), strict=True):
                own = doc.as_py(), h.as_py()
                if own == last:  # the join gives equal rows one after the other
                    continue
                last = own
                entries = found.values.flatten()
                g, loc = (np.asarray(x) for x in entries)
                packed = payload(text.as_buffer(), *unpack(loc))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g), *(pa.array(np.full(len(g), x)) for x in own), pa.array(loc),
                     pa.array(packed, pa.binary())], names=["g", "doc", "h", "loc", "windows"])

    def expanded(group: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """The anchors' columns, and of every window its anchor, place after the anchor's first, start and hash."""
        g, doc, h, loc = (np.asarray(group.column(x)) for x in ("g", "doc", "h", "loc"))
        own, more = unpack(loc)
        row = np.repeat(np.arange(len(g)), more + 1)
        step = ranges(np.zeros(len(g), np.int64), more + 1)
        return g, doc, h, more, row, step, own[row] + step, hashes(group.column("windows"), more + 1)

    def every_window(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            g, doc, h, _, row, _, start, window = expanded(part)
            yield batch(g=g[row], w=window, doc=doc[row], h=h[row], loc=start)

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_grams(parts):
            g, doc, h, more, row, step, start, window = expanded(group)
            late = later(g[row], window, doc[row], start if by_place else None)
            # consecutive late windows of an anchor become one mark
            first = late & ~(np.concatenate(([False], late[:-1])) & (step > 0))
            last = late & ~(np.concatenate((late[1:], [False])) & (step < more[row]))
            at, to = np.flatnonzero(first), np.flatnonzero(last)
            yield batch(doc=doc[row[at]], h=h[row[at]], loc=pack(start[at], to - at))

    def sent(some: DataFrame) -> DataFrame:
        per_row = some.groupBy("doc", "h").agg(F.collect_set(F.struct("g", "loc")).alias("found"))
        return rows.select("doc", "h", "text").join(per_row.hint("merge"), ["doc", "h"]).select(
            "doc", "h", "text", "found").mapInArrow(payloads, "g long, doc long, h long, loc long, windows binary")

    compared = sent(checks.filter(F.col("n") <= HOT)).repartition(partitions(rows), "g").sortWithinPartitions(
        "g").mapInArrow(compare, "doc long, h long, loc long")
    open_ = sent(checks.filter(F.col("n") > HOT)).mapInArrow(every_window, "g long, w long, doc long, h long, loc long")
    when = F.struct("doc", loc_start(F.col("loc")).alias("start")) if by_place else F.struct("doc")
    earliest = open_.groupBy("g", "w").agg(F.min(when).alias("earliest"))
    late = open_.join(earliest, ["g", "w"]).filter(when > F.col("earliest"))
    return compared.unionByName(late.select("doc", "h", "loc"))


def whole_grams(parts: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.Table]:
    """Batches sorted by g, as tables that hold all of a gram's rows that are in this task."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        held.append(part)
        if sum(x.num_rows for x in held) >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            g = np.asarray(table.column("g"))
            end = int(np.searchsorted(g, g[-1], "left"))
            if end:
                yield table.slice(0, end)
                held = table.slice(end).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def later(g: np.ndarray, window: np.ndarray, doc: np.ndarray, start: np.ndarray | None) -> np.ndarray:
    """Of each window, whether an equal one comes earlier."""
    order = np.lexsort(((doc, window, g) if start is None else (start, doc, window, g)))
    g, window, doc = g[order], window[order], doc[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (window[1:] != window[:-1])
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    after = doc != doc[head]
    if start is not None:
        start = start[order]
        after |= start != start[head]
    out = np.empty(len(order), bool)
    out[order] = after
    return out


def covered(locs: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of symbols that the marked windows cover."""
    start, more = unpack(locs)
    order = np.argsort(start)
    start, end = start[order], np.minimum((start + more + length)[order], size)
    reach = np.maximum.accumulate(end)
    fresh = np.ones(len(start), bool)
    fresh[1:] = start[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return start[at], reach[np.concatenate((at[1:] - 1, [len(start) - 1]))] if len(at) else reach


def with_marks(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Each row with the set of its marks (null for none)."""
    per_row = marks.groupBy("doc", "h").agg(F.collect_set("loc").alias("marks"))
    return rows.join(per_row, ["doc", "h"], "left")
