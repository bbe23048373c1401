"""Removal of repeated byte strings with a sparse suffix array, built by sampled splitters.

The suffixes are those that start at anchors: of each 100-byte string the place of its smallest 16-byte gram,
by hash. Equal strings have equal anchors at equal places, so every repeat shows among these suffixes, of which
there are about one in 43 bytes. A sample of them gives splitters on their leading bytes, and the suffixes are
dealt into these ranges. Each range is sorted locally by multikey quicksort (8 bytes are one key character: the
two leading ones, then a hash of all bytes an anchor answers for), and neighbours are compared: a suffix whose
surroundings equal those of an earlier one is a repeat; suffixes with equal leading bytes in different
surroundings are compared window by window (repeats.repeated_windows). A range of one key that is larger than
a bucket is subdivided over several, and its suffixes are compared across these boundaries by an aggregation.

Strings are judged on the input: earlier means a smaller doc_id, or the same doc_id and a smaller start. Null,
empty and shorter texts stay whole. Repeated rows with one doc_id have equal starts, so none is earlier. A null
doc_id counts as smaller than any other, and rows that share an id are each judged by their own text. Other columns
than those in `keep` are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm import arrays, repeats
from voxlake.llm.common import cut

WINDOW, GRAM = 100, 16
SAMPLE, SLICE = 16, 4096
BUCKET = 300_000


def _range_key(lead: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Five leading bytes, then bits of a hash of all sixteen: ordered by the former, equal for equal grams."""
    low = arrays.mix(lead ^ arrays.mix(rest + np.uint64(1)))
    return ((lead >> np.uint64(24) << np.uint64(23)) | (low >> np.uint64(41))).astype(np.int64)


def _leading(data: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    eight = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))
    return eight[place].astype(np.uint64), eight[place + 8].astype(np.uint64)


def _sampled(window: int, sample: int):
    """Range keys of the anchors in one of so many slices of the texts, long texts or short ones alike."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = arrays.texts(part.column("text"))
            doc, h = (np.asarray(part.column(n)).view(np.uint64) for n in ("doc", "h"))
            size = np.diff(offsets)
            slices = -(-size // SLICE)
            row = np.repeat(np.arange(len(size)), slices)
            number = arrays.ranges(np.zeros(len(size), np.int64), slices)
            at = np.flatnonzero(arrays.mix(arrays.mix(doc ^ h)[row] + number.astype(np.uint64)) % np.uint64(sample) == 0)
            row, start = row[at], number[at] * SLICE
            long = np.minimum(SLICE + window - 1, size[row] - start)
            for first, last in arrays.row_chunks(np.concatenate(([0], np.cumsum(long)))):
                own = data[arrays.ranges(offsets[row[first:last]] + start[first:last], long[first:last])]
                bounds = np.concatenate(([0], np.cumsum(long[first:last])))
                for place, *_ in arrays.winnow_rows(own, bounds, window, GRAM):
                    if len(place):
                        yield repeats.batch(key=_range_key(*_leading(own, place)))
    return run


def _suffixes(window: int, splitters: np.ndarray):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = arrays.texts(part.column("text"))
            doc, h = np.asarray(part.column("doc")), np.asarray(part.column("h"))
            for first, last in arrays.row_chunks(offsets):
                bounds = offsets[first:last + 1] - offsets[first]
                own = data[offsets[first]:offsets[last]]
                for place, lo, hi, _, c in arrays.winnow_rows(own, bounds, window, GRAM):
                    if not len(place):
                        continue
                    lead, rest = _leading(own, place)
                    key = _range_key(lead, rest)
                    row = np.searchsorted(bounds, lo, "right") - 1
                    loc = repeats.pack(lo - bounds[row], hi - lo)
                    left, right = (np.searchsorted(splitters, key, s) for s in ("left", "right"))
                    hot = right - left > 1
                    salt = arrays.mix(arrays.mix(doc[first + row].view(np.uint64) ^ h[first + row].view(np.uint64)) ^ loc.view(np.uint64))
                    bucket = np.where(hot, left + 1 + (salt >> np.uint64(33)).astype(np.int64)
                                      % np.maximum(right - left, 1), right)
                    yield repeats.batch(bucket=bucket * 2 + hot, lead=lead, rest=rest, c=c, doc=doc[first + row],
                                        h=h[first + row], loc=loc)
    return run


def multikey_sort(lanes: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their lanes: sort by one, then only runs of equal rows by the next."""
    order = np.argsort(lanes[0], kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = lanes[0][order[1:]] != lanes[0][order[:-1]]
    for lane in lanes[1:]:
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        run, rows = np.cumsum(fresh)[at], order[at]
        order[at] = rows[np.lexsort((lane[rows], run))]
        fresh[1:] |= lane[order[1:]] != lane[order[:-1]]
    return order


def _neighbours(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of suffixes: kind 0 is a repeat, 1 is to be checked, 2 belongs to a subdivided range."""
    held = list(parts)
    if not held:
        return
    names = ("bucket", "lead", "rest", "c", "doc", "h", "loc")
    bucket, lead, rest, c, doc, h, loc = (np.concatenate([np.asarray(p.column(n)) for p in held]) for n in names)
    held.clear()
    lead, rest, c = (x.view(np.uint64) for x in (lead, rest, c))
    g = arrays.mix(lead ^ arrays.mix(rest + np.uint64(1)))
    hot = np.flatnonzero(bucket & 1)
    yield from _blocks(2, g=g[hot], c=c[hot], doc=doc[hot], h=h[hot], loc=loc[hot])
    own = np.flatnonzero(bucket & 1 == 0)
    if not len(own):
        return
    lead, rest, g, c, doc, h, loc = (x[own] for x in (lead, rest, g, c, doc, h, loc))
    start = repeats.unpack(loc)[0]
    order = multikey_sort([lead, rest, c, doc, start])
    lead, rest, g, c, doc, h, loc, start = (x[order] for x in (lead, rest, g, c, doc, h, loc, start))
    group, kind = np.ones(len(g), bool), np.ones(len(g), bool)
    group[1:] = (lead[1:] != lead[:-1]) | (rest[1:] != rest[:-1])
    kind[1:] = group[1:] | (c[1:] != c[:-1])
    head = np.maximum.accumulate(np.where(kind, np.arange(len(g)), 0))
    late = (doc != doc[head]) | (start != start[head])
    number = np.cumsum(group) - 1
    kinds = np.bincount(number, kind).astype(np.int64)
    firsts = np.bincount(number, ~late).astype(np.int64)
    yield from _blocks(0, doc=doc[late], h=h[late], loc=loc[late])
    at = np.flatnonzero(~late & (kinds[number] > 1))
    yield from _blocks(1, g=g[at], doc=doc[at], h=h[at], loc=loc[at], n=firsts[number][at])


LANES = ("g", "c", "doc", "h", "loc", "n")


def _blocks(kind: int, size: int = 4096, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows with a list for each lane, which is empty where the kind has none: short to write."""
    rows = len(columns["doc"])
    offsets = np.minimum(np.arange(0, rows + size, size), rows).astype(np.int32) if rows else np.zeros(1, np.int32)
    none = np.zeros(len(offsets), np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(offsets if n in columns else none),
                                      pa.array(columns.get(n, np.zeros(0, np.int64)).view(np.int64))) for n in LANES]
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(offsets) - 1, kind)), *lists], names=["kind", *LANES])


def _rows(judged: DataFrame, kind: int, *lanes: str) -> DataFrame:
    return judged.filter(F.col("kind") == kind).select(F.inline(F.arrays_zip(*lanes)))


def _payload(window: int):
    def run(text: pa.Buffer, start: np.ndarray, more: np.ndarray) -> list[bytes]:
        raw = memoryview(text)
        return [bytes(raw[s:s + m + window]) for s, m in zip(start.tolist(), more.tolist(), strict=True)]
    return run


def _windows(window: int):
    def run(payloads: pa.ChunkedArray, count: np.ndarray) -> np.ndarray:
        data, offsets = arrays.texts(payloads)
        out = [np.zeros(0, np.uint64)]
        for first, last in arrays.row_chunks(offsets):
            own = offsets[first:last + 1] - offsets[first]
            sums = arrays.prefix(arrays.byte_symbols(data[offsets[first]:offsets[last]]))
            at = arrays.ranges(own[:-1], count[first:last])
            out.append(arrays.mix(arrays.span_hash(sums, at, at + window)))
        return np.concatenate(out)
    return run


def _kept(window: int, keep: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            marks = part.column("marks")
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for i, text in enumerate(part.column("text")):
                raw = text.as_buffer().to_pybytes()
                pieces, at, spans = [], 0, 0
                if marks[i].is_valid:
                    for s, e in zip(*(x.tolist() for x in repeats.covered(np.asarray(marks[i].values), window, len(raw))), strict=True):
                        pieces.append(raw[at:s])
                        at, spans = e, spans + 1
                pieces.append(raw[at:])
                kept.append(b"".join(pieces))
                n_bytes.append(len(raw))
                n_removed.append(len(raw) - len(kept[-1]))
                n_spans.append(spans)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), *(part.column(f"k{i}") for i in range(keep)),
                 *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.binary())],
                names=["doc", *(f"k{i}" for i in range(keep)), "n_bytes", "n_removed", "n_spans", "kept"])
    return run


def sampled_splitters(rows: DataFrame, window: int, bucket: int, sample: int) -> np.ndarray:
    """Range keys that cut the suffixes into buckets of about that many, from one in sample slices of the texts.

    A key that is drawn more than once stands more than once: its range is to be subdivided.
    """
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = math.ceil(size * 2 / (window - GRAM + 2) / bucket)
    if buckets < 2:
        return np.zeros(0, np.int64)
    keys = rows.mapInArrow(_sampled(window, sample), "key long")
    at = [i / buckets for i in range(1, buckets)]
    found = keys.agg(F.percentile_approx("key", at, 20 * buckets)).first()[0]
    return np.array(sorted(found or []), np.int64)


def suffix_dedup(docs: DataFrame, keep: tuple[str, ...] = (), window: int = WINDOW, bucket: int = BUCKET,
                 sample: int = SAMPLE) -> DataFrame:
    """doc_id, the kept columns, n_bytes, n_removed, n_spans and kept (the bytes that stay) of each row."""
    rows = repeats.identified(docs, keep)
    narrow = rows.select("doc", "h", "text")
    splitters = sampled_splitters(narrow, window, bucket, sample)
    dealt = narrow.mapInArrow(
        _suffixes(window, splitters),
        "bucket long, lead long, rest long, c long, doc long, h long, loc long",
    ).repartitionById(len(splitters) + 1, F.expr("cast(shiftright(bucket, 1) as int)"))
    judged = cut(dealt.mapInArrow(_neighbours, ", ".join(["kind long", *(f"{n} array<long>" for n in LANES)])))

    # subdivided ranges, across their boundaries
    hot = _rows(judged, 2, "g", "c", "doc", "h", "loc")
    when = F.struct("doc", repeats.loc_start(F.col("loc")).alias("start"))
    first = hot.groupBy("g", "c").agg(F.min(when).alias("first"))
    several = first.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1")
    compared = hot.join(first, ["g", "c"])
    marks = _rows(judged, 0, "doc", "h", "loc").unionByName(
        compared.filter(when > F.col("first")).select("doc", "h", "loc"))
    checks = _rows(judged, 1, "g", "doc", "h", "loc", "n").unionByName(
        compared.filter(when == F.col("first")).join(several, "g").select("g", "doc", "h", "loc", F.col("m").alias("n")))
    checked = repeats.repeated_windows(rows, checks, _payload(window), _windows(window), by_place=True)

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ["doc long", *(f"k{i} {types[f'k{i}']}" for i in range(len(keep))),
              "n_bytes long", "n_removed long", "n_spans long", "kept binary"]
    out = repeats.with_marks(rows, marks.unionByName(checked)).mapInArrow(_kept(window, len(keep)), ", ".join(schema))
    return out.select(
        F.nullif("doc", F.lit(repeats.NO_ID)).alias("doc_id"), *(F.col(f"k{i}").alias(n) for i, n in enumerate(keep)),
        "n_bytes", "n_removed", "n_spans", "kept")
