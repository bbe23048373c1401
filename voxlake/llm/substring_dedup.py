"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of each window of 50 words the smallest gram of 6 words, by hash. Documents are
joined on the anchors' grams, and a match is extended both ways to all words that an anchor's windows cover:
an anchor with the same words on both sides as one of an earlier document is a repeat as a whole; of the
others the windows are compared one by one, which is where a match ends. Runs of repeated windows, 50 words or
longer, are the maximal repeats and are removed.

Null, empty and shorter texts have no window and stay whole. Rows with one doc_id never repeat each other, whatever
their texts; each is judged by its own. A null doc_id counts as smaller than any other. Other columns than those in `keep` are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm import arrays, repeats
from voxlake.llm.common import cut

WINDOW, GRAM = 50, 6


def _word_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, row = arrays.word_spans(data, offsets, arrays.is_space())
    bounds = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(offsets) - 1))))
    return arrays.word_hashes(data, start, end), bounds


def _anchors(window: int, gram: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = arrays.texts(part.column("text"))
            doc, h = np.asarray(part.column("doc")), np.asarray(part.column("h"))
            for first, last in arrays.row_chunks(offsets):
                own = offsets[first:last + 1]
                symbols, bounds = _word_symbols(data[own[0]:own[-1]], own)
                for place, lo, hi, g, c in arrays.winnow_rows(symbols, bounds, window, gram):
                    row = np.searchsorted(bounds, lo, "right") - 1
                    yield repeats.batch(g=g, c=c, doc=doc[first + row], h=h[first + row],
                                        loc=repeats.pack(lo - bounds[row], hi - lo))
    return run


def _payload(window: int):
    def run(text: pa.Buffer, start: np.ndarray, more: np.ndarray) -> list[bytes]:
        data = np.frombuffer(text, np.uint8)
        symbols, _ = _word_symbols(data, np.array([0, len(data)]))
        sums = arrays.prefix(symbols)
        out = []
        for s, m in zip(start.tolist(), more.tolist(), strict=True):
            at = np.arange(s, s + m + 1)
            out.append(arrays.mix(arrays.span_hash(sums, at, at + window)).tobytes())
        return out
    return run


def _windows(payloads: pa.ChunkedArray, count: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(payloads.to_pylist()), np.uint64)


def _kept(window: int, keep: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            marks = part.column("marks")
            n_words, n_removed, kept = [], [], []
            for i, text in enumerate(part.column("text")):
                raw = text.as_buffer().to_pybytes()
                words = raw.split()
                n_words.append(len(words))
                if marks[i].is_valid:
                    start, end = repeats.covered(np.asarray(marks[i].values), window, len(words))
                    kept_words, at = [], 0
                    for s, e in zip(start.tolist(), end.tolist(), strict=True):
                        kept_words += words[at:s]
                        at = e
                    kept_words += words[at:]
                    n_removed.append(len(words) - len(kept_words))
                    kept.append(b" ".join(kept_words))
                else:
                    n_removed.append(0)
                    kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), *(part.column(f"k{i}") for i in range(keep)), pa.array(n_words, pa.int64()),
                 pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc", *(f"k{i}" for i in range(keep)), "n_words", "n_removed", "kept_text"])
    return run


def substring_dedup(docs: DataFrame, keep: tuple[str, ...] = (), window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, the kept columns, n_words, n_removed and kept_text (kept words joined by one space) of each row."""
    rows = repeats.identified(docs, keep)
    found = rows.select("doc", "h", "text").mapInArrow(_anchors(window, gram), repeats.ANCHOR)
    # sides of joins are written first, so that they are plain shuffles and the rows of a frequent gram can be split
    shared = cut(found.groupBy("g").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("g"))
    seeds = cut(found.join(shared, "g", "left_semi"))

    first = cut(seeds.groupBy("g", "c").agg(F.min("doc").alias("first")))
    several = cut(first.groupBy("g").agg(
        F.min("first").alias("lo"), F.max("first").alias("hi"), F.count("*").alias("n")).filter("lo < hi"))
    extended = seeds.join(first, ["g", "c"])
    marks = extended.filter("first < doc").select("doc", "h", "loc")
    checks = extended.filter("first = doc").join(several.select("g", "n"), "g").select("g", "doc", "h", "loc", "n")
    checked = repeats.repeated_windows(rows, checks, _payload(window), _windows, by_place=False)

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ["doc long", *(f"k{i} {types[f'k{i}']}" for i in range(len(keep))),
              "n_words long", "n_removed long", "kept_text string"]
    out = repeats.with_marks(rows, marks.unionByName(checked)).mapInArrow(_kept(window, len(keep)), ", ".join(schema))
    return out.select(
        F.nullif("doc", F.lit(repeats.NO_ID)).alias("doc_id"), *(F.col(f"k{i}").alias(n) for i, n in enumerate(keep)),
        "n_words", "n_removed", "kept_text")
