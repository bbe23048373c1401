"""Ranked full-text search (BM25 over title and body).

The body counts twice, as the index of the feedback store holds it in two columns. Corpus figures
(documents, mean length, documents per search unit) always cover the whole corpus; metadata filters
only narrow what is ranked.

There are two ways to the same scores. `score_texts` reads the texts: one pass for the corpus figures,
one over the candidates, no shuffle. `score_index` reads an index written once by `build_index`: only
the buckets of the query's terms are scanned, and only their postings are shuffled, by document. The
index grows by a part with every insert. A manifest names the parts that count; parts of like size are
merged into one (`merge_index`), so that their number grows with the logarithm of the documents.
"""

from __future__ import annotations

import time
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import partial, reduce
from typing import Any
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from voxlake import constants as K
from voxlake.functions.dates import event_time, utc_text
from voxlake.functions.text import fold, folded, tokens, words_of
from voxlake.operators.ranking import add_columns, beyond, narrow, page
from voxlake.session import holding
from voxlake.sources import files

BUCKETS, BUCKET_LETTERS = 256, 2
LENGTHS = -1               # the bucket of rows that hold a document's length as their tf, where these come with the postings
BATCH_BYTES = 1 << 21      # of an Arrow batch, texts of so many bytes are cut and sorted at once
PACKED_ROWS = 1 << 18      # so many postings of a task are packed for the shuffle at once
UNPACKED_ROWS = 1 << 14    # and come back in batches of about so many
_PLAIN = ["doc_id", "in_title", "tf", "dl"]
_COLUMNS = ["term", "doc_id", "in_title", "positions", "bucket", "tf", "f", "dl"]
_ASCII_WORD = np.array([chr(c).isalnum() and c < 128 for c in range(256)])
_WEIGHTS = {
    None: (K.TITLE_WEIGHT, K.CONTENT_WEIGHT + K.REVIEW_WEIGHT),
    "title": (K.TITLE_WEIGHT, 0.0),
    "content": (0.0, K.CONTENT_WEIGHT),
    "review_text": (0.0, K.REVIEW_WEIGHT),
}
RESULT_COLUMNS = (
    "id", "source_id", "external_id", "title", "body", "author", "url", "published_at", "raw_json",
    "created_at",
)


# What to look for ------------------------------------------------------------------------------
@dataclass(frozen=True)
class Unit:
    """A word, a phrase (several words in a row) or a prefix, in all columns or in one."""

    words: tuple[str, ...]
    prefix: bool = False
    column: str | None = None


@dataclass(frozen=True)
class Match:
    """All of `required`, at least one of `optional` if there are any, none of `excluded`."""

    required: tuple[Unit, ...] = ()
    optional: tuple[Unit, ...] = ()
    excluded: tuple[Unit, ...] = ()

    @property
    def units(self) -> tuple[Unit, ...]:
        return self.required + self.optional + self.excluded

    def __and__(self, other: Match) -> Match:
        return Match(
            self.required + other.required, self.optional + other.optional, self.excluded + other.excluded
        )


def _words(text: str, column: str | None) -> tuple[Unit, ...]:
    return tuple(Unit((w,), column=column) for w in dict.fromkeys(fold(text)))


def match_all(text: str, column: str | None = None) -> Match:
    return Match(required=_words(text, column))


def match_any(text: str, column: str | None = None) -> Match:
    return Match(optional=_words(text, column))


def match_none(text: str, column: str | None = None) -> Match:
    return Match(excluded=_words(text, column))


def match_phrase(text: str, column: str | None = None) -> Match:
    words = tuple(fold(text))
    return Match(required=(Unit(words, column=column),)) if words else Match()


def match_prefix(text: str, column: str | None = None) -> Match:
    words = tuple(fold(text))
    return Match(required=(Unit(words, prefix=True, column=column),)) if words else Match()


# Scores ----------------------------------------------------------------------------------------
def matches(match: Match, weighted: Sequence[Column]) -> Column:
    hit = [f > 0 for f in weighted]
    r, o = len(match.required), len(match.optional)
    ok = reduce(lambda a, b: a & b, hit[:r], F.lit(True))
    if o:
        ok = ok & reduce(lambda a, b: a | b, hit[r:r + o])
    return reduce(lambda a, b: a & ~b, hit[r + o:], ok)


def bm25(weighted: Sequence[Column], doc_length: Column, figures: Column) -> Column:
    """Negative BM25: lower is better."""
    n_docs = figures["n_docs"].cast("double")
    mean = figures["total_length"] / n_docs
    score = F.lit(0.0)
    for i, f in enumerate(weighted):
        found = figures[f"n_{i}"]
        raw = F.ln((n_docs - found + 0.5) / (found + 0.5))
        idf = F.when(raw > 0, raw).otherwise(K.MIN_IDF)
        damp = K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * doc_length / mean)
        score = score + idf * f * (K.BM25_K1 + 1) / (f + damp)
    return -score


def _found_per_unit(weighted: Sequence[Column]) -> list[Column]:
    return [F.count_if(f > 0).alias(f"n_{i}") for i, f in enumerate(weighted)]


def _unit_columns(n: int) -> list[Column]:
    return [F.col(f"_f{i}") for i in range(n)]


# Search over the texts ---------------------------------------------------------------------------
def _count_in(unit: Unit, toks: Column) -> Column:
    """How often the unit occurs in a token array."""
    *head, last = unit.words

    def ends(token: Column) -> Column:
        return token.startswith(last) if unit.prefix else token == last

    if not head:
        return F.size(F.filter(toks, lambda t: ends(t)))

    def starts_here(t: Column, i: Column) -> Column:
        ok = t == head[0]
        for k, word in enumerate(head[1:], start=1):
            ok = ok & (F.get(toks, i + k) == word)
        return ok & ends(F.get(toks, i + len(head)))

    return F.size(F.filter(toks, starts_here))


def _with_frequencies(docs: DataFrame, match: Match) -> DataFrame:
    """Adds the document length `_dl` and the weighted frequency `_f<i>` of each unit.

    `inline` keeps the cut texts from being cut again in every filter and score that uses them.
    """
    def measure(cut: Column) -> Column:
        out = [(F.size(cut["title"]) + 2 * F.size(cut["body"])).alias("_dl")]
        for i, unit in enumerate(match.units):
            in_title, in_body = _WEIGHTS[unit.column]
            parts = []
            if in_title:
                parts.append(in_title * _count_in(unit, cut["title"]))
            if in_body:
                parts.append(in_body * _count_in(unit, cut["body"]))
            out.append(reduce(lambda a, b: a + b, parts).alias(f"_f{i}"))
        return F.struct(*out)

    cut = F.array(F.struct(tokens(F.col("title")).alias("title"), tokens(F.col("body")).alias("body")))
    return docs.select("*", F.inline(F.transform(cut, measure)))


def score_texts(documents: DataFrame, candidates: DataFrame, match: Match) -> DataFrame:
    """Matching candidates with their score; corpus figures come from all documents."""
    weighted = _unit_columns(len(match.units))
    figures = (
        _with_frequencies(documents.select("title", "body"), match)
        .agg(F.count("*").alias("n_docs"), F.sum("_dl").alias("total_length"), *_found_per_unit(weighted))
        .select(F.struct("*"))
        .scalar()
    )
    hits = _with_frequencies(candidates, match).where(matches(match, weighted))
    return (
        hits.withColumn("_figures", figures)
        .withColumn("fts_score", bm25(weighted, F.col("_dl"), F.col("_figures")))
        .drop("_figures", "_dl", *[f"_f{i}" for i in range(len(match.units))])
    )


_ORDER = (F.asc_nulls_first, "fts_score"), (F.desc_nulls_last, "_time"), (F.desc, "id")


@dataclass(frozen=True)
class Place:
    """Where a page ended: the order's values of its last row."""

    fts_score: float | None
    time: datetime | None
    id: int


def place_of(row: Row) -> Place:
    """The place of a row of a page, from which the next page goes on."""
    return Place(row["fts_score"], row["published_at"] or row["created_at"], row["id"])


def after_place(rows: DataFrame, place: Place | None) -> DataFrame:
    """Rows (with fts_score, `_time` and id) behind a place in the order of pages.

    A later page so costs what the first one does: what lies before it is filtered out, by month folders as well where
    there is no score, and each task keeps one page only.
    """
    if place is None:
        return rows
    time = None if place.time is None else F.lit(place.time).cast("timestamp")
    found = rows.where(beyond([(F.col("fts_score"), False), (F.col("_time"), True), (F.col("id"), True)],
                              [place.fts_score, time, place.id]))
    if place.fts_score is None and place.time is not None and "event_month" in rows.columns:
        found = found.where(F.col("fts_score").isNotNull() | F.col("event_month").isNull()
                            | (F.col("event_month") <= utc_text(time).substr(1, 7)))
    return found


def ranked_page(scored: DataFrame, documents: DataFrame, limit: int, offset: int = 0, after: Place | None = None) -> DataFrame:
    """Best score first, then latest, then highest id; from an offset, or from behind the last row seen.

    `scored` needs no more than id, times and `fts_score`; the page gets its other columns last.
    """
    order = [direction(name) for direction, name in _ORDER]
    rows = after_place(scored.withColumn("_time", event_time()).select(*narrow(scored, "id", "_time", "fts_score")), after)
    top = page(rows, order, max(1, limit), max(0, offset))
    wide = [c for c in RESULT_COLUMNS if c != "id"]
    return add_columns(top, documents, wide).orderBy(*order).select(*RESULT_COLUMNS, "fts_score")


def unscored(candidates: DataFrame) -> DataFrame:
    """No query: every candidate, without a score."""
    return candidates.withColumn("fts_score", F.lit(None).cast("double"))


# Search over a written index -----------------------------------------------------------------------
@dataclass(frozen=True)
class Index:
    postings: DataFrame    # bucket, term, doc_id, in_title, tf, positions; and what ROW_WEIGHTS says
    doc_stats: DataFrame   # doc_id, dl
    corpus: DataFrame      # one row: n_docs, total_length
    made: DataFrame | None = None    # of an index that is not written: postings, and lengths in bucket LENGTHS, by one pass over the texts
    packed: DataFrame | None = None  # the same by one pass, as it is shuffled before a write


def bucket_of(term: str) -> int:
    """By the first letters, so that a prefix of at least so many opens one bucket like a word does."""
    return crc32(term[:BUCKET_LETTERS].encode()) % BUCKETS


def _postings(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (doc_id, title, body, title_words, body_words) each word of a column with its places, rising."""
    for whole in parts:
        n_bytes = sum(np.asarray(pc.fill_null(size(whole.column(c)), 0), np.int64) * of for size, c, of in (
            (pc.binary_length, "title", 1), (pc.binary_length, "body", 1), (pc.list_value_length, "title_words", 8),
            (pc.list_value_length, "body_words", 8)))
        steps = np.flatnonzero(np.diff(np.cumsum(n_bytes) // BATCH_BYTES, prepend=0)).tolist()
        for first, end in zip([0, *steps], [*steps, whole.num_rows], strict=True):
            if first < end:
                yield _batch_postings(whole.slice(first, end - first))


def _ascii_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of ASCII texts (null: none) put together: the letters, which of them are of a word, where words start and where texts end."""
    texts = pc.fill_null(texts, "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    if ends[0] == ends[-1]:
        return np.empty(0, np.uint8), np.empty(0, bool), np.empty(0, np.int64), ends - ends[0]
    letters = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    kept = _ASCII_WORD[letters]
    opens = kept & ~np.concatenate(([False], kept[:-1]))
    first = ends[:-1][ends[:-1] < ends[1:]]
    opens[first] = kept[first]
    return letters, kept, np.flatnonzero(opens), ends


def _ascii_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The runs of letters and digits of ASCII texts (null: none), and of each the place of its text."""
    letters, kept, starts, ends = _ascii_runs(texts)
    if not len(letters):
        return pa.array([], pa.string()), np.empty(0, np.int64)
    letters = letters[kept]
    offsets = np.append(np.cumsum(kept, dtype=np.int32)[starts] - 1, len(letters)).astype(np.int32)
    return (pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters)),
            np.searchsorted(ends[1:], starts, "right"))


def _batch_postings(part: pa.RecordBatch) -> pa.RecordBatch:
    """Rows by bucket, term and place in the batch: the sort before the write finds long runs."""
    # a text is a column of a row: title and body of the first row, of the second, ...
    found, texts = [], []
    for side, c in enumerate(("title", "body")):
        own, listed = _ascii_words(part.column(c)), part.column(f"{c}_words")
        found += [own[0], pc.list_flatten(listed).cast(pa.string())]
        texts += [2 * own[1] + side, 2 * np.asarray(pc.list_parent_indices(listed), np.int64) + side]
    words, text = pa.concat_arrays(found).dictionary_encode(), np.concatenate(texts)
    openings = pc.utf8_slice_codeunits(words.dictionary, 0, BUCKET_LETTERS).dictionary_encode()
    bucket = np.array([bucket_of(w) for w in openings.dictionary.to_pylist()], np.int32)[np.asarray(openings.indices)]
    by_term = np.asarray(pc.sort_indices(words.dictionary), np.int64)
    by_bucket = by_term[np.argsort(bucket[by_term], kind="stable")]
    rank = np.empty(len(by_bucket), np.int64)
    rank[by_bucket] = np.arange(len(by_bucket))
    place = np.arange(len(text))
    starts = np.flatnonzero(np.diff(text, prepend=-1))
    position = (place - np.repeat(starts, np.diff(starts, append=len(text)))).astype(np.int32)
    key = rank[np.asarray(words.indices)] * (2 * part.num_rows) + text
    bits = len(key).bit_length()
    if int(key.max(initial=0)).bit_length() + bits < 63:
        order = np.sort(key << bits | place) & ((1 << bits) - 1)
    else:
        order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    own, at = text[order[starts]], pa.array(order[starts])
    ends = np.append(starts, len(order))
    found, tf = words.indices.take(at), np.diff(ends)
    # a word's title row comes right before its body row
    first = np.flatnonzero(np.diff(key[order[starts]] // 2, prepend=-1))
    n_words, dl = np.bincount(text, minlength=2 * part.num_rows), np.zeros(len(own), np.int64)
    dl[first] = (n_words[::2] + 2 * n_words[1::2])[own[first] // 2]
    return pa.RecordBatch.from_arrays(
        [words.dictionary.take(found), part.column("doc_id").take(pa.array(own // 2)), pa.array(own % 2 == 0),
         pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(position[order])),
         pa.array(bucket).take(found), pa.array(tf), pa.array(_weights(own % 2 == 0, tf, first)), pa.array(dl)],
        names=_COLUMNS)


def _weights(in_title: np.ndarray, tf: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Weighted frequencies, at the first row of each word in a document."""
    f, (title, body) = np.zeros(len(tf)), _WEIGHTS[None]
    if len(tf):
        f[first] = np.add.reduceat(np.where(in_title, title, body) * tf, first)
    return f


def _lengths(part: pa.RecordBatch) -> pa.RecordBatch:
    """Of the same rows the length of each document, as rows of the bucket LENGTHS; no nulls, which slow the write of all rows."""
    dl = np.zeros(part.num_rows, np.int64)
    for c, weight in (("title", 1), ("body", 2)):
        _, _, starts, ends = _ascii_runs(part.column(c))
        listed = pc.fill_null(pc.list_value_length(part.column(f"{c}_words")), 0)
        dl += weight * (np.diff(np.searchsorted(starts, ends)) + np.asarray(listed, np.int64))
    n = part.num_rows
    nowhere = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.int32()))
    return pa.RecordBatch.from_arrays(
        [pa.repeat("", n), part.column("doc_id"), pa.repeat(False, n), nowhere, pa.array(np.full(n, LENGTHS, np.int32)), pa.array(dl),
         pa.array(np.zeros(n)), pa.array(dl)],
        names=_COLUMNS)


def _made(postings: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
          parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        yield from postings(iter([part]))
        yield _lengths(part)


def _packed(postings: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
            parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What `_made` makes, as one row for each bucket of a few batches, which holds that bucket's rows column by column, compressed.

    Row by row a posting is shuffled as over 20 bytes, so as 9 or 10.
    """
    held, n = defaultdict(list), 0
    for rows in _made(postings, parts):
        bucket = np.asarray(rows.column("bucket"))
        starts = np.flatnonzero(np.diff(bucket, prepend=LENGTHS - 1))
        for of, start, end in zip(bucket[starts].tolist(), starts.tolist(), np.append(starts[1:], len(bucket)).tolist(), strict=True):
            held[of].append(rows.slice(start, end - start))
        n += rows.num_rows
        if n >= PACKED_ROWS:
            yield _packs(held)
            held, n = defaultdict(list), 0
    if held:
        yield _packs(held)


def _packs(held: Mapping[int, list[pa.RecordBatch]]) -> pa.RecordBatch:
    sizes, packs = [], []
    for own in held.values():
        pack = _pack(pa.concat_batches(own))
        sizes.append(pack.size)
        packs.append(pa.compress(pack, codec="zstd", asbytes=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.int32()), pa.array(sizes, pa.int64()), pa.array(packs, pa.binary())], names=["bucket", "size", "rows"])


def _pack(rows: pa.RecordBatch) -> pa.Buffer:
    """Rows of a bucket as one row of lists; a term stands once for the rows that follow each other with it."""
    runs = pc.run_end_encode(rows.column("term"))
    times = pa.array(np.diff(np.asarray(runs.run_ends), prepend=0), pa.int32())
    held = [runs.values, times, rows.column("positions").flatten(), *(rows.column(c) for c in _PLAIN)]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in held]
    return pa.RecordBatch.from_arrays(lists, names=[str(i) for i in range(len(held))]).serialize()


def _unpack(bucket: int, pack: pa.RecordBatch) -> pa.RecordBatch:
    terms, times, places, *plain = (c.flatten() for c in pack.columns)
    columns = dict(zip(_PLAIN, plain, strict=True))
    n, tf = len(columns["tf"]), np.asarray(columns["tf"])
    offsets = np.zeros(n + 1, np.int32)
    if bucket != LENGTHS:
        np.cumsum(tf, out=offsets[1:])
        columns["f"] = _weights(np.asarray(columns["in_title"]), tf, np.flatnonzero(np.asarray(columns["dl"])))
    else:
        columns["f"] = np.zeros(n)
    columns |= {"term": terms.take(pa.array(np.repeat(np.arange(len(terms)), np.asarray(times)))),
                "positions": pa.ListArray.from_arrays(pa.array(offsets), places), "bucket": np.full(n, bucket, np.int32)}
    return pa.RecordBatch.from_arrays([pa.array(columns[c]) for c in _COLUMNS], names=_COLUMNS)


def _unpacked(id_type: pa.DataType, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that `_packed` has packed, a good number at once."""
    kinds = [pa.string(), pa.int32(), pa.int32(), id_type, pa.bool_(), pa.int64(), pa.int64()]
    schema = pa.schema([(str(i), pa.list_(t)) for i, t in enumerate(kinds)])
    found, n = [], 0
    for part in parts:
        for bucket, size, own in zip(part.column("bucket").to_pylist(), part.column("size").to_pylist(), part.column("rows"), strict=True):
            pack = pa.ipc.read_record_batch(pa.decompress(own.as_buffer(), size, codec="zstd"), schema)
            found.append(_unpack(bucket, pack))
            n += found[-1].num_rows
            if n >= UNPACKED_ROWS:
                yield pa.concat_batches(found)
                found, n = [], 0
    if found:
        yield pa.concat_batches(found)


def build_index(documents: DataFrame) -> Index:
    """Postings per (term, document, column) with positions, and document lengths.

    All places of a word in a document lie in one row, so postings are made row by row, in Arrow batches
    of the texts' words; nothing is shuffled before the index is written. Lengths come out of the same batches:
    who needs both reads `made`, so that the texts are read and cut once.
    """
    # ASCII texts are cut in the batches, others come as words
    texts = documents.select(
        F.col("id").alias("doc_id"), folded(F.col("title")).alias("title"), folded(F.col("body")).alias("body"))
    beyond_ascii = {c: F.octet_length(c) > F.length(c) for c in ("title", "body")}
    cut = texts.select(
        "doc_id", *(F.when(~own, F.col(c)).alias(c) for c, own in beyond_ascii.items()),
        *(F.when(own, words_of(F.col(c))).alias(f"{c}_words") for c, own in beyond_ascii.items()))
    id_type = cut.schema["doc_id"].dataType.simpleString()
    made = cut.mapInArrow(
        partial(_made, _postings),
        f"term string, doc_id {id_type}, in_title boolean, positions array<int>, bucket int, tf long, {ROW_WEIGHTS}")
    return _of_rows(made, cut.mapInArrow(partial(_packed, _postings), "bucket int, size long, rows binary"))


def _of_rows(made: DataFrame, packed: DataFrame | None = None) -> Index:
    doc_stats = _lengths_of(made)
    corpus = doc_stats.agg(F.count("*").alias("n_docs"), F.sum("dl").alias("total_length"))
    return Index(made.where(F.col("bucket") != LENGTHS), doc_stats, corpus, made, packed)


def _lengths_of(made: DataFrame) -> DataFrame:
    return made.where(F.col("bucket") == LENGTHS).select("doc_id", F.col("tf").alias("dl"))


POSTINGS = "bucket int, term string, doc_id long, in_title boolean, tf long, positions array<int>"
# of a word's first row in a document: its weighted frequency in all columns and the document's length; zeros in its second
# row, null in parts that were written without them
ROW_WEIGHTS = "f double, dl long"
DOC_STATS = "doc_id long, dl long"
# shuffle files go as soon as a write has ended; its tasks are small, as packed rows grow manifold before they are sorted
WRITE_CONF = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.files.maxPartitionBytes": "16m",
}
FAN = 8            # so many parts of a tier become one of the next
KEPT_MANIFESTS = 8


def new_part() -> str:
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def stage_part(index: Index, path: str, part: str) -> dict[str, Any]:
    """Writes a part that no manifest names yet, and returns its entry for one.

    Buckets follow the term, so that a query opens only its own. Rows are dealt by bucket, and what is too
    large of that is cut by size: the bucket of a common term becomes many even files, each sorted by term.
    Nothing is sampled for this, so the postings are made once; those of texts are shuffled packed, which takes less than
    half the disk. Lengths that are made with them are written with them, as a bucket of their own that no query opens, and
    copied from there.
    """
    spark = index.doc_stats.sparkSession
    order = ["bucket", "term", "doc_id"]
    postings, doc_stats = f"{path}/postings/part={part}", f"{path}/doc_stats/part={part}"
    with holding(spark, WRITE_CONF):
        if index.packed is None:
            rows = index.postings.hint("rebalance", "bucket")
        else:
            unpacked = partial(_unpacked, to_arrow_type(index.made.schema["doc_id"].dataType))
            rows = index.packed.hint("rebalance", "bucket").mapInArrow(unpacked, index.made.schema)
        rows.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(postings)
    if index.made is None:
        index.doc_stats.write.mode("overwrite").parquet(doc_stats)
    else:
        _lengths_of(spark.read.schema(POSTINGS).parquet(postings)).write.mode("overwrite").parquet(doc_stats)
    n, length = spark.read.schema(DOC_STATS).parquet(doc_stats).agg(
        F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return {"part": part, "n_docs": n, "total_length": length}


def manifest(spark: SparkSession, path: str) -> dict[str, Any]:
    """The newest manifest: its version and the parts that count."""
    versions = [n for n in files.names(spark, f"{path}/manifests") if n.endswith(".json") and not n.startswith(".")]
    if not versions:
        return {"version": 0, "parts": []}
    return files.read_json(spark, f"{path}/manifests/{versions[-1]}")


def commit_parts(spark: SparkSession, path: str, added: Sequence[Mapping[str, Any]], removed: Sequence[str] | None = ()) -> bool:
    """Makes the next manifest, with parts added and removed (None: all earlier ones). Parts that are there stay once.

    False if parts to be removed have gone meanwhile: then nothing is changed. Whoever else commits at the
    same time is waited for by trying again on top of it.
    """
    while True:
        last = manifest(spark, path)
        known = {p["part"] for p in last["parts"]}
        if removed and not known.issuperset(removed):
            return False
        gone = known if removed is None else set(removed)
        fresh = [p for p in added if p["part"] not in known]
        parts = [p for p in last["parts"] if p["part"] not in gone] + list(fresh)
        version = last["version"] + 1
        if files.write_json(spark, f"{path}/manifests/{version:012d}.json", {"version": version, "parts": parts}):
            for old in files.names(spark, f"{path}/manifests")[:-KEPT_MANIFESTS]:
                files.delete(spark, f"{path}/manifests/{old}")
            return True


def write_index(index: Index, path: str, *, append: bool = False) -> None:
    """Writes a part of the index; without `append` it replaces all earlier ones. Readers see a part as a whole or
    not at all. Appended documents must be new ones."""
    entry = stage_part(index, path, new_part())
    commit_parts(index.doc_stats.sparkSession, path, [entry], () if append else None)


def read_index(spark: SparkSession, path: str, parts: Sequence[Mapping[str, Any]] | None = None) -> Index:
    """The index as of its newest manifest, or some of its parts."""
    own = manifest(spark, path)["parts"] if parts is None else parts

    def rows(name: str, schema: str) -> DataFrame:
        folders = [f"{path}/{name}/part={p['part']}" for p in own]
        if not folders:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(*folders).drop("part")

    figures = (sum(p["n_docs"] for p in own), sum(p["total_length"] for p in own))
    return Index(rows("postings", f"{POSTINGS}, {ROW_WEIGHTS}").where(F.col("bucket") != LENGTHS), rows("doc_stats", DOC_STATS),
                 spark.createDataFrame([figures], "n_docs long, total_length long"))


def _tier(n_docs: int, fan: int) -> int:
    tier = 0
    while n_docs >= fan:
        n_docs, tier = n_docs // fan, tier + 1
    return tier


def merge_tiers(spark: SparkSession, path: str, merged: Callable[[list[dict[str, Any]]], dict[str, Any]], *,
                fan: int = FAN) -> list[list[str]]:
    """Merges parts of a tier (their number of documents by powers of `fan`) wherever there are `fan` of them, until
    there are no more; the parts that went into each merge.

    What a part holds is moved once for each tier, and fewer than `fan` parts stay in each. `merged` writes a part
    from others and returns its entry, which one manifest puts in their place; a merge that fails before leaves all as it was.
    """
    done = []
    while True:
        tiers: dict[int, list[dict[str, Any]]] = defaultdict(list)
        for own in manifest(spark, path)["parts"]:
            tiers[_tier(own["n_docs"], fan)].append(own)
        full = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= fan), None)
        if full is None:
            return done
        entry, names = merged(full), [p["part"] for p in full]
        if commit_parts(spark, path, [entry], names):
            done.append(names)


def merge_index(spark: SparkSession, path: str, *, fan: int = FAN) -> list[list[str]]:
    """Merges parts of the index by tiers; the parts that went into each merge."""
    def merged(full: list[dict[str, Any]]) -> dict[str, Any]:
        return stage_part(read_index(spark, path, full), path, new_part())

    return merge_tiers(spark, path, merged, fan=fan)


def vacuum_index(spark: SparkSession, path: str) -> list[str]:
    """Removes the parts that no kept manifest names. Not to be called while a part is being written."""
    named = set()
    for name in files.names(spark, f"{path}/manifests"):
        if not name.startswith("."):
            named |= {p["part"] for p in files.read_json(spark, f"{path}/manifests/{name}")["parts"]}
    gone = []
    for table in ("postings", "doc_stats", "impacts", "impact_stats"):
        for folder in files.names(spark, f"{path}/{table}"):
            if folder.startswith("part=") and folder.removeprefix("part=") not in named:
                files.delete(spark, f"{path}/{table}/{folder}")
                gone.append(folder.removeprefix("part="))
    return sorted(set(gone))


def _wanted(match: Match) -> Column:
    exact = sorted({w for u in match.units for w in (u.words[:-1] if u.prefix else u.words)})
    prefixes = [u.words[-1] for u in match.units if u.prefix]
    wanted = F.lit(False)
    if exact:
        buckets = sorted({bucket_of(w) for w in exact})
        wanted = wanted | (F.col("bucket").isin(buckets) & F.col("term").isin(exact))
    for p in prefixes:
        own = F.col("term").startswith(p)
        wanted = wanted | ((F.col("bucket") == bucket_of(p)) & own if len(p) >= BUCKET_LETTERS else own)
    return wanted


def _needed(postings: DataFrame, match: Match) -> DataFrame:
    """Only postings a unit can use; words and prefixes prune the buckets, very short prefixes do not."""
    return postings.where(_wanted(match))


def _read_once(index: Index, match: Match) -> Index:
    """What a query takes of an index that is not written, from one pass over the texts.

    Hits, found documents, lengths and corpus figures would each make the index anew. The rows are kept in the
    checkpoint folder, or by the executors if there is none.
    """
    rows = index.made.where(_wanted(match) | (F.col("bucket") == LENGTHS))
    own = rows.localCheckpoint() if rows.sparkSession.sparkContext.getCheckpointDir() is None else rows.checkpoint()
    return _of_rows(own)


def _phrase_count(unit: Unit, places: dict[str, Column], tail: Column) -> Column:
    first, *rest = unit.words[:-1]

    def starts_here(p: Column) -> Column:
        ok = F.lit(True)
        for k, word in enumerate(rest, start=1):
            ok = ok & F.array_contains(places[word], p + k)
        return ok & F.array_contains(tail, p + len(unit.words) - 1)

    return F.size(F.filter(places[first], starts_here))


def score_index(index: Index, match: Match) -> DataFrame:
    """(id, fts_score) of all matching documents."""
    if index.made is not None:
        index = _read_once(index, match)
    none = F.array().cast("array<int>")
    terms = sorted({w for u in match.units for w in (u.words[:-1] if u.prefix else u.words)})
    names = {w: f"_w{i}" for i, w in enumerate(terms)}
    prefixes = {u.words[-1]: f"_p{i}" for i, u in enumerate(match.units) if u.prefix}
    aggregates = []
    for title in (True, False):
        side, tag = F.col("in_title") == title, "t" if title else "b"
        for word, name in names.items():
            own = F.when(side & (F.col("term") == word), F.col("positions"))
            aggregates.append(F.coalesce(F.any_value(own, F.lit(True)), none).alias(name + tag))
        for prefix, name in prefixes.items():
            own = F.when(side & F.col("term").startswith(prefix), F.col("positions"))
            aggregates.append(F.flatten(F.collect_list(own)).alias(name + tag))
    places = _needed(index.postings, match).groupBy("doc_id").agg(*aggregates)

    def count(unit: Unit, tag: str) -> Column:
        own = {w: F.col(names[w] + tag) for w in unit.words if w in names}
        tail = F.col(prefixes[unit.words[-1]] + tag) if unit.prefix else own[unit.words[-1]]
        return F.size(tail) if len(unit.words) == 1 else _phrase_count(unit, own, tail)

    frequencies = []
    for i, unit in enumerate(match.units):
        in_title, in_body = _WEIGHTS[unit.column]
        frequencies.append((in_title * count(unit, "t") + in_body * count(unit, "b")).alias(f"_f{i}"))
    hits = places.select(F.col("doc_id").alias("id"), *frequencies)
    weighted = _unit_columns(len(match.units))
    found = hits.agg(*_found_per_unit(weighted)).select(F.struct("*")).scalar()
    whole = index.corpus.select(F.struct("*")).scalar()
    return (
        hits.where(matches(match, weighted))
        .join(index.doc_stats.withColumnRenamed("doc_id", "id"), "id")
        .withColumns({"_found": found, "_whole": whole})
        .withColumn("_figures", F.struct("_whole.*", "_found.*"))
        .select("id", bm25(weighted, F.col("dl"), F.col("_figures")).alias("fts_score"))
    )
