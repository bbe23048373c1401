"""Vector helpers over the words or bytes of many texts at once: rolling hashes, words, winnowing.

All hashes are polynomials modulo 2^64 over 64-bit symbols, mixed at the end. Two spans count as equal when
both the hash of their anchor and the hash of the whole span agree, which is 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)
CHUNK = 1 << 19
PLACE_BITS = 21

_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_tables.get("up", ())) < n:
        size = max(n, CHUNK + 4096)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _tables[name] = np.cumprod(table, dtype=np.uint64)
    return _tables["up"][:n], _tables["down"][:n]


def byte_symbols(data: np.ndarray) -> np.ndarray:
    if "bytes" not in _tables:
        _tables["bytes"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    return _tables["bytes"][data]


def prefix(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash takes the hash of any span."""
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(len(symbols))[0], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[start]) * powers(len(sums))[1][start]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow string or binary array, and the offsets of the texts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8), offsets


def row_chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to limit bytes each; a longer row stands alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, rows)
        first = min(last, rows)


def is_space() -> np.ndarray:
    if "space" not in _tables:
        table = np.zeros(256, bool)
        table[[0x20, *range(0x09, 0x0E)]] = True
        _tables["space"] = table
    return _tables["space"]


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; gap has the bytes that are in no word, by value."""
    inside = ~gap[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    borders = offsets[1:-1] - offsets[0]
    if len(data):
        at = borders[borders < len(data)]
        starts[at] = inside[at]
        before = borders[borders > 0] - 1
        ends[before] = inside[before]
    start = np.flatnonzero(starts)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offsets - offsets[0], start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word; long data goes in slices that end with a word."""
    out = np.empty(len(start), np.uint64)
    done = 0
    while done < len(start):
        base = int(start[done])
        stop = max(done + 1, int(np.searchsorted(end, base + CHUNK, "right")))
        sums = prefix(byte_symbols(data[base:int(end[stop - 1])]))
        s, e = start[done:stop] - base, end[done:stop] - base
        out[done:stop] = mix(span_hash(sums, s, e) + (e - s).astype(np.uint64))
        done = stop
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, length numbers each, one after the other."""
    total = int(lengths.sum())
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:len(values) - (width - size)], values[width - size:])


def winnow(symbols: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The anchors of all windows of length symbols within the rows that bounds gives.

    A window's anchor is its leftmost smallest gram of gram symbols, so equal windows have equal anchors at
    equal places. Per anchor: its place, the first and last window start it answers for, the hash of its gram,
    and the hash of all symbols that those windows cover together with how they lie around the anchor.
    """
    none = np.zeros(0, np.int64)
    sizes = np.maximum(np.diff(bounds) - length + 1, 0)
    if not sizes.any():
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    n = len(symbols)
    if n >> PLACE_BITS:
        raise ValueError("cut long rows into slices first")
    sums = prefix(symbols)
    grams = mix((sums[gram:] - sums[:-gram]) * powers(n - gram + 1)[1])
    low = np.uint64(PLACE_BITS)
    keyed = (grams >> low << low) | np.arange(len(grams), dtype=np.uint64)
    smallest = sliding_min(keyed, length - gram + 1)
    window = ranges(bounds[:-1], sizes)
    anchor = (smallest[window] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    change = np.flatnonzero(np.diff(anchor)) + 1
    first, last = np.concatenate(([0], change)), np.concatenate((change - 1, [len(anchor) - 1]))
    place, lo, hi = anchor[first], window[first], window[last]
    around = ((place - lo) << 8 | (hi - lo)).astype(np.uint64)
    return place, lo, hi, grams[place], mix(span_hash(sums, lo, hi + length) ^ mix(around + np.uint64(1)))


def winnow_rows(symbols: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """winnow in slices for a row that is longer than a chunk; places count from the start of symbols.

    Byte values are turned into symbols slice by slice. Slices overlap by length - 1, so each window is in one.
    """
    size = len(symbols) if len(symbols) <= 2 * CHUNK else CHUNK
    for base in range(0, max(1, len(symbols)), max(1, size)):
        part = symbols[base:base + size + length - 1]
        own = bounds if size == len(symbols) else np.array([0, len(part)])
        found = winnow(byte_symbols(part) if part.dtype == np.uint8 else part, own, length, gram)
        yield *(x + base for x in found[:3]), *found[3:]
