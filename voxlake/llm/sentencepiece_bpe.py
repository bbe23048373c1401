"""SentencePiece encoding and decoding for merge-type models, by backtracking.

A list of pieces is the encoding of a text if and only if every two neighbours are: merges happen in an order that any
part of the text shares, so the first merge across a border of pieces would also happen in the two pieces alone. The
encoder goes from left to right and takes the longest piece that starts at its place (from an Aho-Corasick automaton, run
once over the text); a piece is compatible with the one before if re-merging their characters gives just these two. If
not, its next shorter prefix is tried; if none is left, the place is marked in a bitfield as failed, so that nobody comes
there again, and the piece before gives way. So each place is left at most once, and the work is linear in the text.
The words of a batch that are new are read side by side: each step looks up what fits for all their (last piece, longest
piece) at once, goes on where something does and back where nothing does.

Spaces become U+2581, with one in front of the text. Where no piece has U+2581 behind another character (checked), texts
are cut there into words, and short words that come again are looked up. Characters without a piece are their UTF-8
bytes' pieces and part the text, since nothing merges with them.

The decoder turns runs of byte pieces into characters (each byte that is in none becomes U+FFFD), U+2581 into spaces, takes
one space off the front, and gives nothing for control ids.

Null texts count as empty and have the end id only (if asked for). Rows are judged one by one, so repeated rows get equal
results. Models that normalise texts, remove spaces, have symbols of the user or no byte pieces are refused.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import whole

SPACE = "▁"
CACHE = 500_000
LENGTH_BITS = 8
LENGTH = (1 << LENGTH_BITS) - 1
NUMBER_BITS = 32
LONG_WORD = 64
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces in a model file
BPE = 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message: whole numbers, or bytes of all other kinds."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at:at + size], at + size
        yield tag >> 3, value


class Model:
    """Pieces of a model file, and the merges they allow."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            fields = list(message(file.read()))
        trainer, normalizer = ({k: v for n, own in fields if n == number for k, v in message(own)} for number in (2, 3))
        if trainer.get(3, 1) != BPE or not trainer.get(35, 0) or trainer.get(24, 0):
            raise ValueError("not a merge-type model with byte pieces and spaces in front of words")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("the model normalises its texts")
        self.prefix = bool(normalizer.get(3, 1))
        self.end: int = trainer.get(42, 2)
        self.ids: dict[str, int] = {}
        self.texts: list[str] = []
        self.byte_ids, scores = [0] * 256, {}
        for number, own in enumerate(v for n, v in fields if n == 1):
            entry = dict(message(own))
            piece, kind = entry[1].decode(), entry.get(3, NORMAL)
            if kind == BYTE:
                self.byte_ids[int(piece[3:5], 16)] = number
            elif kind == NORMAL:
                self.ids[piece], scores[piece] = number, struct.unpack("<f", entry.get(2, bytes(4)))[0]
            elif kind not in (UNKNOWN, CONTROL):
                raise ValueError(f"the model has pieces of kind {kind}")
            self.texts.append(piece.replace(SPACE, " ") if kind == NORMAL else " ⁇ " if kind == UNKNOWN else "")
        self.byte_of = np.full(len(self.texts), -1)
        self.byte_of[self.byte_ids] = np.arange(256)
        self.spaced = np.zeros(len(self.texts), bool)
        self.spaced[[n for p, n in self.ids.items() if p.startswith(SPACE)]] = True
        self.silent = np.array([not t for t in self.texts]) & (self.byte_of < 0)
        # pieces of equal score share a rank: among them the leftmost merges first
        order = {s: i for i, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in scores.items()}
        letters = {c for p in self.ids for c in p}
        if not letters <= self.ids.keys():
            raise ValueError("a character of a piece is no piece itself")
        own = f"[{re.escape(''.join(sorted(letters)))}]+"
        self.pure, self.parts = re.compile(own), re.compile(f"{own}|.", re.DOTALL)
        apart = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.words = re.compile(r".+" if apart else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", re.DOTALL)
        self.names = dict(zip(self.ids.values(), self.ids))
        # a piece as one number: its id, and in the low bits its length
        self.numbers = {p: i << LENGTH_BITS | len(p) for p, i in self.ids.items()}
        if max(map(len, self.ids)) >> LENGTH_BITS:
            raise ValueError("a piece is too long")
        # by id, the number of the longest piece that is a proper prefix
        self.shorter = np.zeros(len(self.texts), np.int64)
        for piece, number in self.ids.items():
            self.shorter[number] = next((self.numbers[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ids), 0)
        self.automaton = ahocorasick.Automaton()
        for piece, number in self.numbers.items():
            self.automaton.add_word(piece, number)
        self.automaton.make_automaton()

    def longest(self, text: str) -> list[int]:
        """The number of the longest piece that starts at each place of a text, 0 for none."""
        found = [0] * (len(text) + 1)
        for end, number in self.automaton.iter(text):
            found[end + 1 - (number & LENGTH)] = number  # ends rise, so the last one for a start is the longest
        return found


class Fits:
    """A table of numbers by (last, piece), looked up for many at once; open addressing."""

    def __init__(self, bits: int = 21):
        self.bits, self.used = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)

    def find(self, keys: np.ndarray, make: Callable[[int], int]) -> np.ndarray:
        """The values of keys; make gives those that are not there yet."""
        if self.used > len(self.keys) // 2:
            self.keys.fill(-1)
            self.used = 0
        out = np.empty(len(keys), np.int64)
        slot = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            held = self.keys[slot[left]]
            hit, empty = held == keys[left], held < 0
            out[left[hit]] = self.values[slot[left[hit]]]
            for i in left[empty].tolist():
                if self.used > len(self.keys) // 4 * 3:  # also within one call: what is lost is made again
                    self.keys.fill(-1)
                    self.used = 0
                key, at = int(keys[i]), int(slot[i])
                while self.keys[at] not in (-1, key):
                    at = (at + 1) & (len(self.keys) - 1)
                if self.keys[at] < 0:
                    self.keys[at], self.values[at] = key, make(key)
                    self.used += 1
                out[i] = self.values[at]
            left = left[~hit & ~empty]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
        return out


class Encoder:
    """Encodes texts; what it has found out about words and pairs of pieces is kept up to a bound."""

    def __init__(self, model: Model, cache: int = CACHE):
        self.model, self.cache = model, cache
        self.known: dict[str, bytes] = {}
        self.agree: dict[tuple[str, str], bool] = {}
        self.fits = Fits()

    def stay(self, last: str, piece: str) -> bool:
        """Whether all merges of two pieces' characters, the best first and of equals the leftmost, end with these two."""
        rank, never = self.model.rank.get, len(self.model.rank)
        text = last + piece
        parts, border = list(text), len(last)  # so many parts lie before the border
        order = [rank(text[i:i + 2], never) for i in range(len(text) - 1)]
        while order and (best := min(order)) < never:
            at = order.index(best)
            if at < border:
                border -= 1
                if at == border:
                    return False
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del order[at]
            if at < len(order):
                order[at] = rank(parts[at] + parts[at + 1], never)
            if at:
                order[at - 1] = rank(parts[at - 1] + parts[at], never)
        return len(parts) == bool(last) + 1

    def compatible(self, last: str, piece: str) -> bool:
        """Whether two pieces (the first may be empty) stay as they are when their characters are merged anew."""
        found = self.agree.get((last, piece))
        if found is None:
            if len(self.agree) >= self.cache:
                self.agree.clear()
            found = self.agree[last, piece] = self.stay(last, piece)
        return found

    def next_shorter(self, piece: str) -> str:
        """The longest piece that is a proper prefix of a piece, or nothing."""
        return piece[:int(self.model.shorter[self.model.ids[piece]]) & LENGTH]

    def fitting(self, last: str, piece: str) -> str:
        """The first of a piece and its ever shorter prefixes that is compatible with the last piece, or nothing."""
        while piece and not self.compatible(last, piece):
            piece = self.next_shorter(piece)
        return piece

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text all of whose characters are pieces."""
        longest = [n & LENGTH for n in self.model.longest(text)]
        failed = bytearray(len(text) // 8 + 1)
        out: list[str] = []
        at, piece, last = 0, text[:longest[0]], ""
        while at < len(text):
            piece = self.fitting(last, piece)
            while piece and failed[(at + len(piece)) >> 3] >> ((at + len(piece)) & 7) & 1:
                piece = self.fitting(last, self.next_shorter(piece))
            if piece:
                out.append(piece)
                at, last = at + len(piece), piece
                piece = text[at:at + longest[at]]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()  # tried again, it finds its end failed and gives way to a shorter one
                at -= len(piece)
                last = out[-1] if out else ""
        return out

    def _fit(self, key: int) -> int:
        last, number = key >> NUMBER_BITS, key & ((1 << NUMBER_BITS) - 1)
        names = self.model.names
        piece = self.fitting(names[last - 1] if last else "", names[number >> LENGTH_BITS])
        return self.model.numbers.get(piece, 0)

    def learn(self, parts: list[str]) -> None:
        """Finds the ids of parts without characters that are no pieces, all at once."""
        size = np.array([len(p) for p in parts])
        end = np.cumsum(size)
        longest = np.array(self.model.longest("".join(parts)))
        # no piece may reach beyond its part: where one does, the longest that does not
        room = np.repeat(end, size) - np.arange(end[-1])
        for i in np.flatnonzero((longest[:-1] & LENGTH) > room).tolist():
            piece = self.model.names[int(longest[i]) >> LENGTH_BITS]
            longest[i] = self.model.numbers[next(piece[:n] for n in range(int(room[i]), 0, -1) if piece[:n] in self.model.ids)]
        rows = len(parts)
        failed = np.zeros(len(longest), bool)  # by place; a part's end is the next one's start, which never fails
        stack, depth = np.zeros((rows, int(size.max()) + 1), np.int64), np.zeros(rows, np.int64)
        at, last = end - size, np.zeros(rows, np.int64)
        piece = longest[at]
        active = np.arange(rows)
        while len(active):
            found = self._fitting_free(at[active], last[active], piece[active], failed)
            on, back = active[found > 0], active[found <= 0]
            found = found[found > 0]
            stack[on, depth[on]] = found
            depth[on] += 1
            at[on] += found & LENGTH
            last[on] = (found >> LENGTH_BITS) + 1
            piece[on] = longest[at[on]]
            failed[at[back]] = True
            depth[back] -= 1
            piece[back] = stack[back, depth[back]]  # tried again, it finds its end failed and gives way to a shorter one
            at[back] -= piece[back] & LENGTH
            last[back] = np.where(depth[back] > 0, (stack[back, depth[back] - 1] >> LENGTH_BITS) + 1, 0)
            active = active[at[active] < end[active]]
        ids = (stack[np.arange(stack.shape[1]) < depth[:, None]] >> LENGTH_BITS).astype(np.int32).tobytes()
        border = (4 * np.cumsum(depth)).tolist()
        for part, a, b in zip(parts, [0, *border], border):
            self.known[part] = ids[a:b]

    def _fitting_free(self, at: np.ndarray, last: np.ndarray, piece: np.ndarray, failed: np.ndarray) -> np.ndarray:
        """The first fitting prefix of each piece that does not end at a failed place, or 0."""
        found = self.fits.find(last << NUMBER_BITS | piece, self._fit)
        open_ = np.flatnonzero((found > 0) & failed[at + (found & LENGTH)])
        while len(open_):
            shorter = self.model.shorter[found[open_] >> LENGTH_BITS]
            found[open_] = 0
            open_, shorter = open_[shorter > 0], shorter[shorter > 0]
            found[open_] = self.fits.find(last[open_] << NUMBER_BITS | shorter, self._fit)
            open_ = open_[(found[open_] > 0) & failed[at[open_] + (found[open_] & LENGTH)]]
        return found

    def _ids(self, pieces: list[str]) -> bytes:
        return array("i", map(self.model.ids.__getitem__, pieces)).tobytes()

    def word(self, word: str) -> bytes:
        """The ids of a word, as four bytes each; its parts may be known."""
        found = []
        for part in self.model.parts.findall(word):
            if part[0] in self.model.ids:
                found.append(self.known.get(part) or self._ids(self.pieces(part)))
            else:
                found.append(array("i", map(self.model.byte_ids.__getitem__, part.encode("utf-8", "replace"))).tobytes())
        return b"".join(found)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of texts, as four bytes each."""
        if len(self.known) >= self.cache:
            self.known.clear()
        known, model = self.known, self.model
        cut = []
        for text in texts:
            spaced = text.replace(" ", SPACE)
            cut.append(model.words.findall(SPACE + spaced if model.prefix and text else spaced))
        new = {w for w in set().union(*cut).difference(known) if len(w) <= LONG_WORD}
        mixed = [w for w in new if not model.pure.fullmatch(w)]
        fresh = new.difference(mixed)
        fresh.update(p for w in mixed for p in model.parts.findall(w) if p[0] in model.ids and p not in known)
        if fresh:
            self.learn(list(fresh))
        for word in mixed:
            known[word] = self.word(word)
        return [self._joined(words) for words in cut]

    def _joined(self, words: list[str]) -> bytes:
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:  # words that are too long to be kept
            return b"".join([self.known.get(w) or self.word(w) for w in words])


def byte_text(raw: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that belongs to no character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in range(1, 5):
                try:
                    out.append(raw[at:at + size].decode())
                    break
                except UnicodeDecodeError:
                    size = 1
            else:
                out.append("�")
            at += size
        return "".join(out)


def decode(model: Model, ids: np.ndarray) -> str:
    """The text of ids that the model has."""
    if not len(ids):
        return ""
    raw = model.byte_of[ids]
    border = np.flatnonzero(np.diff(raw >= 0)) + 1
    out = []
    for a, b in zip([0, *border.tolist()], [*border.tolist(), len(ids)], strict=True):
        out.append(byte_text(raw[a:b].astype(np.uint8).tobytes()) if raw[a] >= 0 else "".join(
            map(model.texts.__getitem__, ids[a:b].tolist())))
    text = "".join(out)
    return text[1:] if model.prefix and model.spaced[ids[np.argmin(model.silent[ids])]] else text


def _encoded(path: str, keep: int, end: bool):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(path)
        encoder = Encoder(model)
        last = array("i", [model.end]).tobytes() if end else b""
        for part in parts:
            for at in range(0, part.num_rows, 512):
                own = part.slice(at, 512)
                found = [ids + last for ids in encoder.encode_all(own.column("text").to_pylist())]
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)
                ids = np.frombuffer(b"".join(found), np.int32)
                text = [decode(model, ids[a:b]) for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), *(own.column(f"k{i}") for i in range(keep)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(text, pa.string())],
                    names=["doc_id", *(f"k{i}" for i in range(keep)), "ids", "decoded"])
    return run


def piece_round_trip(docs: DataFrame, path: str, keep: tuple[str, ...] = (), end: bool = True) -> DataFrame:
    """doc_id, the kept columns, ids (with the end id, if wanted) and decoded of each row, by the model file at path."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"),
                       *(F.col(n).alias(f"k{i}") for i, n in enumerate(keep)))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    out = rows.mapInArrow(_encoded(path, len(keep), end), ", ".join([*kinds, "ids array<int>", "decoded string"]))
    return out.select("doc_id", *(F.col(f"k{i}").alias(n) for i, n in enumerate(keep)), "ids", "decoded")
