"""BPE encoding and decoding as streaming transducers.

Encoder. A text is cut at special tokens, normalised and cut into pieces; each piece is a stream of byte symbols,
the last one marked as a word's end. From the merge list a sufficient lookahead is computed: a token can only be
changed by symbols to its right through a chain of ever earlier merges, each of which takes the last part of what
the one before needs, and the longest such chain bounds how far to the right a token depends. The transducer
buffers no more than a window of that lookahead and a few tokens, merges within it, emits the tokens that are
further than the lookahead from the window's end (or all, at the piece's end), and goes on behind them. So memory
is constant for a piece of any length, and an ordinary word is one window.

Decoder. A state machine takes tokens one by one and emits text as soon as bytes complete a character; incomplete
or invalid bytes become U+FFFD as in UTF-8 decoding with replacement. Files without a decoder join the tokens'
strings with spaces instead.

Null texts count as empty and give no tokens. Rows are judged one by one, so repeated rows get equal results.
"""

from __future__ import annotations

import codecs
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxlake.llm.common import whole

CACHE = 500_000
LONG_PIECE = 64
# first UTF-8 byte of U+0500: classes of characters below are the same in all current Unicode versions
SETTLED = 0xD4


def byte_characters() -> list[str]:
    """The visible character that stands for each byte: printable Latin-1 as it is, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


def sufficient_lookahead(pairs: list[tuple[str, str]], suffix: str = "") -> int:
    """How many symbols to the right of a token decide whether it stays.

    Merge r of (u, v) needs v to its right. v, or a part that ends v, may instead be taken by an earlier merge
    with what follows it, which needs that merge's own lookahead, and so on down the list.
    """
    reach: dict[str, int] = {}  # by left token, over the merges so far
    right: dict[str, str] = {}  # the last part of a merged token
    most = 0
    for u, v in pairs:
        beyond, part = 0, v
        while part is not None:
            beyond = max(beyond, reach.get(part, 0))
            part = right.get(part)
        need = len(v.removesuffix(suffix)) + beyond
        reach[u] = max(reach.get(u, 0), need)
        right.setdefault(u + v, v)
        most = max(most, need)
    return most


class Vocabulary:
    """Tokens, merges and pattern of a tokenizer file with a byte-level BPE of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.width = max(self.names).bit_length()
        # a merge by its pair of ids: its rank, then the id it makes
        self.merges: dict[int, int] = {}
        for rank, (u, v) in enumerate(pairs):
            self.merges.setdefault(self.ids[u] << self.width | self.ids[v], rank << self.width | self.ids[u + v])
        self.never = len(pairs) << self.width
        self.lookahead = sufficient_lookahead(pairs, self.suffix)
        self.sizes = {i: len(t.removesuffix(self.suffix)) for t, i in self.ids.items()}
        self.longest = max(self.sizes.values())
        self.characters = byte_characters()
        self.bytes = {c: b for b, c in enumerate(self.characters)}
        self.starts = [self.ids[c] for c in self.characters]
        self.ends = [self.ids[c + self.suffix] for c in self.characters]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(
            r"\s", r"\p{White_Space}"))
        self.cut = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.library = Tokenizer.from_file(path)

    def pieces(self, text: str, settled: bool) -> list[str]:
        """The pieces of a text without special tokens.

        Which characters are letters or digits depends on the Unicode version. Texts with characters beyond those
        all versions agree on (settled is false) are normalised and cut as the file's own library does it.
        """
        if settled:
            # each capital sigma by itself, as lower-casing goes character by character
            return self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.bytes.__getitem__, piece)).decode() for piece, _ in cut]


class Encoder:
    """Encodes texts with bounded memory; short pieces that come again are looked up."""

    def __init__(self, vocabulary: Vocabulary, cache: int = CACHE):
        self.vocabulary, self.cache = vocabulary, cache
        self.known: dict[str, bytes] = {}

    def merged(self, tokens: list[int]) -> list[int]:
        """All merges within tokens, the earliest of the list first, from left to right; changes tokens."""
        get, never, width = self.vocabulary.merges.get, self.vocabulary.never, self.vocabulary.width
        made = (1 << width) - 1
        order = [get(u << width | v, never) for u, v in zip(tokens, tokens[1:])]
        while order:
            best = min(order)
            if best == never:
                break
            at = order.index(best)
            tokens[at] = token = best & made
            del tokens[at + 1], order[at]
            if at < len(order):
                order[at] = get(token << width | tokens[at + 1], never)
            if at:
                order[at - 1] = get(tokens[at - 1] << width | token, never)
        return tokens

    def stream(self, symbols: Iterable[int]) -> Iterator[int]:
        """Tokens of a stream of symbols, each as soon as nothing that may follow can change it."""
        lookahead, sizes = self.vocabulary.lookahead, self.vocabulary.sizes
        window = 2 * (lookahead + self.vocabulary.longest)
        buffer: list[int] = []
        for symbol in symbols:
            buffer.append(symbol)
            if len(buffer) > window:
                used, end = 0, len(buffer) - lookahead
                for token in self.merged(buffer.copy()):
                    if used + sizes[token] > end:
                        break
                    used += sizes[token]
                    yield token
                del buffer[:used]
        yield from self.merged(buffer)

    def symbols(self, piece: str) -> Iterator[int]:
        """Byte symbols of a piece, the last with the word's end."""
        raw = piece.encode()
        yield from map(self.vocabulary.starts.__getitem__, raw[:-1])
        yield self.vocabulary.ends[raw[-1]]

    def piece(self, piece: str) -> bytes:
        """The ids of a piece, as four bytes each."""
        found = array("i", self.stream(self.symbols(piece))).tobytes() if len(piece) > LONG_PIECE else array(
            "i", self.merged(list(self.symbols(piece)))).tobytes()
        if len(piece) <= LONG_PIECE:
            if len(self.known) >= self.cache:
                self.known.clear()
            self.known[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a text, as four bytes each."""
        if "<|" not in text:
            return self._plain(text)
        out, at = [], 0
        for found in self.vocabulary.cut.finditer(text):
            out += self._plain(text[at:found.start()]), array("i", [self.vocabulary.special[found.group()]]).tobytes()
            at = found.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        settled = text.isascii() or int(np.frombuffer(text.encode(), np.uint8).max()) < SETTLED
        known, piece = self.known.get, self.piece
        return b"".join([known(p) or piece(p) for p in self.vocabulary.pieces(text, settled)])


class Decoder:
    """Turns tokens into text, one by one."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, token: int) -> str:
        """The text that this token completes; ids that the file does not have give none."""
        vocabulary = self.vocabulary
        name = vocabulary.names.get(token)
        if name is None:
            return ""
        if name in vocabulary.special:
            pending = self.state.decode(b"", True)
            self.state.reset()
            return pending + name
        ends = bool(vocabulary.suffix) and name.endswith(vocabulary.suffix)
        raw = bytes(map(vocabulary.bytes.__getitem__, name.removesuffix(vocabulary.suffix)))
        return self.state.decode(raw) + (" " if ends else "")

    def finish(self) -> str:
        return self.state.decode(b"", True)


def joined(vocabulary: Vocabulary, ids: Iterable[int]) -> str:
    """The text of a file without a decoder: the tokens' strings, with spaces between."""
    return " ".join(map(vocabulary.names.__getitem__, ids))


def _encoded(path: str, keep: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(path))
        for part in parts:
            for at in range(0, part.num_rows, 512):
                own = part.slice(at, 512)
                found = [encoder.encode(text) for text in own.column("text").to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)
                ids = np.frombuffer(b"".join(found), np.int32)
                text = [joined(encoder.vocabulary, ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), *(own.column(f"k{i}") for i in range(keep)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(text, pa.string())],
                    names=["doc_id", *(f"k{i}" for i in range(keep)), "ids", "decoded"])
    return run


def bpe_round_trip(docs: DataFrame, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the kept columns, ids and decoded (the ids' text) of each row, by the tokenizer file at path."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"),
                       *(F.col(n).alias(f"k{i}") for i, n in enumerate(keep)))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    out = rows.mapInArrow(_encoded(path, len(keep)), ", ".join([*kinds, "ids array<int>", "decoded string"]))
    return out.select("doc_id", *(F.col(f"k{i}").alias(n) for i, n in enumerate(keep)), "ids", "decoded")
