"""Tagging with taxonomies of many aliases: one pass over each text finds the places of all of them.

An automaton over all aliases of all types goes to each task with the function (it is job configuration: its size is that
of the taxonomy, not of the data). The claim rule is that of `tagging.matched_values`, and so are the results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

Pairs = Sequence[tuple[str, str]]


class AliasMatcher:
    """Claims of every type's (canonical, alias) pairs, which are given in claim order."""

    def __init__(self, pairs_by_type: Sequence[tuple[str, Pairs]]):
        import ahocorasick

        self.types = [t for t, _ in pairs_by_type]
        # Per alias, its entries: (type, place in the claim order, canonical value).
        entries: dict[str, list[tuple[int, int, str]]] = {}
        for kind, (_, pairs) in enumerate(pairs_by_type):
            for rank, (canonical, alias) in enumerate(pairs):
                if alias:
                    entries.setdefault(alias, []).append((kind, rank, canonical))
        self.entries = list(entries.values())
        self.lengths = [len(alias) for alias in entries]
        self.automaton = ahocorasick.Automaton()
        for number, alias in enumerate(entries):
            self.automaton.add_word(alias, number)
        if entries:
            self.automaton.make_automaton()

    def _whole_words(self, text: str) -> dict[int, list[int]]:
        """Starts of each alias where it stands between word borders, in order."""
        places: dict[int, list[int]] = {}
        last = len(text) - 1
        for end, number in self.automaton.iter(text):
            start = end - self.lengths[number] + 1
            if (start and _in_word(text[start - 1])) or (end < last and _in_word(text[end + 1])):
                continue
            places.setdefault(number, []).append(start)
        return places

    def tags(self, text: str | None) -> list[tuple[str, str]]:
        """Each type's values, sorted, as (type, value)."""
        if not text or not self.entries:
            return []
        places = self._whole_words(text)
        waiting = sorted((kind, rank, canonical, number) for number in places for kind, rank, canonical in self.entries[number])
        found: set[tuple[int, str]] = set()
        current, taken, tried = -1, bytearray(), {}
        for kind, _, canonical, number in waiting:
            if kind != current:
                current, taken, tried = kind, bytearray(len(text)), {}
            starts, length = places[number], self.lengths[number]
            # A place that is taken stays taken, so an alias of several values goes on where it was.
            for i in range(tried.get(number, 0), len(starts)):
                begin = starts[i]
                if taken.find(1, begin, begin + length) < 0:
                    taken[begin:begin + length] = b"\x01" * length
                    found.add((kind, canonical))
                    tried[number] = i + 1
                    break
            else:
                tried[number] = len(starts)
        return [(self.types[kind], value) for kind, value in sorted(found)]


def _in_word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def match_tags(texts: DataFrame, pairs_by_type: Sequence[tuple[str, Pairs]]) -> DataFrame:
    """(document_id, tag_type, tag_value) of rows (document_id, _text) with prepared texts.

    Only narrow rows come back; a batch's texts are read one by one.
    """
    kind = texts.schema["document_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = AliasMatcher(pairs_by_type)  # once a task
        for batch in batches:
            rows, types, tag_values = [], [], []
            for row, text in enumerate(batch.column(1)):
                for tag_type, value in matcher.tags(text.as_py()):
                    rows.append(row)
                    types.append(tag_type)
                    tag_values.append(value)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(types, pa.string()), pa.array(tag_values, pa.string())],
                ["document_id", "tag_type", "tag_value"])

    return texts.select("document_id", "_text").mapInArrow(run, f"document_id {kind}, tag_type string, tag_value string")
