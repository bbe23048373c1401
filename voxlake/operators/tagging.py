"""Rule tagging against a taxonomy.

The taxonomy is job configuration. A small one travels inside the expression as a constant array, without Python; the work
for a text grows with the aliases then. A large one is matched in one pass over each text (`tagmatch.py`), with the same
results. Either way documents are tagged where they lie, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxlake import constants as K
from voxlake.functions.text import blank_to_null, tagging_text
from voxlake.operators.tagmatch import match_tags

# Up to so many aliases are matched by a native expression.
NATIVE_ALIASES = 200

# Stand-ins for claimed characters. They keep the difference between word characters and others, so
# that the word borders around a claim stay where they were.
_CLAIMED_WORD, _CLAIMED_OTHER = "\ua66e", "\ue000"


@dataclass(frozen=True)
class Taxonomy:
    """(tag type, canonical value, alias) entries; each canonical value is its own alias."""

    entries: tuple[tuple[str, str, str], ...]

    @classmethod
    def of(cls, raw: Mapping[str, Any]) -> Taxonomy:
        def clean(values: Sequence[Any] | None) -> list[str]:
            return [str(v).strip().lower() for v in values or [] if str(v).strip()]

        entries = []
        for tag_type in K.TAG_TYPES:
            aliases = {
                str(k).strip().lower(): clean(v) for k, v in (raw.get(f"{tag_type}_aliases") or {}).items()
            }
            for canonical in clean(raw.get(f"{tag_type}s")):
                for alias in (canonical, *aliases.get(canonical, ())):
                    entries.append((tag_type, canonical, alias))
        return cls(tuple(entries))

    def of_type(self, tag_type: str) -> list[tuple[str, str]]:
        """(canonical, alias), longest alias first, listing order among equals."""
        pairs = [(c, a) for t, c, a in self.entries if t == tag_type]
        return sorted(pairs, key=lambda p: -len(p[1]))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            list(self.entries), "tag_type string, canonical string, alias string"
        )


def _mask(alias: str) -> str:
    return "".join(_CLAIMED_WORD if ch.isalnum() or ch == "_" else _CLAIMED_OTHER for ch in alias)


def _quote(alias: str) -> str:
    return "\\Q" + alias.replace("\\E", "\\E\\\\E\\Q") + "\\E"


_WORD = r"[\p{L}\p{N}_]"


def _claim_pattern(alias: str) -> str:
    # The literal comes first, so that the search skips ahead; word borders are checked after a hit.
    literal = _quote(alias)
    return f"{literal}(?<!{_WORD}{literal})(?!{_WORD})"


def matched_values(text: Column, taxonomy: Taxonomy, tag_type: str) -> Column:
    """Sorted canonical values whose alias claims a whole-word place in the prepared text.

    Aliases claim in order of length; a place can be claimed once. The fold carries the text with
    claimed places masked.
    """
    pairs = taxonomy.of_type(tag_type)
    if not pairs:
        return F.array().cast("array<string>")
    aliases = F.array(
        *[
            F.struct(
                F.lit(canonical).alias("canonical"),
                F.lit(alias).alias("alias"),
                F.lit(_claim_pattern(alias)).alias("pattern"),
                F.lit(_mask(alias)).alias("mask"),
            )
            for canonical, alias in pairs
        ]
    )
    candidates = F.filter(aliases, lambda a: F.contains(text, a["alias"]))
    start = F.struct(text.alias("text"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, a: Column) -> Column:
        # Cut the text at the first free place; the one-element transform names the pieces.
        cut = F.array(F.split(state["text"], a["pattern"], 2))
        return F.transform(
            cut,
            lambda pieces: F.when(
                F.size(pieces) == 2,
                F.struct(
                    F.concat(pieces[0], a["mask"], pieces[1]).alias("text"),
                    F.array_append(state["found"], a["canonical"]).alias("found"),
                ),
            ).otherwise(state),
        )[0]

    found = F.aggregate(candidates, start, step, lambda s: s["found"])
    return F.array_sort(F.array_distinct(found))


def _typed(tag_type: str, values: Column) -> Column:
    return F.transform(
        values, lambda v: F.struct(F.lit(tag_type).alias("tag_type"), v.alias("tag_value"))
    )


def document_text() -> Column:
    """Title and body as one text."""
    return F.concat_ws(" ", blank_to_null(F.col("title")), blank_to_null(F.col("body")))


def tag_documents(documents: DataFrame, taxonomy: Taxonomy, *, types: Sequence[str] = K.TAG_TYPES,
                  text: Column | None = None, confidence: float | None = 1.0,
                  native_aliases: int = NATIVE_ALIASES) -> DataFrame:
    """One row per document, tag type and value."""
    prepared = tagging_text(document_text() if text is None else text)
    texts = documents.select(F.col("id").alias("document_id"), prepared.alias("_text"))
    if sum(t in types for t, _, _ in taxonomy.entries) > native_aliases:
        tags = match_tags(texts, [(t, taxonomy.of_type(t)) for t in types])
    else:
        per_type = [_typed(t, matched_values(F.col("_text"), taxonomy, t)) for t in types]
        tags = texts.select("document_id", F.explode(F.concat(*per_type)).alias("tag")).select("document_id", "tag.*")
    return tags.select(
        "document_id", "tag_type", "tag_value", F.lit("rules").alias("tag_source"),
        F.lit(confidence).cast("double").alias("confidence"),
    )
