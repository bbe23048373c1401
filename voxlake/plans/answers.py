"""Evidence tables behind answers to questions."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from voxlake import constants as K
from voxlake.functions.dates import event_day
from voxlake.functions.text import blank_to_null, strip
from voxlake.operators import fulltext
from voxlake.operators.filters import Corpus
from voxlake.plans.explore import search_documents


def retrieve(corpus: Corpus, question: str, filters: Mapping[str, Any] | None = None, *,
             top_n: int | None = None, index: fulltext.Index | None = None) -> DataFrame:
    """First page of a search for all words of the question."""
    return search_documents(corpus, question, filters, limit=max(1, top_n or K.EVIDENCE_ROWS), index=index)


def compact_evidence(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Short evidence rows; a document of no known source is of source `unknown`."""
    names = sources.select(F.col("id").alias("source_id"), "name")
    text = F.coalesce(blank_to_null(F.col("body")), F.col("title"), F.lit(""))
    return rows.join(names, "source_id", "left").select(
        "id",
        event_day().cast("string").alias("date"),
        F.coalesce("name", F.lit("unknown")).alias("source"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.substring(strip(F.replace(text, F.lit("\n"), F.lit(" "))), 1, K.EVIDENCE_CHARS).alias("snippet"),
        strip(F.coalesce("title", F.lit(""))).alias("title"),
    )


def text_list(c: Column, most: int | None = None) -> Column:
    """Trimmed non-blank texts; `most` keeps so many."""
    kept = F.filter(F.transform(c, lambda x: strip(x)), lambda x: x != "")
    out = F.coalesce(kept, F.array().cast("array<string>"))
    return out if most is None else F.slice(out, 1, most)


def known_citations(cited: Column, known: Column) -> Column:
    """Cited ids that are evidence ids, in the order cited."""
    kept = F.filter(cited, lambda x: F.array_contains(known, x))
    return F.coalesce(kept, F.array().cast("array<bigint>"))


def clean_answers(answers: DataFrame) -> DataFrame:
    """Answer records with their evidence ids in `evidence_ids`, cleaned.

    Too little evidence turns an answer into the fixed record that says so; an empty question is
    answered by the same record with its own reason.
    """
    blank = strip(F.coalesce("question", F.lit(""))) == ""
    few = blank | (F.size("evidence_ids") < K.MIN_ANSWER_EVIDENCE)
    nothing = F.array().cast("array<string>")
    reason = F.when(blank, K.EMPTY_QUESTION_REASON).otherwise(K.FEW_EVIDENCE_REASON)

    def unless_few(c: Column, instead: Column) -> Column:
        return F.when(few, instead).otherwise(c)

    own = {"answer", "key_points", "caveats", "contradictions", "cited_evidence_ids", "insufficient_evidence"}
    return answers.select(
        *[c for c in answers.columns if c not in own],
        few.alias("insufficient_evidence"),
        unless_few(
            F.coalesce(blank_to_null(F.col("answer")), F.lit(K.NO_ANSWER)), F.lit(K.NO_EVIDENCE_ANSWER)
        ).alias("answer"),
        unless_few(text_list(F.col("key_points")), nothing).alias("key_points"),
        unless_few(text_list(F.col("caveats")), F.array(reason)).alias("caveats"),
        unless_few(text_list(F.col("contradictions")), nothing).alias("contradictions"),
        unless_few(
            known_citations(F.col("cited_evidence_ids"), F.col("evidence_ids")),
            F.array().cast("array<bigint>"),
        ).alias("cited_evidence_ids"),
    )
