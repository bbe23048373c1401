"""Incremental enrichment: candidates, rule labels, pluggable scorer, label clean-up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxlake import constants as K
from voxlake.functions import labels
from voxlake.functions.text import prepared_text, strip
from voxlake.operators.ranking import add_columns, narrow

MIN_TEXT_CHARS = 15
BATCH_SIZE = 3

# A scorer gets rows (document_id, text, rating) and returns rows with a document_id and any of the
# fields of REPLY_FIELDS.
Scorer = Callable[[pd.DataFrame], pd.DataFrame]
REPLY_FIELDS = (
    "document_id long, sentiment_label string, primary_issue_category string, "
    "feature_request_flag boolean, competitor_mentions array<string>, summary_snippet string"
)
_SCORED = REPLY_FIELDS + ", status string, failed_batch boolean"
_REPLY_COLUMNS = [f.split()[0] for f in REPLY_FIELDS.split(", ")]


def without_enrichment(documents: DataFrame, enrichments: DataFrame) -> DataFrame:
    done = enrichments.select(F.col("document_id").alias("id"))
    return documents.join(done, "id", "left_anti")


def candidates(documents: DataFrame, enrichments: DataFrame, sources: DataFrame,
               limit: int | None = None) -> DataFrame:
    """Documents without enrichment, oldest first; `limit=None` takes all of them in one run."""
    names = sources.select(F.col("id").alias("source_id"), F.col("platform").alias("source_platform"))
    rows = without_enrichment(documents, enrichments).join(names, "source_id")
    if limit is not None:
        few = rows.select(*narrow(rows, "id", "source_platform", "rating")).orderBy("id").limit(max(1, limit))
        rows = add_columns(few, documents, ["title", "body"]).orderBy("id")
    return rows.select("id", "title", "body", F.col("source_platform").alias("platform"), "rating")


def prepare(rows: DataFrame, *, min_chars: int = MIN_TEXT_CHARS, max_chars: int | None = None) -> DataFrame:
    """Adds the text to classify, the checked rating and whether the text is too short.

    Texts stay whole; `max_chars` cuts those that are not short, for a classifier with a small input.
    """
    text = prepared_text(F.col("title"), F.col("body"))
    measured = rows.select("*", F.inline(F.array(F.struct(text.alias("_text")))))
    short = F.length("_text") < min_chars
    return measured.select(
        F.col("id").alias("document_id"),
        "platform",
        labels.star_rating(F.col("rating")).alias("rating"),
        (F.col("_text") if max_chars is None else F.when(short, F.col("_text")).otherwise(
            F.substring("_text", 1, max_chars))).alias("text"),
        short.alias("is_short"),
    )


def rule_enrichment(short: DataFrame) -> DataFrame:
    """Rule labels for texts too short to classify."""
    return short.select(
        "document_id",
        F.lit(K.FALLBACK_MODEL).alias("model_name"),
        F.substring("text", 1, K.FALLBACK_SNIPPET_CHARS).alias("summary"),
        labels.rule_sentiment(F.col("text"), F.col("rating")).alias("sentiment_label"),
        F.lit("other").alias("primary_issue_category"),
        F.lit(False).alias("feature_request_flag"),
        F.array().cast("array<string>").alias("competitor_mentions"),
        "rating",
    )


def rule_scorer(batch: pd.DataFrame) -> pd.DataFrame:
    """The label rules as a scorer for `score`; runs without a classifier take `rule_replies`."""
    rating, lowered = batch["rating"].astype("float64"), batch["text"].str.lower()
    has = {words: lowered.str.contains("|".join(words), regex=True) for words in (K.NEGATIVE_WORDS, K.POSITIVE_WORDS)}
    label = np.select(
        [rating <= 2, rating >= 4, has[K.NEGATIVE_WORDS], has[K.POSITIVE_WORDS]],
        ["negative", "positive", "negative", "positive"], "neutral",
    )
    return pd.DataFrame({"document_id": batch["document_id"], "sentiment_label": label, "summary_snippet": batch["text"]})


def rule_replies(rows: DataFrame) -> DataFrame:
    """What `score` gives with `rule_scorer`, as plain columns."""
    rating = F.when(F.col("platform") == K.GOOGLE_PLAY, F.col("rating"))
    return rows.select(
        "document_id", labels.rule_sentiment(F.col("text"), rating).alias("sentiment_label"),
        F.lit(None).cast("string").alias("primary_issue_category"), F.lit(None).cast("boolean").alias("feature_request_flag"),
        F.lit(None).cast("array<string>").alias("competitor_mentions"), F.col("text").alias("summary_snippet"),
        F.lit("enriched").alias("status"), F.lit(False).alias("failed_batch"),
    )


def score(rows: DataFrame, scorer: Scorer, *, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Replies of the scorer, matched to the rows they were asked for.

    A batch whose scorer fails is skipped and marked; the last reply to a document wins; replies to
    unknown documents are ignored. Ratings are passed on for app reviews only.
    """
    size = max(1, batch_size)

    def answers(batch: pd.DataFrame) -> pd.DataFrame:
        ids = batch[["document_id"]]
        try:
            reply = scorer(batch)
            usable = reply.dropna(subset=["document_id"]).drop_duplicates("document_id", keep="last")
            out = ids.merge(usable.reindex(columns=_REPLY_COLUMNS).assign(status="enriched"),
                            on="document_id", how="left")
            out["status"] = out["status"].fillna("no_reply")
            failed = [False] * len(out)
        except Exception:  # any failure of the caller's scorer costs this batch only
            out = ids.reindex(columns=_REPLY_COLUMNS).assign(status="failed")
            failed = [True] + [False] * (len(out) - 1)
        # Fields without a value are NULL, whatever their type.
        return out.astype(object).where(out.notna(), None).assign(failed_batch=failed)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # less than one batch, from parts of any size
        for part in parts:
            held.append(part)
            if sum(map(len, held)) >= size:
                rows = pd.concat(held, ignore_index=True)
                whole = len(rows) // size * size
                for start in range(0, whole, size):
                    yield answers(rows.iloc[start:start + size].reset_index(drop=True))
                held = [rows.iloc[whole:]]
        rest = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
        if len(rest):
            yield answers(rest)

    asked = rows.select(
        "document_id", "text",
        F.when(F.col("platform") == K.GOOGLE_PLAY, F.col("rating")).alias("rating"),
    )
    return asked.mapInPandas(run, _SCORED)


def parse_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Raw classifier replies to one row per answered document; malformed replies give none.

    `position` is the place in the reply. Input columns other than the reply pass through.
    """
    item = ("struct<document_id:string,sentiment_label:string,primary_issue_category:string,"
            "feature_request_flag:string,competitor_mentions:array<string>,summary_snippet:string>")
    parsed = F.from_json(F.col(reply), f"struct<documents:array<{item}>>")
    return (
        replies.select(*[c for c in replies.columns if c != reply], F.posexplode(parsed["documents"]).alias("position", "item"))
        .where(F.col("item").isNotNull())
        .select("*", "item.*")
        .drop("item")
        .withColumn("document_id", F.col("document_id").try_cast("long"))
        .where(F.col("document_id").isNotNull())
        .withColumn("feature_request_flag", F.coalesce(F.lower("feature_request_flag").isin("true", "1"), F.lit(False)))
    )


def last_reply(parsed: DataFrame, *order: str) -> DataFrame:
    """The last reply per document."""
    window = Window.partitionBy("document_id").orderBy(*[F.desc(c) for c in order])
    return parsed.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def clean_reply(model_name: str) -> list[Column]:
    """Reply fields in their allowed values."""
    return [
        F.lit(model_name).alias("model_name"),
        F.substring(strip(F.coalesce("summary_snippet", F.lit(""))), 1, K.SNIPPET_CHARS).alias("summary"),
        labels.sentiment_label(F.col("sentiment_label")).alias("sentiment_label"),
        labels.issue_category(F.col("primary_issue_category")).alias("primary_issue_category"),
        F.coalesce("feature_request_flag", F.lit(False)).alias("feature_request_flag"),
        labels.competitor_list(F.col("competitor_mentions")).alias("competitor_mentions"),
    ]


def with_metadata(rows: DataFrame, *, prompt_version: str, enriched_at: Column) -> DataFrame:
    """Adds the JSON payload that is stored beside the typed columns."""
    return rows.withColumn(
        "metadata_json",
        F.to_json(
            F.struct(
                "rating", "sentiment_label", "primary_issue_category",
                F.col("primary_issue_category").alias("issue_category"),
                "feature_request_flag", "competitor_mentions",
                F.col("summary").alias("summary_snippet"), "model_name",
                F.lit(prompt_version).alias("prompt_version"), enriched_at.alias("enriched_at"),
            ),
            {"ignoreNullFields": "false"},
        ),
    )


def promote(enrichments: DataFrame) -> DataFrame:
    """Typed columns from the JSON payload of rows written elsewhere; one parse per row."""
    parsed = F.from_json(
        "metadata_json",
        "struct<sentiment_label:string,sentiment:struct<label:string>,primary_issue_category:string,"
        "feature_request_flag:string,competitor_mentions:array<string>,rating:string>",
    )
    return enrichments.select("document_id", F.inline(F.array(F.struct(parsed.alias("_m"))))).select(
        "document_id",
        F.coalesce("_m.sentiment_label", "_m.sentiment.label").alias("sentiment_label"),
        F.col("_m.primary_issue_category").alias("primary_issue_category"),
        F.coalesce(F.lower("_m.feature_request_flag").isin("true", "1"), F.lit(False)).alias("feature_request_flag"),
        F.col("_m.competitor_mentions").alias("competitor_mentions"),
        labels.star_rating(F.col("_m.rating")).alias("rating"),
    )


def statistics(outcome: DataFrame) -> DataFrame:
    """Run counters from rows (status, failed_batch); status is one of short, enriched, no_reply, failed."""
    return outcome.agg(
        F.count("*").alias("candidates"),
        F.count_if(F.col("status").isin("short", "enriched")).alias("enriched"),
        F.count_if(F.col("status") == "short").alias("skipped_short"),
        F.count_if(F.coalesce("failed_batch", F.lit(False))).alias("failed_batches"),
    )
