"""Canonical views over the driver's tables; `oracles.py` spells the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxlake import constants as K
from voxlake.operators.filters import Corpus
from voxlake.operators.tagging import Taxonomy, tag_documents

PLATFORMS = (K.REDDIT, K.GOOGLE_PLAY, K.WEB_REVIEWS)

# Words that occur in the texts. No alias shares a word with another of its type.
TAXONOMY = Taxonomy.of(
    {
        "products": ["this", "with"],
        "product_aliases": {"this": ["que la"], "with": ["und die"]},
        "issues": ["hate", "from"],
        "issue_aliases": {"from": ["the and"]},
        "competitors": ["anble", "inble"],
        "competitor_aliases": {"anble": ["reble"]},
        "features": ["thre", "tion", "than"],
        "feature_aliases": {"thre": ["dans le"]},
    }
)

# Phrases that share words with each other and with the single words: all words of three letters.
PHRASES = ("the and the", "the and", "and the", "of the", "the of", "the the")


def large_taxonomy() -> Taxonomy:
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c for a in letters for b in letters for c in letters]
    return Taxonomy.of({"features": [*PHRASES, *words]})


SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
    "benchmark": "item_id long, text string",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def sources(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, p, p, p) for i, p in enumerate(PLATFORMS)]
    return spark.createDataFrame(rows, "id long, platform string, external_id string, name string")


_PLATFORM = "element_at(array('reddit', 'google_play', 'web_reviews'), cast(doc_id % 3 + 1 AS int))"
_RATING = "CASE WHEN doc_id % 6 <> 0 THEN doc_id % 6 END"
_LABEL = ("CASE WHEN quality = 1 AND toxic = 1 THEN 'mixed' WHEN toxic = 1 THEN 'negative' "
          "WHEN quality = 1 THEN 'positive' ELSE 'neutral' END")
_CATEGORIES = ", ".join(f"'{c}'" for c in K.ISSUE_CATEGORIES)
_CATEGORY = f"CASE WHEN doc_id % 13 <> 0 THEN element_at(array({_CATEGORIES}), cast(doc_id % 9 + 1 AS int)) END"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(
        "doc_id AS id",
        "1 + doc_id % 3 AS source_id",
        "cast(doc_id AS string) AS external_id",
        "substring_index(text, '\n', 1) AS title",
        "text AS body",
        "concat('user', doc_id % 97) AS author",
        f"concat('https://', {_PLATFORM}, '.example.com/reviews/', doc_id) AS url",
        "CASE WHEN doc_id % 11 <> 0 THEN timestamp '2024-01-01' "
        "+ make_dt_interval(cast(doc_id % 60 AS int), cast(doc_id % 24 AS int)) END AS published_at",
        "timestamp '2024-03-15' AS created_at",
        f"to_json(named_struct('platform', {_PLATFORM}, 'rating', {_RATING}, 'subreddit', lang, "
        "'community_or_channel', source)) AS raw_json",
        "lang AS subreddit",
        "source AS community_or_channel",
        f"{_RATING} AS rating",
        f"{_PLATFORM} AS platform",
    )


def enrichments(spark: SparkSession, sf: str) -> DataFrame:
    # One part of the rows carries the label at the nested place of the payload only.
    return table(spark, sf, "labels").selectExpr(
        "doc_id AS document_id",
        "CASE WHEN doc_id % 7 = 0 THEN concat('Summary of ', doc_id) END AS summary",
        f"{_LABEL} AS sentiment_label",
        f"{_CATEGORY} AS primary_issue_category",
        "doc_id % 4 = 0 AS feature_request_flag",
        f"to_json(named_struct('sentiment_label', CASE WHEN doc_id % 5 <> 1 THEN {_LABEL} END, "
        f"'sentiment', CASE WHEN doc_id % 5 = 1 THEN named_struct('label', {_LABEL}) END, "
        f"'primary_issue_category', {_CATEGORY}, 'feature_request_flag', doc_id % 4 = 0)) AS metadata_json",
    )


def tags(spark: SparkSession, sf: str) -> DataFrame:
    return tag_documents(documents(spark, sf), TAXONOMY)


def corpus(spark: SparkSession, sf: str, *, with_tags: bool = False) -> Corpus:
    return Corpus(
        documents=documents(spark, sf),
        sources=sources(spark),
        tags=tags(spark, sf) if with_tags else None,
        enrichments=enrichments(spark, sf),
    )
