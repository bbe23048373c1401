"""Explicit schemas: stored tables, landed records and the canonical document."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _I, _B, _TS = (
    T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.TimestampType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


# Stored tables -------------------------------------------------------------------------------
SOURCES = _struct(id=_L, platform=_S, external_id=_S, name=_S, metadata_json=_S, created_at=_TS)

# `raw_json` keeps the whole payload; the fields queries filter on are columns of their own.
DOCUMENTS = _struct(
    id=_L, source_id=_L, external_id=_S, title=_S, body=_S, author=_S, url=_S,
    published_at=_TS, created_at=_TS, raw_json=_S, dedupe_key=_S,
    subreddit=_S, community_or_channel=_S, rating=_L, entity_type=_S,
    # Publication time, or the time of storage, in microseconds since 1970. Files are sorted by it, see
    # filters.layout_predicates; a number has statistics in the files whatever way the session writes timestamps.
    event_micros=_L,
    event_month=_S,  # partition folder, see filters.layout_predicates
)

DOCUMENT_TAGS = _struct(
    document_id=_L, tag_type=_S, tag_value=_S, tag_source=_S, confidence=_D, created_at=_TS,
)

ENRICHMENTS = _struct(
    document_id=_L, model_name=_S, summary=_S, sentiment_score=_D, metadata_json=_S,
    sentiment_label=_S, primary_issue_category=_S, feature_request_flag=_B,
    competitor_mentions=T.ArrayType(_S), rating=_L, created_at=_TS,
)

# Ledgers are append-only events; the current state of a run is its latest event.
INGESTION_EVENTS = _struct(
    run_id=_S, event_seq=_L, source_name=_S, started_at=_TS, completed_at=_TS, status=_S,
    records_fetched=_L, records_inserted=_L, error_message=_S,
)
ENRICHMENT_EVENTS = _struct(
    run_id=_S, event_seq=_L, started_at=_TS, completed_at=_TS, status=_S,
    candidates=_L, enriched=_L, skipped_short=_L, failed_batches=_L, error_message=_S,
)

SNAPSHOTS = _struct(
    snapshot_id=_S, module=_S, summary=_S, created_by=_S, cache_key=_S, filters_json=_S,
    payload=_S, created_at=_TS,
)

# Landed records ------------------------------------------------------------------------------
SUBMISSION = _struct(
    id=_S, title=_S, selftext=_S, subreddit=_S, author=_S, created_utc=_D,
    permalink=_S, full_link=_S, url=_S,
)
COMMENT = _struct(
    id=_S, body=_S, link_id=_S, subreddit=_S, author=_struct(name=_S), created_utc=_D, permalink=_S,
)
REVIEW = _struct(
    app_id=_S, reviewId=_S, userName=_S, authorName=_S, content=_S, userContent=_S, score=_I,
    at=_TS, timestamp=_S, reviewCreatedVersion=_S, appVersion=_S, device=_S, osVersion=_S,
    thumbsUpCount=_L, replyContent=_S, repliedAt=_TS,
)
PAGE = _struct(page_id=_L, url=_S, html=_S)

_LINK = _struct(_href=_S, _rel=_S)
ATOM_ENTRY = _struct(
    id=_S, title=_S, updated=_S, published=_S, author=_struct(name=_S),
    category=T.ArrayType(_struct(_term=_S)),
    content=_struct(_VALUE=_S), summary=_struct(_VALUE=_S), link=T.ArrayType(_LINK),
)
RSS_ITEM = _struct(
    guid=_struct(_VALUE=_S), link=_S, title=_S, description=_S, author=_S, pubDate=_S,
    category=T.ArrayType(_S),
)

# Canonical document: what every normaliser returns ---------------------------------------------
CANONICAL_DOC = _struct(
    source=_S, platform=_S, external_id=_S, parent_external_id=_S, doc_type=_S, entity_type=_S,
    community_or_channel=_S, platform_metadata=T.MapType(_S, _S), author=_S, rating=_L, title=_S,
    content=_S, created_at=_TS, url=_S, dedupe_key=_S, raw_payload=_S,
)
