"""Filtered search, browsing and lookups over the stored documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from voxlake.operators import fulltext, topk
from voxlake.operators.filters import (
    Corpus, DateMode, Filters, apply_column_filters, apply_semi_joins,
)
from voxlake.operators.ranking import narrow

# A longer list costs more in the plan than it saves in the scan.
IDS_FOR_THE_SCAN = 1000


def search_documents(corpus: Corpus, query: str | fulltext.Match, filters: Mapping[str, Any] | None = None, *,
                     limit: int = 20, offset: int = 0, after: fulltext.Place | None = None,
                     index: fulltext.Index | None = None, tiers_path: str | None = None) -> DataFrame:
    """One page of ranked search; without any word in the query, the latest documents.

    `tiers_path` names the folder of a written index: a query of words then reads only the postings that can reach the page
    (`operators/topk.py`); give `index` with it for phrases, prefixes and column scopes.

    `after` (see `fulltext.place_of`) goes on behind the last row of an earlier page; for deep pages it costs less than an
    offset, for which all rows before it are sorted.

    Column filters reach the scan; scoring follows where the texts lie; joins and ranking then handle
    ids, times and scores only.
    """
    match = query if isinstance(query, fulltext.Match) else fulltext.match_all(query or "")
    chosen = Filters.of(filters)
    found = apply_column_filters(corpus.documents, chosen, DateMode.STRICT_INSTANT)
    slim = narrow(found, "id", "source_id", "published_at", "created_at")
    if not match.units:
        scored = fulltext.unscored(found.select(*slim))
    elif tiers_path is not None and topk.supports(match):
        impacts = topk.read_impacts(corpus.documents.sparkSession, tiers_path, match)
        best = topk.best_rows(impacts, match, max(1, limit) + max(0, offset), lambda scores: apply_semi_joins(
            found.select(*slim).join(scores, "id"), corpus, chosen), after)
        return fulltext.ranked_page(best, corpus.documents, limit, offset, after)
    elif index is None:
        scored = fulltext.score_texts(corpus.documents, found, match).select(*slim, "fts_score")
    else:
        scored = found.select(*slim).join(fulltext.score_index(index, match), "id")
    return fulltext.ranked_page(apply_semi_joins(scored, corpus, chosen), corpus.documents, limit, offset, after)


def documents_by_ids(documents: DataFrame, ids: Sequence[int]) -> DataFrame:
    """The named documents in the order asked for, each once; unknown ids drop out.

    Up to IDS_FOR_THE_SCAN ids also go to the scan, which opens only row groups that may hold one.
    """
    places = {int(i): n for n, i in enumerate(dict.fromkeys(ids))}
    wanted = documents.sparkSession.createDataFrame(list(places.items()), "id long, position long")
    if 0 < len(places) <= IDS_FOR_THE_SCAN:
        documents = documents.where(F.col("id").isin(*places))
    return documents_by_positions(documents, wanted)


def documents_by_positions(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same for a table of (id, position), of any size."""
    first = wanted.groupBy("id").agg(F.min("position").alias("position"))
    return documents.join(first, "id").orderBy("position")


def result_table(rows: DataFrame) -> DataFrame:
    """Result page as shown and exported."""
    return rows.select(
        "id", "published_at", "title", "author", F.col("url").alias("source_url"),
        F.col("fts_score").alias("score"),
    )
