"""Daily counts that inserts and enrichments add to, part by part; `plans/rollups.py` reports from them.

A row counts documents (or enriched documents, or requests of a feature) of one day by all columns that reports
filter or group on. Parts lie under a manifest like those of the text index and are merged by tiers.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxlake.functions.dates import event_day, event_time, utc_wall
from voxlake.operators.filters import issue_category
from voxlake.operators.fulltext import FAN, manifest, merge_tiers, new_part

DIMENSIONS = ["kind", "day", "at_midnight", "source_id", "subreddit", "community_or_channel", "rating", "sentiment_label",
              "category", "feature_request", "feature"]
SCHEMA = ("kind string, day date, at_midnight boolean, source_id long, subreddit string, community_or_channel string, rating long, "
          "sentiment_label string, category string, feature_request boolean, feature string, n long")
DOCUMENT, ENRICHED, FEATURE = "document", "enriched", "feature"


def _counted(rows: DataFrame, kind: str, **values: Column) -> DataFrame:
    text, flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    own = {"kind": F.lit(kind), "day": event_day(), "at_midnight": utc_wall(event_time()) == F.date_trunc("day", utc_wall(event_time())),
           "sentiment_label": text, "category": text, "feature_request": flag, "feature": text} | values
    return rows.select(*(own[d].alias(d) if d in own else d for d in DIMENSIONS)).groupBy(*DIMENSIONS).agg(F.count("*").alias("n"))


def of_documents(documents: DataFrame) -> DataFrame:
    """Rollup rows of new documents."""
    return _counted(documents, DOCUMENT)


def of_enrichments(documents: DataFrame, enrichments: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Rollup rows of new enrichments: by label, category and flag, and the features of flagged documents."""
    found = enrichments.select(F.col("document_id").alias("id"), "sentiment_label", issue_category().alias("category"),
                               F.coalesce("feature_request_flag", F.lit(False)).alias("feature_request"))
    narrow = documents.select("id", "source_id", "published_at", "created_at", "subreddit", "community_or_channel", "rating")
    rows = narrow.join(found, "id")
    labels = {c: F.col(c) for c in ("sentiment_label", "category", "feature_request")}
    out = _counted(rows, ENRICHED, **labels)
    if tags is None:
        return out
    features = tags.where("tag_type = 'feature'").select(F.col("document_id").alias("id"), F.col("tag_value").alias("feature"))
    return out.unionByName(_counted(rows.where("feature_request").join(features, "id"), FEATURE, **labels, feature=F.col("feature")))


def stage_rollup(rows: DataFrame, path: str, part: str) -> dict[str, Any]:
    """Writes a part that no manifest names yet; its entry for one."""
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/rows/of={part}")
    return {"part": part, "n_docs": rows.sparkSession.read.schema(SCHEMA).parquet(f"{path}/rows/of={part}").count()}


def read_rollup(spark: SparkSession, path: str, parts: list[dict[str, Any]] | None = None) -> DataFrame:
    own = manifest(spark, path)["parts"] if parts is None else parts
    if not own:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(*(f"{path}/rows/of={p['part']}" for p in own))


def merge_rollups(spark: SparkSession, path: str, *, fan: int = FAN) -> list[list[str]]:
    """Merges parts by tiers of their rows; rows of equal dimensions become one."""
    def merged(full: list[dict[str, Any]]) -> dict[str, Any]:
        rows = read_rollup(spark, path, full).groupBy(*DIMENSIONS).agg(F.sum("n").alias("n"))
        # of at least the sources' size for its tier, so that merges come to an end
        return stage_rollup(rows, path, new_part()) | {"n_docs": sum(p["n_docs"] for p in full)}

    return merge_tiers(spark, path, merged, fan=fan)
