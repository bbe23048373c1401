"""Insight snapshots: saved report payloads, reused while they are fresh."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, Row, functions as F

from voxlake import constants as K
from voxlake.operators.filters import Filters
from voxlake.plans import insights
from voxlake.sources.tables import Store

_CONTROL_KEYS = ("refresh_cache", "cache_ttl_minutes")


def report_filters(raw: Mapping[str, Any] | None) -> dict[str, Any]:
    """Filters without the keys that steer snapshot reuse."""
    return {k: v for k, v in (raw or {}).items() if k not in _CONTROL_KEYS}


def cache_key(module: str, raw: Mapping[str, Any] | None) -> str:
    text = json.dumps(
        {"module": module, "filters": report_filters(raw)}, sort_keys=True, separators=(",", ":")
    )
    return hashlib.sha256(text.encode()).hexdigest()


def valid_after(now: datetime, raw: Mapping[str, Any] | None) -> datetime:
    minutes = int((raw or {}).get("cache_ttl_minutes") or K.SNAPSHOT_TTL_MINUTES)
    return (now - timedelta(minutes=max(1, minutes))).replace(microsecond=0)


def latest_valid(snapshots: DataFrame, oldest: Any, *, by: tuple[str, ...] = ("module", "cache_key"),
                 last: str = "snapshot_id") -> DataFrame:
    """The newest snapshot not older than `oldest`, for each module and filter key."""
    others = [c for c in snapshots.columns if c not in by]
    newest = F.max_by(F.struct(*others), F.struct("created_at", last))
    return (
        snapshots.where(F.col("created_at") >= F.lit(oldest)).groupBy(*by).agg(newest.alias("s")).select(*by, "s.*")
    )


def _plain(rows: list[Row]) -> list[dict[str, Any]]:
    return [
        {k: v.isoformat() if hasattr(v, "isoformat") else v for k, v in r.asDict().items()} for r in rows
    ]


def compute_payload(store: Store, module: str, raw: Mapping[str, Any] | None) -> dict[str, Any]:
    """Summary, metrics and evidence of one report. Every part is a fixed-size report."""
    parts = insights.INSIGHTS[module](store.corpus(), Filters.of(raw))
    summary = parts.pop("summary").first()["summary"]
    evidence = _plain(parts.pop("evidence").collect())
    totals = parts.pop("totals").first().asDict()
    if module == "sentiment":
        metrics = {
            "total_docs": totals["total_docs"],
            "sentiment_distribution": {n: totals[f"{n}_count"] for n in K.SENTIMENT_LABELS},
        }
    else:
        metrics = dict(totals)
    metrics |= {name: _plain(part.collect()) for name, part in parts.items()}
    return {"summary": summary, "metrics": metrics, "evidence": evidence}


def insight(store: Store, module: str, raw: Mapping[str, Any] | None = None, *, now: datetime) -> dict[str, Any]:
    """The report, from a fresh snapshot if there is one, else computed and saved."""
    key = cache_key(module, raw)
    if not (raw or {}).get("refresh_cache"):
        own = store.read("saved_insights").where((F.col("module") == module) & (F.col("cache_key") == key))
        hit = latest_valid(own, valid_after(now, raw)).first()
        if hit is not None:
            return json.loads(hit["payload"])
    payload = compute_payload(store, module, raw)
    row = (
        uuid.uuid1().hex, module, payload["summary"], "analysis_service", key,
        json.dumps(report_filters(raw)), json.dumps(payload), now,
    )
    schema = "snapshot_id string, module string, summary string, created_by string, cache_key string, filters_json string, payload string, created_at timestamp"
    store.append("saved_insights", store.spark.createDataFrame([row], schema))
    return payload


def rebuild(store: Store, raw: Mapping[str, Any] | None = None, *, now: datetime) -> dict[str, dict[str, Any]]:
    """All three reports anew."""
    forced = {**(raw or {}), "refresh_cache": True}
    return {module: insight(store, module, forced, now=now) for module in K.INSIGHT_MODULES}
