"""Times the headline queries and prints one JSON line.

The driver's tables are files of one split, which one core reads; before the clock starts they are copied into
as many files as there are cores, as larger tables are.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS
(default 3; the median counts, after one warm-up), BENCH_QUERIES (comma-separated names, or `all`).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from voxlake.session import local_session  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "sentiment_totals", "sentiment_daily_trend", "complaint_categories", "top_features",
    "evidence_negative", "insight_summaries", "dashboard_kpis", "volume_by_day", "sentiment_split",
    "ranked_complaints", "facets", "filter_tags", "filter_sentiment", "browse_page", "fetch_by_ids",
    "search_all", "search_any", "search_phrase", "search_filtered_page", "search_indexed",
    "answer_evidence", "tag_all", "rule_enrichment", "scored_by_plugin", "classifier_reply_clean",
    "dedupe_fallback_key", "dedupe_first_wins", "dedupe_against_store", "url_forms",
    "extract_articles", "link_order", "post_docs_union", "review_ingest_capped",
    "query_grid_diagnostics", "atom_entries", "run_metrics", "snapshot_latest_valid", "clean_text",
)


def run_once(spark, sf: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def with_splits(spark, sf: str, cpus: int, folder: str) -> str:
    """A copy of the tables of sf that every core has a part of."""
    copy = f"{folder}/{Path(sf).name}"
    for table in Path(sf).glob("*.parquet"):
        spark.read.parquet(str(table)).repartition(cpus).write.parquet(f"{copy}/{table.name}")
    return copy


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = local_session("bench", cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    folder = tempfile.TemporaryDirectory(prefix="bench-")
    tables = with_splits(spark, sf, int(cpus) if cpus.isdigit() else 8, folder.name)
    seconds = {}
    for name in names:
        run_once(spark, tables, name)
        seconds[name] = round(statistics.median(run_once(spark, tables, name) for _ in range(runs)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "feedback_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf.rsplit("sf", 1)[-1],
    }))
    spark.stop()
    folder.cleanup()


if __name__ == "__main__":
    main()
