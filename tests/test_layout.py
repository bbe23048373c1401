"""Stored documents: what a filter leaves in the files unread."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from voxlake.operators.filters import Corpus, DateMode, Filters, apply_column_filters
from voxlake.plans.explore import documents_by_ids

START = datetime(2024, 3, 1, tzinfo=timezone.utc)
ROWS = 200_000


@pytest.fixture
def documents(spark, store):
    """Even ids over one month in no order of time; every fifth has no publication time and was stored at its end."""
    n = F.col("n")
    at = F.timestamp_seconds(F.lit(int(START.timestamp())) + F.pmod(n * 7919, F.lit(ROWS)) * 12)
    rows = spark.range(ROWS).withColumnRenamed("id", "n").select(
        (n * 2).alias("id"), F.lit(1).cast("long").alias("source_id"), F.concat(F.lit("text "), n.cast("string")).alias("body"),
        F.when(n % 5 != 0, at).alias("published_at"), F.lit(START + timedelta(days=27, hours=5)).alias("created_at"))
    store.append("documents", rows)
    return store.read("documents")


def scanned(df):
    """Rows that come out of the files, and of the filter above them."""
    df = df.select("id", "body")
    query = df._jdf.queryExecution()
    kept = query.toRdd().count()
    scan = query.executedPlan().collectLeaves().head()
    return scan.metrics().apply("numOutputRows").value(), kept


@pytest.mark.parametrize("mode", list(DateMode))
def test_a_day_reads_a_part_of_its_month(documents, mode):
    filters = Filters.of({"date_from": "2024-03-10", "date_to": "2024-03-11"})
    found = apply_column_filters(documents, filters, mode)
    plain = apply_column_filters(documents.drop("event_micros", "event_month"), filters, mode)
    rows, kept = scanned(found)
    assert kept == plain.count() > 4000
    assert rows < ROWS / 3


def test_edges_of_days_and_odd_dates(documents):
    for raw in ({"date_from": "2024-03-28T04:00:00"}, {"date_to": "2024-03-01T23:59:59Z"}, {"date_from": "2024-03-28", "date_to": "2024-03-28"},
                {"date_from": "no date"}, {"date_to": "2024-02-30"}, {"date_from": "2024-03-11T22:00:00-05:00", "date_to": "2024-03-12"}):
        for mode in DateMode:
            filters = Filters.of(raw)
            found = apply_column_filters(documents, filters, mode).agg(F.count("*"), F.sum("id")).first()
            plain = apply_column_filters(documents.drop("event_micros", "event_month"), filters, mode).agg(F.count("*"), F.sum("id")).first()
            assert found == plain, (raw, mode)


def test_rows_without_stored_time_stay_in(documents):
    older = documents.withColumn("event_micros", F.when(F.col("id") % 4 == 0, F.col("event_micros")))
    filters = Filters.of({"date_from": "2024-03-10", "date_to": "2024-03-11"})
    for mode in DateMode:
        assert apply_column_filters(older, filters, mode).count() == apply_column_filters(documents, filters, mode).count()


def test_ids_that_no_row_group_holds_are_not_read(spark, documents):
    # Odd ids lie between stored ones: only the filters of the row groups can tell.
    assert scanned(documents.where(F.col("id").isin(70001, 130003))) == (0, 0)
    asked = [130_002, 70_001, 8, 130_002, 399_998]
    assert [(r.id, r.position, r.body) for r in documents_by_ids(documents, asked).collect()] == [
        (130_002, 0, "text 65001"), (8, 2, "text 4"), (399_998, 3, "text 199999")]
    assert documents_by_ids(documents, []).count() == 0
    assert documents_by_ids(documents, range(3000)).count() == 1500
