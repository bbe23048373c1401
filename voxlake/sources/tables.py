"""Stored tables: Parquet folders with fixed schemas under one root."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from voxlake import schemas
from voxlake.functions.dates import event_time, utc_text
from voxlake.operators.filters import Corpus

TABLES = {
    "sources": schemas.SOURCES,
    "documents": schemas.DOCUMENTS,
    "document_tags": schemas.DOCUMENT_TAGS,
    "enrichments": schemas.ENRICHMENTS,
    "ingestion_runs": schemas.INGESTION_EVENTS,
    "enrichment_runs": schemas.ENRICHMENT_EVENTS,
    "saved_insights": schemas.SNAPSHOTS,
}
# Event month of a document; date filters on the event time prune these folders.
PARTITION_COLUMNS = {"documents": ["event_month"]}
# Order within a file: row groups then hold short ranges of times, which their statistics show.
SORT_COLUMNS = {"documents": ["event_micros", "id"]}
# Look-ups by id are not helped by that order; a filter of the ids of each row group is.
FILTER_COLUMNS = {"documents": ["id"]}
# A file of texts has several row groups, so that a few days of its month are a part of it.
ROW_GROUP_BYTES = 16 * 1024 * 1024


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet folder, or no rows while nothing has been written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class Store:
    """The tables of one feedback store."""

    spark: SparkSession
    root: str

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def read(self, table: str) -> DataFrame:
        return read_or_empty(self.spark, self.path(table), TABLES[table])

    def write(self, table: str, rows: DataFrame, path: str) -> None:
        """Add rows to a folder, in the table's own column order and types; missing columns become NULL."""
        if table == "documents":
            at = event_time()
            rows = rows.withColumns({"event_micros": F.unix_micros(at), "event_month": utc_text(at).substr(1, 7)})
        shaped = rows.select(
            *[
                (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in TABLES[table].fields
            ]
        )
        folders = PARTITION_COLUMNS.get(table, [])
        if folders:  # a few even files for each folder, whichever tasks have its rows
            shaped = shaped.hint("rebalance", *folders)
        if order := SORT_COLUMNS.get(table):
            shaped = shaped.sortWithinPartitions(*folders, *order)
        writer = shaped.write.mode("append").partitionBy(*folders)
        if order:  # a filter is as large as its row group needs
            writer = writer.options(**{"parquet.block.size": ROW_GROUP_BYTES, "parquet.bloom.filter.adaptive.enabled": "true"})
        for column in FILTER_COLUMNS.get(table, []):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(path)

    def append(self, table: str, rows: DataFrame) -> None:
        self.write(table, rows, self.path(table))

    def corpus(self) -> Corpus:
        return Corpus(
            documents=self.read("documents"),
            sources=self.read("sources"),
            tags=self.read("document_tags"),
            enrichments=self.read("enrichments"),
        )


def export_csv(df: DataFrame, path: str) -> None:
    """Result page as CSV with a header and without row numbers."""
    df.write.mode("overwrite").option("header", True).csv(path)
