"""Incremental ingestion: new files of a landing folder, one insert-or-ignore per micro-batch.

Records that have come before are dropped by the stream's state (`arrivals.first_arrivals`), where a delay is given. What is
left meets the store by its key filters, so a batch looks for its keys only among documents that may have them, and
goes into documents, tags, filters and text index as one all-or-nothing insert. A replayed batch changes nothing,
since every known document is ignored on insert. Lines that cannot be parsed are no documents; they are kept with
their file under `rejected/` in the store.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from voxlake.operators.store import cut_lineage, ensure_source, insert_documents, maintain, rejected_path, staging
from voxlake.operators.tagging import Taxonomy
from voxlake.session import shared_dir
from voxlake.sources import landing
from voxlake.sources.tables import Store
from voxlake.streaming.arrivals import first_arrivals, numbered


def ingest_new_files(store: Store, platform: str, path: str, schema: T.StructType,
                     normalize: Callable[..., DataFrame], *, clock: Callable[[], datetime], name: str,
                     file_format: str = "json", taxonomy: Taxonomy | None = None, index_path: str | None = None,
                     identity: tuple[str, ...] = ("id",), delay: str | None = None, merge_every: int = 0,
                     max_files: int = 1000) -> StreamingQuery:
    """Take in every file that arrived since the last call, then stop.

    `normalize` turns landed records into canonical documents and passes `keep` columns through. With a `delay` (as "7
    days"), records whose `identity` came in an earlier batch within it are dropped by state; give all columns that the
    document's keys are made of. Every `merge_every` batches parts of filters and index are merged.
    """
    spark = store.spark
    broken = landing.BROKEN
    source_id = ensure_source(store, platform, now=clock())
    records = (
        spark.readStream.format(file_format)
        .schema(T.StructType([*schema.fields, T.StructField(broken, T.StringType())]))
        .option("columnNameOfCorruptRecord", broken)
        .option("maxFilesPerTrigger", max_files)
        .load(path)
        .select(
            "*",
            F.col("_metadata.file_modification_time").alias("_time"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
        )
    )
    records = numbered(records, "_row")
    if delay is not None:
        records = first_arrivals(records, identity, "_time", delay)

    def insert(batch: DataFrame, number: int) -> None:
        with staging(spark):
            take_in(batch)
        if merge_every and number % merge_every == merge_every - 1:
            maintain(store, index_path)

    def take_in(batch: DataFrame) -> None:
        arrival = F.struct("_time", "_file", "_start", "_row")
        rows = cut_lineage(batch.withColumn("arrival", arrival).drop("_time", "_file", "_start", "_row"))
        if rows.isEmpty():  # as when only the watermark moves on
            return
        rejected = rows.where(landing.is_broken(F.col(broken))).select(F.col("arrival._file").alias("file"), F.col(broken).alias("line"))
        if not rejected.isEmpty():
            rejected.write.mode("append").parquet(rejected_path(store, name))
        landed = rows.where(~landing.is_broken(F.col(broken))).drop(broken)
        docs = cut_lineage(normalize(landed, keep=("arrival",)))
        insert_documents(store, docs, source_id, now=clock(), taxonomy=taxonomy, index_path=index_path)

    return (
        records.writeStream.queryName(name)
        .foreachBatch(insert)
        .option("checkpointLocation", f"{shared_dir(spark)}/streams/{name}")
        .trigger(availableNow=True)
        .start()
    )
