"""Writes to the feedback store: insert-or-ignore, document ids, ledgers.

An insert is all or nothing. Its documents, tags, key filter, daily counts and index part are first written where no reader looks; one small file,
`ready.json`, then decides that it counts. From there its files are moved into the tables and its part is named in the
index's manifest, which may be broken off anywhere: the next insert (or `complete_inserts`) takes up what is left. An
insert that broke off before leaves nothing behind but a folder that the next one removes. Enrichments are stored the same
way, with a claim of their own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar
from datetime import datetime
from itertools import accumulate
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxlake.operators import keyfilter, rollup
from voxlake.operators.dedupe import new_documents, not_in, stored_hits
from voxlake.operators.fulltext import build_index, commit_parts, merge_index, new_part, stage_part
from voxlake.operators.normalize import stored_columns
from voxlake.operators.tagging import Taxonomy, tag_documents
from voxlake.session import shared_dir
from voxlake.sources import files
from voxlake.sources.tables import Store

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row below


_staged: ContextVar[list[str] | None] = ContextVar("staged", default=None)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Removes the copies that `cut_lineage` makes in this block when the block ends."""
    if _staged.get() is not None:  # the outermost block removes
        yield
        return
    token = _staged.set([])
    try:
        yield
    finally:
        paths = _staged.get() or []
        _staged.reset(token)
        for path in paths:
            files.delete(spark, path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Written to the cluster's shared folder and read back: made once, kept if executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/voxlake-stage/{uuid.uuid4().hex}"
    if (own := _staged.get()) is not None:
        own.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def only_writer(store: Store, name: str = "_writer") -> Iterator[None]:
    """Document ids count on from the highest one, so one writer works on a store at a time.

    The claim is a file that can be made once. A run that was killed leaves it; remove it by hand then.
    """
    claim = f"{store.root.rstrip('/')}/{name}"
    if not files.claim(store.spark, claim):
        raise RuntimeError(f"another writer is at work on this store, or was killed: {claim} exists")
    try:
        yield
    finally:
        files.delete(store.spark, claim)


def ensure_source(store: Store, platform: str, *, now: datetime) -> int:
    """Id of the platform's source row, added where it is missing; its name is the platform key."""
    own = (F.col("platform") == platform) & (F.col("external_id") == platform)
    found = store.read("sources").where(own).agg(F.min("id")).first()[0]
    if found is not None:
        return found
    with only_writer(store):  # two refreshes must not give one id twice
        sources = store.read("sources")
        found = sources.where(own).agg(F.min("id")).first()[0]
        if found is not None:
            return found
        next_id = (sources.agg(F.max("id")).first()[0] or 0) + 1
        row = [(next_id, platform, platform, platform, "{}", now)]
        schema = "id long, platform string, external_id string, name string, metadata_json string, created_at timestamp"
        store.append("sources", store.spark.createDataFrame(row, schema))
        return next_id


def number_rows(rows: DataFrame, order: str, start: int) -> tuple[DataFrame, int]:
    """Consecutive ids from `start` in the given order, and how many were given.

    Rows are range-sorted once and keep their place in their partition; only one count per partition
    goes to the driver. There is no window over all rows.
    """
    place = F.monotonically_increasing_id()
    placed = cut_lineage(
        rows.orderBy(order).select(
            "*",
            F.shiftright(place, _ROW_BITS).cast("int").alias("_part"),
            place.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"),
        )
    )
    counts = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())
    offsets = [0, *accumulate(n for _, n in counts)]
    starts = rows.sparkSession.createDataFrame(
        [(part, start + offset) for (part, _), offset in zip(counts, offsets)], "_part int, _start long"
    )
    # One row per partition of the sort: small enough to broadcast whatever the table holds.
    numbered = placed.join(F.broadcast(starts), "_part").withColumn("id", F.col("_start") + F.col("_row"))
    return numbered.drop("_part", "_row", "_start"), offsets[-1]


def insert_documents(store: Store, docs: DataFrame, source_id: int, *, now: datetime,
                     taxonomy: Taxonomy | None = None, index_path: str | None = None) -> int:
    """Insert canonical documents, ignoring known ones; the first arrival wins. Tags them as well, and adds
    them to the text index at `index_path`; how many were new.

    Copies are found and ids given on keys alone; the texts are joined to their ids at the end, in
    one shuffle. That reads `docs` twice, so they should be cheap to read (see `cut_lineage`). A
    rerun after a failure completes what the failed run had decided, and inserts nothing twice.
    """
    with only_writer(store), staging(store.spark):
        _take_up(store)
        return _insert(store, docs, source_id, now, taxonomy, index_path)


def complete_inserts(store: Store) -> list[str]:
    """Completes the inserts and enrichments that broke off after their decision and removes the others; the names of
    the former."""
    with only_writer(store):
        done = _take_up(store)
    with only_writer(store, _ENRICHER):
        return done + _take_up(store, ENRICHMENTS)


INSERTS, ENRICHMENTS, _ENRICHER = "_inserts", "_enrichments", "_enricher"
_STAGED = ("documents", "document_tags", "enrichments")


def _area(store: Store, area: str) -> str:
    return f"{store.root.rstrip('/')}/{area}"


def _take_up(store: Store, area: str = INSERTS) -> list[str]:
    done = []
    for name in files.names(store.spark, _area(store, area)):
        if files.read_json(store.spark, f"{_area(store, area)}/{name}/ready.json") is not None:
            _publish(store, name, area)
            done.append(name)
        else:
            files.delete(store.spark, f"{_area(store, area)}/{name}")
    return done


PAIR = ("source_id", "external_id")
KEYS = (("dedupe_key",), PAIR)


def filter_path(store: Store) -> str:
    return f"{store.root.rstrip('/')}/key_filter"


def rejected_path(store: Store, name: str) -> str:
    """Where broken lines of a platform or stream are kept, as (file, line)."""
    return f"{store.root.rstrip('/')}/rejected/{name}"


def rollup_path(store: Store) -> str:
    return f"{store.root.rstrip('/')}/rollup"


def possibly_stored(store: Store, incoming: DataFrame, last: int) -> tuple[DataFrame, DataFrame]:
    """The incoming rows that may be stored, by the key filters, and the stored rows that may be theirs.

    Ids count from 1 to `last`; all incoming rows and all stored ones where documents have been written without filters.
    """
    spark, path = store.spark, filter_path(store)
    stored = store.read("documents")
    if sum(p["rows"] for p in keyfilter.manifest(spark, path)["parts"]) != last:
        return incoming, stored
    hashed = incoming.withColumn("_h", keyfilter.key_hashes(*KEYS))
    hits = cut_lineage(keyfilter.ask(spark, path, hashed.select(F.explode("_h").alias("h")).distinct()))
    # one name for each part: few, whatever they hold
    ranges = keyfilter.possible_ranges(spark, path, [r["part"] for r in hits.select("part").distinct().collect()])
    near = F.lit(False)
    for first, last in ranges:
        near = near | F.col("id").between(first, last)
    maybe = hashed.select(*incoming.columns, F.explode("_h").alias("_h")).join(
        hits.select(F.col("h").alias("_h")).distinct(), "_h", "left_semi").drop("_h").distinct()
    return maybe, stored.where(near)


def _known(store: Store, incoming: DataFrame, last: int) -> DataFrame:
    """Stored rows with a key of incoming ones, as (source_id, external_id, dedupe_key): what a new row must not equal."""
    if not last:
        return store.read("documents").select(*PAIR, "dedupe_key")
    maybe, stored = possibly_stored(store, incoming, last)
    maybe = cut_lineage(maybe.select("source_id", "external_id", "dedupe_key"))
    by_key = stored_hits(maybe, stored, ["dedupe_key"])
    by_pair = stored_hits(maybe, stored, list(PAIR))
    return by_pair.unionByName(by_key, allowMissingColumns=True)


def _insert(store: Store, docs: DataFrame, source_id: int, now: datetime, taxonomy: Taxonomy | None,
            index_path: str | None) -> int:
    incoming = stored_columns(docs, ingested_at=F.lit(now)).withColumn("source_id", F.lit(source_id).cast("long"))
    keys = incoming.select("arrival", *PAIR, "dedupe_key")
    last = store.read("documents").agg(F.max("id")).first()[0] or 0
    new = new_documents(keys, _known(store, keys.drop("arrival"), last), [F.asc("arrival")], row_id="arrival")
    numbered, inserted = number_rows(new.select("arrival"), "arrival", last + 1)
    if inserted:
        rows = incoming.join(numbered, "arrival").withColumn("created_at", F.lit(now))
        name = new_part()
        _stage(store, name, rows, (last + 1, last + inserted), now, taxonomy, index_path)
        _publish(store, name)
    return inserted


def _stage(store: Store, name: str, rows: DataFrame, ids: tuple[int, int], now: datetime, taxonomy: Taxonomy | None,
           index_path: str | None) -> None:
    """Writes all that an insert adds where no reader looks; `ready.json` comes last and decides."""
    folder = f"{_area(store, INSERTS)}/{name}"
    store.write("documents", rows, f"{folder}/documents")
    # what follows is made of the written rows, not once more of their sources
    written = store.spark.read.schema(store.read("documents").schema).parquet(f"{folder}/documents")
    own = written.select("id", "title", "body")
    hashes = written.select(F.explode(keyfilter.key_hashes(*KEYS)).alias("h"))
    keys = keyfilter.stage_filter(hashes, filter_path(store), name, *ids) | {"rows": ids[1] - ids[0] + 1}
    if taxonomy is not None:
        tags = tag_documents(own, taxonomy).dropDuplicates(_TAG_KEY).withColumn("created_at", F.lit(now))
        store.write("document_tags", tags, f"{folder}/document_tags")
    parts = [(filter_path(store), keys),
             (rollup_path(store), rollup.stage_rollup(rollup.of_documents(written), rollup_path(store), name))]
    if index_path is not None:
        parts.append((index_path, stage_part(build_index(own), index_path, name)))
    files.write_json(store.spark, f"{folder}/ready.json", {"parts": parts})


def insert_enrichments(store: Store, rows: DataFrame) -> None:
    """Stores enrichments and their daily counts, all or nothing. `rows` are read twice."""
    with only_writer(store, _ENRICHER):
        _take_up(store, ENRICHMENTS)
        name = new_part()
        folder = f"{_area(store, ENRICHMENTS)}/{name}"
        store.write("enrichments", rows, f"{folder}/enrichments")
        counts = rollup.of_enrichments(store.read("documents"), rows, store.read("document_tags"))
        part = rollup.stage_rollup(counts, rollup_path(store), name)
        files.write_json(store.spark, f"{folder}/ready.json", {"parts": [(rollup_path(store), part)]})
        _publish(store, name, ENRICHMENTS)


def _publish(store: Store, name: str, area: str = INSERTS) -> None:
    """Moves what is decided to where readers look; a rerun does what is left to do."""
    folder = f"{_area(store, area)}/{name}"
    ready = files.read_json(store.spark, f"{folder}/ready.json")
    for table in _STAGED:
        files.move_files(store.spark, f"{folder}/{table}", store.path(table))
    for path, part in ready["parts"]:
        commit_parts(store.spark, path, [part])
    files.delete(store.spark, folder)


def maintain(store: Store, index_path: str | None = None) -> list[list[str]]:
    """Merges parts of the key filters, daily counts and text index while no insert is at work; the index parts that were
    merged."""
    with only_writer(store):
        _take_up(store)
        rollup.merge_rollups(store.spark, rollup_path(store))
        keyfilter.merge_filters(store.spark, filter_path(store), store.read("documents"), KEYS)
        return [] if index_path is None else merge_index(store.spark, index_path)


_TAG_KEY = ["document_id", "tag_type", "tag_value"]


def insert_tags(store: Store, tags: DataFrame, *, now: datetime) -> None:
    """Tags are unique per document, type and value."""
    new = not_in(tags.dropDuplicates(_TAG_KEY), store.read("document_tags"), _TAG_KEY)
    store.append("document_tags", new.withColumn("created_at", F.lit(now)))


def retag(store: Store, taxonomy: Taxonomy, *, now: datetime) -> None:
    """Add missing tags of all stored documents, after a taxonomy change."""
    insert_tags(store, tag_documents(store.read("documents"), taxonomy), now=now)


# Ledgers -------------------------------------------------------------------------------------
def _append_event(store: Store, table: str, values: Mapping[str, Any]) -> None:
    schema = store.read(table).schema
    row = tuple(values.get(f.name) for f in schema.fields)
    store.append(table, store.spark.createDataFrame([row], schema))


def start_run(store: Store, table: str, *, now: datetime, **values: Any) -> str:
    """Time-ordered run id; the run is `running` until its completion event."""
    run_id = f"{now:%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    _append_event(store, table, {"run_id": run_id, "event_seq": 1, "started_at": now, "status": "running", **values})
    return run_id


def complete_run(store: Store, table: str, run_id: str, *, started: datetime, now: datetime, status: str,
                 diagnostics: Mapping[str, Any] | str | None = None, **values: Any) -> None:
    message = diagnostics if diagnostics is None or isinstance(diagnostics, str) else json.dumps(diagnostics, default=str)
    _append_event(
        store, table,
        {"run_id": run_id, "event_seq": 2, "started_at": started, "completed_at": now, "status": status,
         "error_message": message, **values},
    )
