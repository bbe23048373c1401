"""Insert-or-ignore against a store, on two keys.

Copies are taken out before each anti join, so that no join key is hot on the incoming side, and rows
without a key are dealt by their row id instead of meeting in the one task of the NULL key.
"""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from voxlake.operators.ranking import keep_first


def not_in(rows: DataFrame, stored: DataFrame, keys: Sequence[str], *, row_id: str | None = None) -> DataFrame:
    """Rows whose key is not stored yet; a NULL key is never equal to another."""
    known = stored.dropna(subset=list(keys)).select(_key(keys).alias("_key"))
    if row_id is None:
        own = _key(keys)
    else:
        complete = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
        own = F.when(complete, _key(keys)).otherwise(F.concat(F.lit("row "), F.xxhash64(row_id).cast("string")))
    return rows.withColumn("_key", own).join(known, "_key", "left_anti").select(*rows.columns)


def _key(keys: Sequence[str]) -> Column:
    """The values of complete keys as one text."""
    return F.to_json(F.array(*(F.col(k).cast("string") for k in keys)))


def stored_hits(incoming: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored rows (key columns alone) that have one of the incoming keys, each key once.

    Where the incoming keys are few the optimizer broadcasts them, and the stored side is only read through.
    """
    asked = incoming.dropna(subset=list(keys)).select(*keys).distinct()
    return stored.dropna(subset=list(keys)).select(*keys).join(asked, list(keys), "left_semi").distinct()


def new_documents(incoming: DataFrame, stored: DataFrame, order: Sequence[Column], *, row_id: str) -> DataFrame:
    """Incoming rows that an insert-or-ignore in the given order would add.

    First per dedupe key, then the store's dedupe keys, then first per (source, external id), then
    the store's pairs. The order matters: a row turned away for its dedupe key must not use up its
    (source, external id).
    """
    pair = ["source_id", "external_id"]
    rows = keep_first(incoming, ["dedupe_key"], order, row_id=row_id)
    rows = not_in(rows, stored, ["dedupe_key"], row_id=row_id)
    rows = keep_first(rows, pair, order, row_id=row_id)
    return not_in(rows, stored, pair, row_id=row_id)
