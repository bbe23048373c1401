"""First arrivals of a stream: rows that have come in an earlier micro-batch are dropped by state.

The state holds the identities that came within a delay behind the watermark, by buckets of their hash: one state
value serves many identities, and a batch touches each bucket once. An identity that is equal in all its parts to an
earlier one can never be new to an insert-or-ignore, so dropping it changes nothing; all others go on, those of the
same batch included, whose order the insert knows. What comes back after the delay passes as well and is met by the
insert's own look-up. Rows without any identity always pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BUCKETS = 128
STATE = "identities array<string>, times array<long>"


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Adds each row's number within its task, in the order in which the task reads; streams have no other row number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = 0
        for batch in batches:
            yield batch.append_column(name, pa.array(range(start, start + batch.num_rows), pa.int64()))
            start += batch.num_rows

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())]))


def first_arrivals(rows: DataFrame, identity: Sequence[str], time: str, delay: str, *, buckets: int = BUCKETS) -> DataFrame:
    """Rows of a stream whose identity (the texts of some columns) has not come in an earlier batch within the delay."""
    present = F.lit(False)
    for c in identity:
        present = present | F.col(c).isNotNull()
    text = F.when(present, F.to_json(F.array(*(F.col(c).cast("string") for c in identity)), {"ignoreNullFields": "false"}))
    # rows without identity are dealt over the buckets by all they hold
    dealt = rows.withWatermark(time, delay).withColumn("_identity", text).withColumn(
        "_bucket", F.pmod(F.xxhash64(F.coalesce("_identity", F.to_json(F.struct(*rows.columns)))), F.lit(buckets)).cast("int"))
    columns = rows.columns

    def fresh(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = dict(zip(*state.get)) if state.exists else {}
        limit = state.getCurrentWatermarkMs()
        known = {i: t for i, t in old.items() if t >= limit}
        came: dict[str, int] = {}
        for batch in batches:
            own = batch["_identity"]
            for i, t in zip(own, batch["_ms"]):
                if i is not None:
                    came[i] = max(int(t), came.get(i, 0))
            out = batch.loc[~own.isin(known.keys()) | own.isna(), columns]
            if len(out):
                yield out
        for i, t in came.items():
            known[i] = max(t, known.get(i, 0))
        if known:
            state.update((list(known), list(known.values())))
            state.setTimeoutTimestamp(max(limit, max(known.values())) + 1)
        elif state.exists:
            state.remove()

    return dealt.withColumn("_ms", F.unix_millis(time)).groupBy("_bucket").applyInPandasWithState(
        fresh, rows.schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
