"""Top-n and first-of-group operators that survive hot groups.

Both use `row_number` with a bound right on top of it, which Spark turns into a per-task limit in
front of the shuffle (WindowGroupLimit): a group that holds a third of all rows sends at most n rows
per map task. `top_n_per_group` first takes the n of all tasks with one salt, so that what the tasks
send of a hot group is sorted in several places; a task has one salt, and sends n rows at most.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 32


def _first_n(df: DataFrame, keys: Sequence[Column], order: Sequence[Column], n: int, name: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | None, *,
                    rank: str | None = None) -> DataFrame:
    """The first n rows of each group (None: all rows); `rank` keeps the position under that name."""
    groups = [F.col(k) for k in keys]
    if n is None:
        return df if rank is None else df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS))
    partial = _first_n(df.withColumn("_salt", salt), [*groups, F.col("_salt")], order, n, "_rank")
    name = rank or "_rank"
    full = _first_n(partial.drop("_salt", "_rank"), groups, order, n, name)
    return full if rank else full.drop("_rank")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], *,
               row_id: str | None = None) -> DataFrame:
    """The first row of each key in the given order.

    With a unique `row_id`, rows with a NULL key all stay. Leave it out where keys are never NULL.
    """
    groups = [F.col(k) for k in keys]
    if row_id is not None:
        incomplete = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
        groups += [F.when(incomplete, F.col(row_id))]
    return _first_n(df, groups, order, 1, "_rank").drop("_rank")


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered result."""
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset > 0 else ordered).limit(limit)


def beyond(order: Sequence[tuple[Column, bool]], last: Sequence[Any]) -> Column:
    """Whether a row comes after a given one, by its values of the order's columns (column, falling); NULLs come first in
    rising columns and last in falling ones. The last column must tell rows apart."""
    out = F.lit(False)
    for (column, falling), value in reversed(list(zip(order, last, strict=True))):
        own = F.lit(value)
        if falling:
            after = column.isNull() | (column < own) if value is not None else F.lit(False)
        else:
            after = column > own if value is not None else column.isNotNull()
        out = F.coalesce(after, F.lit(False)) | (column.eqNullSafe(own) & out)
    return out


def add_columns(top: DataFrame, documents: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Wide columns for the few rows of a finished report, by document id.

    Reports rank narrow rows first, so that texts never travel through their joins. How `top` gets
    to the documents is left to the optimizer, as the caller's limit decides on its size.
    """
    keys = [k for k in ("id", "event_month") if k in top.columns and k in documents.columns]
    return documents.select(*keys, *columns).join(top, keys)


def narrow(df: DataFrame, *columns: str) -> list[str]:
    """The given columns and the partition column, where there is one."""
    return [*columns, *[c for c in ("event_month",) if c in df.columns]]
