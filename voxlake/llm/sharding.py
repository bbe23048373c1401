"""Shards of nearly equal bytes, by sampled splitters.

Rows are ordered by a hash of their text and their id, so equal texts are neighbours. A sample that takes a row with
a chance in proportion to its size gives quantiles of this key as splitters; they cut the rows into many fine ranges.
Ranges with too many rows (many equal texts, or more rows than MAX_RANGES ranges of RANGE_ROWS hold) are subdivided:
into even slices of their keys, and a slice with too many rows (equal texts) by row number. Exact totals of the ranges, one small row
each, and running totals within each range then give every row its place among all bytes, and the places at which
shards begin: each shard's bytes are within one row of an equal share.

Only ids, sizes and checksums are shuffled, never texts. Null texts are empty. Repeated rows are rows of their own;
null ids come first. Other columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.common import cut, whole

SHARDS, OVERHEAD = 40, 16
RANGE_ROWS, SAMPLE_ROWS = 50_000, 100_000
MAX_RANGES = 1024  # splitters stand in the plan, so their number must not grow with the rows; parts do


def _range_of(key: Column, splitters: list[int]) -> Column:
    """How many of the sorted splitters are at or below the key, by bisection."""
    if not splitters:
        return F.lit(0)
    at = F.array(*map(F.lit, splitters))
    steps = [1 << b for b in reversed(range(len(splitters).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, step: F.when(
        (n + step <= len(splitters)) & (F.get(at, n + step - 1) <= key), n + step).otherwise(n))


def shards(docs: DataFrame, n_shards: int = SHARDS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (from 0 in each shard) of each row."""
    text = whole(F.col("text"))
    rows = cut(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("row")))
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(8 * n_shards, min(MAX_RANGES, math.ceil(count / range_rows)))
    chance = F.pmod(F.xxhash64("row", F.lit("sample")), F.lit(1 << 40)) / (1 << 40)
    sample = rows.filter(chance * F.lit(max(total, 1)) < F.col("size") * SAMPLE_ROWS)
    found = sample.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
    # plus zero of a function that the optimizer takes for random: with broadcast joins it would else derive filters
    # from the bisection and put them where there is no key
    opaque = (F.monotonically_increasing_id() * 0).cast("int")
    dealt = cut(rows.withColumn("range", _range_of(F.col("key"), sorted(set(found or []))) + opaque))

    sizes = dealt.groupBy("range").agg(F.ceil(F.count("*") / range_rows).alias("slices"), F.min("key").cast("double").alias("low"),
                                       F.max("key").cast("double").alias("high"))
    along = (F.col("key").cast("double") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1.0))
    dealt = dealt.join(sizes, "range").withColumn("slice", F.least(F.floor(along * F.col("slices")), F.col("slices") - 1))
    parts = dealt.groupBy("range", "slice").agg(F.ceil(F.count("*") / range_rows).alias("parts"))
    dealt = dealt.drop("slices", "low", "high").join(parts, ["range", "slice"]).withColumn(
        "part", F.struct("slice", F.pmod(F.xxhash64("row"), F.col("parts")).alias("number"))).drop("slice", "parts")
    totals = dealt.groupBy("range", "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("range", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
                           F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"))
    within = Window.partitionBy("range", "part").orderBy("key", "doc_id", "row")
    placed = dealt.withColumn("rank", F.row_number().over(within)).withColumn(
        "run", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))).join(starts, ["range", "part"])
    middle = F.col("bytes_before") + F.col("run") - F.col("size") / 2
    shard = F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / max(total, 1)).cast("int"))
    numbered = cut(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"),
                                 (F.col("rows_before") + F.col("rank") - 1).alias("place")))
    first = numbered.groupBy("shard").agg(F.min("place").alias("first"))
    # one row for each shard
    return numbered.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))
