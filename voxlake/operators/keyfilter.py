"""Bloom filters of stored keys, asked before an insert looks for its keys among all stored ones.

A part covers the documents of one insert (or several, merged), by their id range. It is a table of blocks of bits;
a key's 64-bit hash names its block, and seven bits in it. Parts lie under a manifest like those of the text index and are
merged by tiers, so their number grows with the logarithm of the documents. A merge counts the keys anew, since a
larger part has more blocks.

To ask, the hashes of incoming keys and the blocks of all parts meet by the hash's residue: what is shuffled are
incoming hashes and about 13 bits for each stored key, never the keys. The answer names the parts that may hold a key, so
the exact look-up that follows reads only the id ranges of these parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxlake.operators.fulltext import FAN, manifest, merge_tiers, new_part

BLOCK_BITS = 15            # 32,768 bits a block
KEYS_A_BLOCK = 2_500       # 13 bits a key
PROBES = 7                 # at 13 bits a key: one false hit in 500
FEW_TASKS = 256            # a part is written by this many tasks at most
BLOCKS = "part string, blocks long, block long, bits binary"


def key_hashes(*keys: tuple[str, ...]) -> Column:
    """Hashes of a row's keys, one for each tuple of columns; a key with a NULL has none."""
    def one(number: int, columns: tuple[str, ...]) -> Column:
        complete = F.lit(True)
        for c in columns:
            complete = complete & F.col(c).isNotNull()
        return F.when(complete, F.xxhash64(F.lit(number), *(F.col(c).cast("string") for c in columns)))

    return F.filter(F.array(*(one(i, k) for i, k in enumerate(keys))), lambda h: h.isNotNull())


def _places(hashes: np.ndarray) -> np.ndarray:
    """The bits of each hash within its block, one column for each probe."""
    h = hashes.view(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    step = (h >> np.uint64(40)) | np.uint64(1)
    return ((h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) >> np.uint64(8)) & np.uint64((1 << BLOCK_BITS) - 1)


def _block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return (hashes.view(np.uint64) & np.uint64(blocks - 1)).astype(np.int64)


def _blocks_for(n_keys: int) -> int:
    return 1 << max(0, -(-n_keys // KEYS_A_BLOCK) - 1).bit_length()


def _filled(part: str, blocks: int):
    """Blocks of hashes that come sorted by block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(block: int, bits: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"part": [part], "blocks": [blocks], "block": [block], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

        now, bits = None, np.zeros(1 << BLOCK_BITS, bool)
        for batch in batches:
            hashes = np.asarray(batch.column("h"))
            own = _block_of(hashes, blocks)
            for block in np.unique(own).tolist():
                if block != now:
                    if now is not None:
                        yield done(now, bits)
                    now, bits = block, np.zeros(1 << BLOCK_BITS, bool)
                bits[_places(hashes[own == block])] = True
        if now is not None:
            yield done(now, bits)
    return run


def stage_filter(hashes: DataFrame, path: str, part: str, first: int, last: int) -> dict[str, Any]:
    """Writes a part of the hashes (a column h) of documents with ids from first to last; its entry for the manifest."""
    n = hashes.count()
    blocks = _blocks_for(n)
    block = F.col("h").bitwiseAND(blocks - 1)
    hashes.repartition(min(blocks, FEW_TASKS), block).sortWithinPartitions(block).mapInArrow(
        _filled(part, blocks), BLOCKS).write.mode("overwrite").parquet(f"{path}/blocks/of={part}")
    return {"part": part, "n_docs": n, "first": first, "last": last}


def _asked(key: tuple, incoming: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """Of one residue: each incoming hash with each part that may hold it."""
    hashes = incoming["h"].to_numpy(np.int64)
    found = [(hashes[:0], np.zeros(0, object))]
    places = _places(hashes)
    for (part, blocks), own in filters.groupby(["part", "blocks"], sort=False):
        bits = {b: np.frombuffer(x, np.uint8) for b, x in zip(own["block"], own["bits"])}
        block = _block_of(hashes, int(blocks))
        for b in np.unique(block).tolist():
            if b in bits:
                at = np.flatnonzero(block == b)
                held = (bits[b][(places[at] >> np.uint64(3)).astype(np.int64)] >> (places[at] & np.uint64(7)).astype(np.uint8)) & 1
                hit = at[held.all(axis=1)]
                found.append((hashes[hit], np.full(len(hit), part, object)))
    h, part = (np.concatenate(x) for x in zip(*found))
    return pd.DataFrame({"h": h, "part": part})


def ask(spark: SparkSession, path: str, hashes: DataFrame) -> DataFrame:
    """(h, part) for every incoming hash (a column h, each once) and part that may hold it."""
    entries = manifest(spark, path)["parts"]
    if not entries:
        return spark.createDataFrame([], "h long, part string")
    blocks = spark.read.schema(BLOCKS).parquet(*(f"{path}/blocks/of={p['part']}" for p in entries))
    # both sides meet by as many groups as a shuffle has partitions, or the next power of two
    residues = 1 << (max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) - 1).bit_length()
    residue = F.col("h").bitwiseAND(residues - 1).cast("int")
    # a block of few is needed for several residues, a block of many for one
    own = F.col("block").bitwiseAND(residues - 1)
    needed = F.when(F.col("blocks") >= residues, F.array(own)).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.floor(residues / F.col("blocks")) - 1), lambda i: F.col("block") + i * F.col("blocks")))
    dealt = blocks.withColumn("residue", F.explode(needed.cast("array<int>")))
    return hashes.withColumn("residue", residue).groupBy("residue").cogroup(dealt.groupBy("residue")).applyInPandas(
        _asked, "h long, part string")


def possible_ranges(spark: SparkSession, path: str, parts: list[str]) -> list[tuple[int, int]]:
    """Id ranges of parts, those that touch as one."""
    ranges = sorted((p["first"], p["last"]) for p in manifest(spark, path)["parts"] if p["part"] in set(parts))
    out: list[tuple[int, int]] = []
    for first, last in ranges:
        if out and first <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(last, out[-1][1])
        else:
            out.append((first, last))
    return out


def merge_filters(spark: SparkSession, path: str, documents: DataFrame, keys: tuple[tuple[str, ...], ...], *, fan: int = FAN) -> int:
    """Merges parts by tiers, from the stored documents' keys; how many merges there were."""
    def merged(full: list[dict[str, Any]]) -> dict[str, Any]:
        ids = F.lit(False)
        for first, last in possible_ranges(spark, path, [p["part"] for p in full]):
            ids = ids | F.col("id").between(first, last)
        hashes = documents.where(ids).select(F.explode(key_hashes(*keys)).alias("h"))
        entry = stage_filter(hashes, path, new_part(), min(p["first"] for p in full), max(p["last"] for p in full))
        return entry | {"rows": sum(p["rows"] for p in full)}

    return len(merge_tiers(spark, path, merged, fan=fan))

