"""Near copies: components of texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

A node is a different text, by 64 bits of its hash. Its 130 min-hashes make 26 bands of five; texts that share a
band are candidates (of pairs at 0.8, all but 1 in 20,000 do), and of these, pairs that agree in 84 or more of the
130 (at 0.8: all but 1 in 100,000) connect coarse groups. The texts of a coarse group then meet, and links are kept
where the sets themselves have the similarity, in whole numbers: no candidate is linked unverified.

Buckets of bands and coarse groups are walked breadth first in one task and give links to their components' first
members only, never pairs. A bucket of over CAP nodes is dealt as pairs of blocks, of their short signatures. A coarse
group of over GROUP nodes or GROUP_BYTES bytes is a large one, of texts: its root goes to every block, so that most
members are linked to the root or among themselves at once. Only members that are then not yet in the root's component
meet the blocks again, so texts are sent once, and once more for each block of such members.

Fewer than five words are one shingle, null and empty texts are a shingle without words. A component's id is its
smallest doc_id; null ids come into account only where a component has no other. first_copies names one row of each
component by its id and text: the smallest id, and of the texts that share it the one of the smallest hash. Candidate
links (a, b) of another method may join coarse groups; they are verified like the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.arrays import ranges
from voxlake.llm.common import cut, partitions, whole
from voxlake.llm.components import components

SHINGLE, SEED = 5, 42
BANDS, ROWS, AGREE = 26, 5, 84
CAP, GROUP, GROUP_BYTES = 4096, 1024, 8_000_000

_drawn = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.int64).astype(np.uint64)
MIX, FACTOR = _drawn[0], _drawn[1] | np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """The different hashes of a text's shingles, sorted."""
    words = text.lower().split()
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words] or [1]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[SHINGLE - 1:] if len(words) >= SHINGLE else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), last.tolist())], np.uint64))


def min_hashes(own: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(own), 512):
        np.minimum(least, ((own[at:at + 512, None] ^ MIX) * FACTOR).min(axis=0), out=least)
    return least


def _sketches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        keys, signs = [], []
        for text in part.column("text"):
            least = min_hashes(shingles(text.as_buffer().to_pybytes()))
            keys.append([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, ROWS))])
            signs.append((least ^ (least >> np.uint64(32))).astype(np.uint8).tobytes())
        bands = pa.array(np.array(keys, np.uint64).reshape(-1).view(np.int64))
        offsets = pa.array(np.arange(0, BANDS * part.num_rows + 1, BANDS, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("node"), part.column("size"), pa.ListArray.from_arrays(offsets, bands),
             pa.array(signs, pa.binary())], names=["doc_id", "node", "size", "bands", "sign"])


def first_members(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Of each of n members the first one of its component; near tells which of some members one is linked to."""
    root = np.arange(n)
    unseen = np.arange(n)
    while len(unseen):
        first, unseen = unseen[0], unseen[1:]
        queue = [first]
        while queue and len(unseen):
            found = near(queue.pop(), unseen)
            if found.any():
                root[unseen[found]] = first
                queue.extend(unseen[found])
                unseen = unseen[~found]
    return root


def agreeing(signs: list[bytes]) -> np.ndarray:
    table = np.frombuffer(b"".join(signs), np.uint8).reshape(-1, BANDS * ROWS)
    return first_members(len(table), lambda x, some: (table[some] == table[x]).sum(axis=1) >= AGREE)


def similar(texts: list[bytes]) -> np.ndarray:
    """The first member of each text's component, by Jaccard similarities of 4/5 and more."""
    sets = [shingles(t) for t in texts]
    size = np.array([len(s) for s in sets])
    start = np.cumsum(size) - size
    every, word = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.zeros(len(every), bool)

    def near(x: int, some: np.ndarray) -> np.ndarray:
        out = (5 * size[some] >= 4 * size[x]) & (4 * size[some] <= 5 * size[x])
        likely = some[out]
        if len(likely):
            own = word[start[x]:start[x] + size[x]]
            held[own] = True
            at = ranges(start[likely], size[likely])
            common = np.add.reduceat(held[word[at]], np.cumsum(size[likely]) - size[likely], dtype=np.int64)
            held[own] = False
            out[out] = 9 * common >= 4 * (size[x] + size[likely])
        return out

    return first_members(len(sets), near)


def _linked(walk: Callable[[list[bytes]], np.ndarray]):
    """Links of the members of each key, of batches sorted by key and node. A node counts once for a key."""
    def links(nodes: list[int], held: list[bytes]) -> pa.RecordBatch:
        root = walk(held)
        at = np.flatnonzero(root != np.arange(len(root)))
        own = np.array(nodes, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(own[root[at]])], names=["a", "b"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nodes, held = None, [], []
        for part in parts:
            for key, node, payload in zip(*(part.column(c).to_pylist() for c in ("key", "node", "payload"))):
                if key != last:
                    if len(nodes) > 1:
                        yield links(nodes, held)
                    last, nodes, held = key, [], []
                if not nodes or node != nodes[-1]:
                    nodes.append(node)
                    held.append(payload)
        if len(nodes) > 1:
            yield links(nodes, held)
    return run


def _dealt(members: DataFrame, blocks: Column) -> DataFrame:
    """Members (key, node, ...) of each key, or of each pair of its blocks."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(F.col("own"), j) * F.col("blocks")
                        + F.greatest(F.col("own"), j))
    return members.withColumn("blocks", blocks.cast("int")).withColumn("own", own).withColumn(
        "pair", F.explode(meets)).withColumn("key", F.when(F.col("pair") == 0, F.col("key")).otherwise(
            F.xxhash64("key", "pair"))).drop("blocks", "own", "pair")


def _walked(dealt: DataFrame, walk: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    # by an expression that no join before deals by: Spark drops a second dealing by the same key, and adaptive planning,
    # which knows nothing of the walk, may then read the join's own shuffle piece by piece and part a key's rows
    return dealt.select("key", "node", F.col("payload").cast("binary").alias("payload")).repartition(
        partitions(dealt), F.xxhash64("key")).sortWithinPartitions("key", "node").mapInArrow(_linked(walk), "a long, b long")


def _in_blocks(once: DataFrame, sizes: DataFrame) -> DataFrame:
    """Links of the texts (node, root, payload) of large groups: blocks with the root, then those left with all blocks."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = cut(once.join(sizes, "root").withColumn("own", own))
    everywhere = F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    first = cut(_walked(members.withColumn("block", F.explode(everywhere)).withColumn("key", F.xxhash64("root", "block")), similar))
    reached = components(first).withColumnRenamed("root", "found")
    # the root of a group is its smallest node, and so the root of its component
    left = cut(members.join(reached, "node", "left").filter(F.coalesce("found", "node") != F.col("root")).select(
        "node", "root", F.octet_length("payload").cast("long").alias("bytes")))
    rest = left.groupBy("root").agg(
        F.ceil(F.greatest(F.count("*") / GROUP, F.sum("bytes") / GROUP_BYTES)).cast("int").alias("rests"))
    asked = left.select("node", F.lit(True).alias("is_left"))
    again = members.join(rest, "root").join(asked, "node", "left").select(
        "node", "root", "payload", "blocks", "rests", "own", F.coalesce("is_left", F.lit(False)).alias("is_left"))
    mine = F.pmod(F.xxhash64("node", F.lit(1)), F.col("rests")).cast("int")
    as_member = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j")))
    as_rest = F.when(F.col("is_left"), F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(i.alias("i"), mine.alias("j")))).otherwise(
            F.array().cast("array<struct<i: int, j: int>>"))
    met = again.select("node", "root", "payload", F.explode(F.array_union(as_member, as_rest)).alias("at"))
    second = _walked(met.withColumn("key", F.xxhash64("root", "at.i", "at.j")), similar)
    return first.unionByName(second)


def with_id_key(rows: DataFrame, name: str) -> DataFrame:
    """Adds an id that may be null as two columns that are not: no_id, and id (0 for null)."""
    return rows.withColumns({"no_id": F.col(name).isNull(), "id": F.coalesce(name, F.lit(0).cast("long"))})


def _labelled(docs: DataFrame, candidates: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, node), and nodes with their component's root and their smallest doc_id, least."""
    text = whole(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("node"), text.alias("text"))
    found = cut(rows.withColumn("size", F.octet_length("text").cast("long")).mapInArrow(
        _sketches, "doc_id long, node long, size long, bands array<long>, sign binary"))
    nodes = cut(found.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"),
                                          F.first("bands").alias("bands"), F.first("sign").alias("payload")))
    keys = nodes.select(F.explode("bands").alias("key"), "node")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = _dealt(keys.join(shared, "key"), F.ceil(F.col("n") / CAP)).select("key", "node")
    likely = _walked(members.join(nodes.select("node", "payload"), "node"), agreeing)
    coarse = components(likely if candidates is None else likely.unionByName(candidates))
    # roots have no row of their own in components' result
    group = cut(coarse.unionByName(coarse.select(F.col("root").alias("node"), "root").distinct()).join(
        nodes.select("node", "least", "size"), "node"))
    blocks = F.ceil(F.greatest(F.count("*") / GROUP, F.sum("size") / GROUP_BYTES)).cast("int")
    sizes = cut(group.groupBy("root").agg(blocks.alias("blocks")))
    # by node and id: the copies of a text are many rows, of which one is sent on
    key = ["no_id", "id", "node"]
    texts = with_id_key(rows, "doc_id").select(*key, "text").join(with_id_key(group, "least").select(*key, "root"), key)
    once = cut(texts.groupBy(*key, "root").agg(F.first("text").alias("payload")).select("node", "root", "payload"))
    small = once.join(sizes.filter("blocks = 1"), "root").withColumnRenamed("root", "key")
    links = _walked(small, similar).unionByName(_in_blocks(once, sizes.filter("blocks > 1")))
    roots = components(links)
    return found.select("doc_id", "node"), nodes.select("node", "least").join(roots, "node", "left").select(
        "node", "least", F.coalesce("root", "node").alias("root"))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id and component_id of each row."""
    rows, linked = _labelled(docs)
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = linked.join(ids, "root").select("node", "component_id")
    return rows.join(labels, "node").select("doc_id", "component_id")


def first_copies(docs: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """doc_id and node (the text's hash) of one row of each component; rows that are equal in both are one.

    `candidates` are links (a, b) of nodes that are verified beside those of the min-hashes."""
    _, linked = _labelled(docs, candidates)
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node"))
    return linked.groupBy("root").agg(first.alias("first")).select(F.col("first.least").alias("doc_id"), "first.node")
