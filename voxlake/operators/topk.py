"""The best page of a search without reading all postings of its words.

A written index gets a second form, in which a word's documents lie in tiers by what they can score. A word's part of a
BM25 score depends on its weighted frequency f and the document's length, as 1 / (1 + k1 * ((1 - b) / f + b * (length / f)
/ mean)). Tiers are steps of length / f, and each (word, tier) has its number of documents, largest f and smallest
length / f. These give an upper bound of any score in the tier, whatever the corpus figures have become meanwhile, and
the figures of a query without a scan.

A search reads the highest tiers until they hold a page, which gives a score that the page's last row has at least. Tiers
are left out as long as the sum of the words' bounds over what is left out stays below that score: a document that lies
in none of the tiers read cannot be on the page. Documents of the tiers read go on only if they can still reach the page;
for these alone the words' other tiers are looked up. So the page equals that of a search over everything, ties included.

Parts of the index that have no tiers yet (new inserts) get them for the query's words while searching.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxlake import constants as K
from voxlake.functions.dates import event_time
from voxlake.operators import fulltext
from voxlake.operators.fulltext import Index, Match, Place
from voxlake.session import holding
from voxlake.sources import files

FEW = 100_000      # so many ids are sent to all tasks
STEPS = 2          # tiers to a doubling of length / f
SEED = 4           # first read: so many postings for each row of the page
GROWTH = 8         # and so many times more if they do not hold a page
POSTINGS = "bucket int, term string, tier int, doc_id long, f double, dl long"
STATS = "bucket int, term string, tier int, n_docs long, max_f double, min_ratio double"
# tiers' narrow rows come to Python by their number; to ask for a batch's bytes at each row takes three times as long
RUN_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2048", "spark.sql.execution.arrow.maxBytesPerBatch": str(2**31 - 1)}
_SLACK = 1e-9
_EVERYTHING = math.inf
_NOTHING = -math.inf


@dataclass(frozen=True)
class Impacts:
    postings: DataFrame
    stats: DataFrame
    n_docs: int
    total_length: int


def _postings(index: Index, words: list[str] | None = None) -> DataFrame:
    own = index.postings
    if words is not None:
        own = own.where(F.col("bucket").isin(sorted({fulltext.bucket_of(w) for w in words})) & F.col("term").isin(words))
    weight = F.when(F.col("in_title"), K.TITLE_WEIGHT).otherwise(K.CONTENT_WEIGHT + K.REVIEW_WEIGHT)
    counted = own.groupBy("bucket", "term", "doc_id").agg(F.sum(weight * F.col("tf")).alias("f"))
    return _in_tiers(counted.join(index.doc_stats, "doc_id"))


def _in_tiers(weighed: DataFrame) -> DataFrame:
    return weighed.select(
        "bucket", "term", F.floor(STEPS * F.log2(F.col("dl") / F.col("f"))).cast("int").alias("tier"), "doc_id", "f", "dl")


def _whole_part(index: Index) -> DataFrame:
    """The same for all words of a written part, whose files are by bucket already.

    Its rows hold what a tier needs, so nothing is shuffled but postings of ids that come more than once, which are summed up, and of
    parts from before rows held it.
    """
    own = index.postings
    if not own.where("f IS NULL").isEmpty():
        return _postings(index).hint("rebalance", "bucket")
    made = _in_tiers(own.where("f > 0 AND doc_id IS NOT NULL"))
    again = index.doc_stats.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not (n := again.count()):
        return made
    again = F.broadcast(again) if n <= FEW else again
    several = _postings(replace(index, postings=own.join(again, "doc_id", "left_semi")))
    return made.join(again, "doc_id", "left_anti").select(*made.columns).unionByName(several.hint("rebalance", "bucket"))


def _runs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by bucket, term and tier the figures of rows that follow each other within one of these."""
    for part in parts:
        if not part.num_rows:
            continue
        keys = [part.column(c) for c in ("bucket", "term", "tier")]
        differs = [pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False) for k in keys]
        starts = np.flatnonzero(np.concatenate(([True], differs[0] | differs[1] | differs[2])))
        f, dl = (np.asarray(part.column(c)) for c in ("f", "dl"))
        yield pa.RecordBatch.from_arrays(
            [*(k.take(pa.array(starts)) for k in keys), pa.array(np.diff(starts, append=part.num_rows)),
             pa.array(np.maximum.reduceat(f, starts)), pa.array(np.minimum.reduceat(dl / f, starts))],
            names=[c.split()[0] for c in STATS.split(", ")])


def _stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("bucket", "term", "tier").agg(
        F.count("*").alias("n_docs"), F.max("f").alias("max_f"), F.min(F.col("dl") / F.col("f")).alias("min_ratio"))


def _with_tiers(spark: SparkSession, path: str) -> set[str]:
    """Parts whose tiers are whole; their figures are written last."""
    return {n.removeprefix("part=") for n in files.names(spark, f"{path}/impact_stats")
            if n.startswith("part=") and "_SUCCESS" in files.names(spark, f"{path}/impact_stats/{n}")}


def add_impacts(spark: SparkSession, path: str) -> list[str]:
    """Writes the tiers of the index's parts that have none, and removes those of parts that are gone; the parts done.

    A run that is broken off leaves a part without figures, which the next run writes anew.
    """
    there, parts = _with_tiers(spark, path), fulltext.manifest(spark, path)["parts"]
    order = ["bucket", "term", "tier", "doc_id"]
    done = []
    for own in parts:
        name = own["part"]
        if name in there:
            continue
        with holding(spark, fulltext.WRITE_CONF | RUN_CONF):
            _whole_part(fulltext.read_index(spark, path, [own])).sortWithinPartitions(*order).write.mode("overwrite").partitionBy(
                "bucket").option("compression", "zstd").parquet(f"{path}/impacts/part={name}")
            # files are sorted, so a tier's rows are side by side; the readers of figures sum up what has been cut
            spark.read.schema(POSTINGS).parquet(f"{path}/impacts/part={name}").drop("doc_id").mapInArrow(
                _runs, STATS).sortWithinPartitions(*order[:3]).write.mode("overwrite").option("compression", "zstd").parquet(
                f"{path}/impact_stats/part={name}")
        done.append(name)
    for old in there - {p["part"] for p in parts}:
        files.delete(spark, f"{path}/impact_stats/part={old}")
        files.delete(spark, f"{path}/impacts/part={old}")
    return done


def read_impacts(spark: SparkSession, path: str, match: Match) -> Impacts:
    """Tiers of the query's words, of all parts of the index's newest manifest."""
    words = _words(match)
    wanted = F.col("bucket").isin(sorted({fulltext.bucket_of(w) for w in words})) & F.col("term").isin(words)
    there, parts = _with_tiers(spark, path), fulltext.manifest(spark, path)["parts"]
    old, new = [p for p in parts if p["part"] in there], [p for p in parts if p["part"] not in there]
    postings, stats = [], []
    if old:
        for name, schema, into in (("impacts", POSTINGS, postings), ("impact_stats", STATS, stats)):
            into.append(spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(
                *(f"{path}/{name}/part={p['part']}" for p in old)).where(wanted).drop("part"))
    if new or not parts:
        own = _postings(fulltext.read_index(spark, path, new), words)
        postings.append(own)
        stats.append(_stats(own).select(*[c.split()[0] for c in STATS.split(", ")]))
    return Impacts(reduce(DataFrame.unionByName, postings), reduce(DataFrame.unionByName, stats),
                   sum(p["n_docs"] for p in parts), sum(p["total_length"] for p in parts))


def _words(match: Match) -> list[str]:
    return list(dict.fromkeys(w for u in match.units for w in u.words))


def supports(match: Match) -> bool:
    """Words in all columns; phrases, prefixes and column scopes are left to `fulltext.score_index`."""
    return bool(match.required + match.optional) and all(
        len(u.words) == 1 and not u.prefix and u.column is None for u in match.units)


@dataclass(frozen=True)
class Tier:
    tier: int
    n_docs: int
    bound: float       # no document of the tier gets more for the word


@dataclass(frozen=True)
class Bounds:
    tiers: Mapping[str, list[Tier]]    # by word, from the highest scores on
    found: Mapping[str, int]           # documents with the word

    def left(self, word: str, cut: float) -> float:
        """The most that a document behind the cut gets for a word."""
        return max((t.bound for t in self.tiers[word] if t.tier > cut), default=0.0)

    def n_postings(self, cuts: Mapping[str, float]) -> int:
        return sum(t.n_docs for w, own in self.tiers.items() for t in own if t.tier <= cuts.get(w, _NOTHING))

    def first(self, n: int, words: list[str]) -> dict[str, float]:
        """Cuts over the highest tiers that hold n postings of the words (all, if there are fewer)."""
        cuts, total = dict.fromkeys(words, _NOTHING), 0
        best = sorted(((t, w) for w in words for t in self.tiers[w]), key=lambda p: (-p[0].bound, p[0].tier))
        for t, w in best:
            if total >= n:
                return cuts
            cuts[w], total = max(cuts[w], t.tier), self.n_postings({**cuts, w: max(cuts[w], t.tier)})
        return dict.fromkeys(words, _EVERYTHING)

    def enough(self, least: float, words: list[str], cuts: Mapping[str, float]) -> dict[str, float]:
        """The cuts lowered until what is left out stays below a score."""
        cuts = dict(cuts)
        while (left := {w: self.left(w, cuts[w]) for w in words}) and sum(left.values()) >= least * (1 - _SLACK):
            word = max(left, key=left.get)
            if not left[word]:
                break
            cuts[word] = min(t.tier for t in self.tiers[word] if t.tier > cuts[word])
        return cuts


def bounds_of(impacts: Impacts, match: Match) -> Bounds:
    """Figures of the query's words: tiers times words rows, whatever the size of the corpus."""
    words = _words(match)
    rows = impacts.stats.groupBy("term", "tier").agg(
        F.sum("n_docs").alias("n_docs"), F.max("max_f").alias("max_f"), F.min("min_ratio").alias("min_ratio")).collect()
    tiers: dict[str, list[Tier]] = {w: [] for w in words}
    found = {w: sum(r["n_docs"] for r in rows if r["term"] == w) for w in words}
    mean = impacts.total_length / impacts.n_docs if impacts.n_docs else 1.0
    for r in sorted(rows, key=lambda r: r["tier"]):
        n = found[r["term"]]
        raw = math.log((impacts.n_docs - n + 0.5) / (n + 0.5))
        least = K.BM25_K1 * ((1 - K.BM25_B) / r["max_f"] + K.BM25_B * r["min_ratio"] / mean)
        bound = (raw if raw > 0 else K.MIN_IDF) * (K.BM25_K1 + 1) / (1 + least) * (1 + _SLACK)
        tiers[r["term"]].append(Tier(r["tier"], r["n_docs"], bound))
    return Bounds(tiers, found)


def _where(words: list[str], cuts: Mapping[str, float], read: bool) -> Column:
    """Postings of the tiers that are read, or of those that are left out."""
    parts = [F.lit(False)]
    for w in words:
        cut, own = cuts.get(w, _NOTHING), F.col("term") == w
        if read and cut > _NOTHING:
            parts.append(own if cut == _EVERYTHING else own & (F.col("tier") <= int(cut)))
        elif not read and cut < _EVERYTHING:
            parts.append(own if cut == _NOTHING else own & (F.col("tier") > int(cut)))
    return reduce(lambda a, b: a | b, parts)


def _scores(impacts: Impacts, match: Match, bounds: Bounds, cuts: Mapping[str, float], least: float | None) -> DataFrame:
    """(id, fts_score) of the matching documents of the tiers read, without those that stay below `least` at any rate."""
    words = _words(match)
    names = {w: f"_w{i}" for i, w in enumerate(words)}
    sums = [F.sum(F.when(F.col("term") == w, F.col("f"))).alias(c) for w, c in names.items()]
    seen = impacts.postings.where(_where(words, cuts, True)).groupBy("doc_id").agg(F.max("dl").alias("_dl"), *sums)
    figures = F.struct(F.lit(max(1, impacts.n_docs)).alias("n_docs"), F.lit(impacts.total_length).alias("total_length"),
                       *(F.lit(bounds.found[u.words[0]]).alias(f"n_{i}") for i, u in enumerate(match.units)))

    def score(frequencies: list[Column]) -> Column:
        return fulltext.bm25(frequencies, F.col("_dl"), figures)

    units = [names[u.words[0]] for u in match.units]
    if least is not None:
        spare = sum((F.when(F.col(names[u.words[0]]).isNull(), bounds.left(u.words[0], cuts.get(u.words[0], _NOTHING)))
                     .otherwise(0.0) for u in match.required + match.optional), F.lit(0.0))
        known = -score([F.coalesce(F.col(c), F.lit(0.0)) for c in units])
        seen = seen.where(known + spare >= least * (1 - _SLACK))
    if any(bounds.left(w, cuts.get(w, _NOTHING)) for w in words):
        rest = impacts.postings.where(_where(words, cuts, False)).join(seen.select("doc_id"), "doc_id", "left_semi")
        more = rest.groupBy("doc_id").agg(*(s.alias(f"{c}r") for s, c in zip(sums, names.values(), strict=True)))
        seen = seen.join(more, "doc_id", "left").select(
            "doc_id", "_dl", *(F.coalesce(c, f"{c}r").alias(c) for c in names.values()))
    weighted = [F.coalesce(F.col(c), F.lit(0.0)) for c in units]
    return seen.where(fulltext.matches(match, weighted)).select(F.col("doc_id").alias("id"), score(weighted).alias("fts_score"))


def best_rows(impacts: Impacts, match: Match, k: int, narrowed: Callable[[DataFrame], DataFrame],
              after: Place | None = None) -> DataFrame:
    """Rows among which are the k best of all matching ones, as `narrowed` makes them of (id, fts_score).

    `narrowed` applies the filters and adds times; with `after`, the k best behind that place. At most a page's
    last score comes to the driver.
    """
    words = list(dict.fromkeys(u.words[0] for u in match.required + match.optional))
    bounds = bounds_of(impacts, match)
    n = SEED * k
    while True:
        cuts = bounds.first(n, words)
        if all(c == _EVERYTHING for c in cuts.values()):
            return narrowed(_scores(impacts, match, bounds, cuts, None))
        rows = narrowed(_scores(impacts, match, bounds, cuts, None)).withColumn("_time", event_time())
        last = fulltext.after_place(rows, after).select("fts_score").orderBy("fts_score").limit(k).agg(
            F.count("*"), F.max("fts_score")).first()
        if last[0] == k:
            break
        n *= GROWTH
    least = -last[1]
    return narrowed(_scores(impacts, match, bounds, bounds.enough(least, words, cuts), least))
