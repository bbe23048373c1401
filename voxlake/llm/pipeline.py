"""The stages of corpus_pipeline.py. Each takes (spark, docs, sf_dir); all but the last return documents' columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm.bpe import bpe_round_trip
from voxlake.llm.common import cut, whole
from voxlake.llm.decontaminate import decontaminate
from voxlake.llm.near_copies import first_copies, with_id_key
from voxlake.llm.quality_rules import quality_rules
from voxlake.llm.queries import ids_sha256, tokenizer_path
from voxlake.llm.simhash_dedup import text_links
from voxlake.llm.substring_dedup import substring_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _documents(df: DataFrame, text: Column) -> DataFrame:
    return df.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents are gone; of the others, failing lines are."""
    return _documents(quality_rules(docs).filter("kept"), F.col("clean_text"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies stays: that of the smallest id (null ids come last), and of several texts
    or rows with this id that of the smallest hash, or of the smallest lang and source.

    Candidates are op1's components of fingerprints and those of min-hashes; links are kept where the shingles have a
    Jaccard similarity of 0.8 or more."""
    # texts are dealt once: null ids have columns of their own, by which rows are joined and grouped alike
    key = ["no_id", "id", "node"]
    first = with_id_key(first_copies(docs, text_links(docs)), "doc_id").select(*key)
    own = with_id_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole(F.col("text"))).alias("node"),
                                  "text", "lang", "source"), "doc_id").drop("doc_id").join(first, key, "left_semi")
    once = own.groupBy(*key).agg(F.min(F.struct("lang", "source")).alias("of"), F.first("text").alias("text"))
    return _documents(once.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "text", "of.lang", "of.source"),
                      F.col("text"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages are gone; documents of which nothing stays go as well."""
    kept = substring_dedup(docs, keep=("text", "lang", "source"))
    return _documents(kept.filter("n_removed < n_words or n_words = 0"),
                      F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item are gone."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("text", "lang", "source"))
    return _documents(found.filter(F.size("spans") == 0), F.col("text"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with checksums of them and of what they decode to."""
    return bpe_round_trip(docs, tokenizer_path(), keep=("lang", "source")).select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
        ids_sha256("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage), ("near_dedup", near_dedup_stage), ("substring_dedup", substring_stage),
    ("decontaminate", decontamination_stage), ("bpe_round_trip", encoding_stage),
]


def run_stages(spark: SparkSession, sf_dir: str, stages: list[tuple[str, Stage]]) -> DataFrame:
    """Each stage over the rows of the one before, which are written in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(stages):
        docs = stage(spark, docs, sf_dir)
        if number < len(stages) - 1:
            docs = cut(docs)
    return docs
