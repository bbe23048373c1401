"""The registered queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm.bpe import bpe_round_trip
from voxlake.llm.decontaminate import decontaminate
from voxlake.llm.preference_format import parroting_pairs, preference_pairs
from voxlake.llm.quality_rules import FIGURES, quality_rules
from voxlake.llm.rule_ensemble import quality_scores
from voxlake.llm.sentencepiece_bpe import piece_round_trip
from voxlake.llm.sharding import shards
from voxlake.llm.simhash_dedup import simhash_dedup
from voxlake.llm.spelling_variants import spelling_variants
from voxlake.llm.substring_dedup import substring_dedup
from voxlake.llm.suffix_dedup import suffix_dedup
from voxlake.llm.url_trust import url_verdicts
from voxlake.llm.whitening import whitening

URL_RULES = {
    "com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block",
}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A tokenizer file, which every machine has at the same place."""
    import public_tokenizers

    return str(Path(public_tokenizers.path(name)))


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ids_sha256(ids: str) -> Column:
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256)


def op1_simhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_dedup(_table(spark, sf, "documents"))


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules(_table(spark, sf, "documents")).select("doc_id", *FIGURES, "base_failed", "kept")


def _token_digests(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_sha256("ids").alias("ids_sha256"),
                         F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return _token_digests(bpe_round_trip(_table(spark, sf, "documents"), tokenizer_path()))


def op4_url_trust(spark: SparkSession, sf: str) -> DataFrame:
    return url_verdicts(_table(spark, sf, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup(_table(spark, sf, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return decontaminate(_table(spark, sf, "documents"), _table(spark, sf, "benchmark")).select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op7_rule_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    return quality_scores(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op8_preference_format(spark: SparkSession, sf: str) -> DataFrame:
    return preference_pairs(parroting_pairs(_table(spark, sf, "conversations"))).withColumnRenamed("pair_id", "conv_id")


def op9_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return shards(_table(spark, sf, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def op10_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_variants(_table(spark, sf, "documents"), damage=199)


def op12_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return _token_digests(piece_round_trip(_table(spark, sf, "documents"), tokenizer_path("piece_bpe_32k.model")))


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening(_table(spark, sf, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query for query in (
        op1_simhash_dedup, op2_quality_rules, op3_bpe_round_trip, op4_url_trust, op5_substring_dedup, op6_decontaminate,
        op7_rule_ensemble, op8_preference_format, op9_sharding, op10_suffix_dedup, op11_spelling_variants,
        op12_sentencepiece, op13_whitening)
}

ORACLES: dict[str, str] = {
    "op8_preference_format": """
        WITH numbered AS (
          SELECT conv_id, role, text, row_number() OVER (
            PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
          FROM conversations),
        ended AS (SELECT conv_id, max(pos) AS k FROM numbered WHERE role = 'assistant' GROUP BY conv_id),
        sides AS (
          SELECT n.conv_id, n.pos, e.k, coalesce(n.role, '') AS role, coalesce(n.text, '') AS good,
            CASE WHEN n.pos < e.k THEN coalesce(n.text, '') ELSE coalesce(
              lag(n.text) OVER (PARTITION BY n.conv_id ORDER BY n.pos), '') END AS bad
          FROM numbered n JOIN ended e ON n.conv_id = e.conv_id WHERE n.pos <= e.k),
        cuts AS (
          SELECT conv_id, coalesce(min(CASE WHEN good <> bad THEN pos END) - 1, max(k)) AS n
          FROM sides GROUP BY conv_id),
        turns AS (
          SELECT s.conv_id, s.pos, s.pos <= c.n AS shared, c.n, CASE WHEN s.role = 'assistant' THEN '1' ELSE '0' END AS learn,
            '<|' || s.role || '|>' || chr(10) || s.good || chr(10) AS good,
            '<|' || s.role || '|>' || chr(10) || s.bad || chr(10) AS bad
          FROM sides s JOIN cuts c ON s.conv_id = c.conv_id)
        SELECT conv_id, CAST(max(n) AS INTEGER) AS n_prompt_turns,
          coalesce(string_agg(CASE WHEN shared THEN good END, '' ORDER BY pos), '') AS prompt,
          coalesce(string_agg(CASE WHEN NOT shared THEN good END, '' ORDER BY pos), '') AS chosen,
          coalesce(string_agg(CASE WHEN NOT shared THEN bad END, '' ORDER BY pos), '') AS rejected,
          coalesce(string_agg(CASE WHEN NOT shared THEN length(good) || ':' || learn END, ' ' ORDER BY pos), '') AS chosen_mask,
          coalesce(string_agg(CASE WHEN NOT shared THEN length(bad) || ':' || learn END, ' ' ORDER BY pos), '') AS rejected_mask
        FROM turns GROUP BY conv_id""",
    # a checksum by its table, words by their deletions: two words are near if they are equal without one letter each at
    # the same place, or if one is the other without one
    "op11_spelling_variants": """
        WITH RECURSIVE rounds(i, k, v) AS (
          SELECT range, 0, range FROM range(256)
          UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM rounds WHERE k < 8),
        crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM rounds WHERE k = 8),
        runs AS (
          SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
          FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{6,}')) AS run FROM documents) GROUP BY 1, 2),
        bytes AS (
          SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c:
            CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)] END)) AS b
          FROM runs),
        coded AS (
          SELECT run, n, xor(list_reduce(b, lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1]), CAST(4294967295 AS BIGINT)),
            4294967295) AS h FROM bytes, crc),
        words AS MATERIALIZED (
          SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
            SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
            FROM coded)
          WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
        shorter AS MATERIALIZED (
          SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS part
          FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
        pairs AS (
          SELECT a.word, a.n, b.word AS other, b.n AS m FROM shorter a JOIN shorter b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
          UNION SELECT s.word, s.n, w.word, w.n FROM shorter s JOIN words w ON s.part = w.word
          UNION SELECT w.word, w.n, s.word, s.n FROM shorter s JOIN words w ON s.part = w.word),
        best AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near FROM pairs
          QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, other) = 1),
        judged AS MATERIALIZED (
          SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 5 * w.n THEN b.other END AS form,
            CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
        walk(word, place, next) AS (
          SELECT word, word, form FROM judged
          UNION ALL SELECT k.word, j.word, j.form FROM walk k JOIN judged j ON j.word = k.next)
        SELECT j.word, j.form, k.place AS root, j.n, j.n_near, j.form_n FROM judged j JOIN walk k ON k.word = j.word AND k.next IS NULL""",
}
