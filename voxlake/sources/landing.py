"""Readers of landed files; every schema is given, nothing is inferred.

`arrival` orders records as they came in: file time, file, place in the file. Readers keep it beside
the record's own columns. A line that is no JSON object is no record: readers leave it out, `broken_lines` gives these
lines with their files. A record with a field of the wrong type stays, without that field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from voxlake import schemas
from voxlake.functions.dates import feed_timestamp
from voxlake.functions.text import blank_to_null, feed_text
from voxlake.functions.urls import last_part, permalink


def _with_arrival(df: DataFrame) -> DataFrame:
    """File metadata must be asked for before any other projection."""
    return df.select(
        "*",
        F.struct(
            F.col("_metadata.file_modification_time").alias("time"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("arrival"),
    )


BROKEN = "_corrupt_record"


def is_broken(line: Column) -> Column:
    """Whether a line that did not fit its schema is no JSON object at all (nor a list of some); NULL lines are not."""
    shaped = F.ltrim(line).startswith("{") | F.ltrim(line).startswith("[")
    return line.isNotNull() & ~(shaped & F.try_parse_json(line).isNotNull())


def _json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    own = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    rows = _with_arrival(spark.read.schema(own).option("columnNameOfCorruptRecord", BROKEN).json(path))
    return rows.where(~is_broken(F.col(BROKEN))).drop(BROKEN)


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of the lines under a path that readers leave out as broken; blank lines are none."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return lines.where((F.trim("line") != "") & is_broken(F.col("line")))


def _objects(spark: SparkSession, path: str, envelope: str, items: str) -> DataFrame:
    """Items of an envelope as JSON texts, one row each. One odd item must not cost the others, so
    each is parsed on its own."""
    lines = _json(spark, path, T.StructType.fromDDL(envelope))
    return lines.select("arrival", F.posexplode(items).alias("i", "item")).select(
        F.col("item"), F.struct("arrival.*", F.col("i").alias("item")).alias("arrival")
    )


def _parsed(texts: DataFrame, item: Column) -> DataFrame:
    """Submissions out of JSON texts; what is no object drops out."""
    objects = texts.select(item.alias("item"), "arrival").where(F.ltrim("item").startswith("{"))
    return objects.select(F.from_json("item", schemas.SUBMISSION).alias("s"), "arrival").select("s.*", "arrival")


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """Record dumps: one `{"data": [submission, ...]}` per line."""
    return _parsed(_objects(spark, path, "data array<string>", "data"), F.col("item"))


def listings(spark: SparkSession, path: str) -> DataFrame:
    """Listing pages: `{"data": {"children": [{"data": submission}, ...]}}` per line."""
    children = _objects(spark, path, "data struct<children: array<string>>", "data.children")
    return _parsed(children, F.get_json_object("item", "$.data"))


def flat_submissions(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.SUBMISSION)


def comments(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.COMMENT)


def reviews(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.REVIEW)


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGE).parquet(path)


# Feeds -----------------------------------------------------------------------------------------
def atom_submissions(entries: DataFrame) -> DataFrame:
    """Feed entries to submission records."""
    links = F.filter(
        "link",
        lambda x: (x["_rel"].isNull() | (x["_rel"] == "alternate"))
        & (F.coalesce(x["_href"], F.lit("")) != ""),
    )
    href = F.try_element_at(links, F.lit(1))["_href"]
    markup = F.coalesce(blank_to_null(F.col("content._VALUE")), F.col("summary._VALUE"))
    when = F.coalesce(blank_to_null(F.col("updated")), F.col("published"))
    return entries.select(
        last_part(blank_to_null(F.col("id"))).alias("id"),
        "title",
        F.coalesce(blank_to_null(feed_text(markup)), F.col("title"), F.lit("")).alias("selftext"),
        F.try_element_at("category", F.lit(1))["_term"].alias("subreddit"),
        F.col("author.name").alias("author"),
        F.unix_timestamp(feed_timestamp(when)).cast("double").alias("created_utc"),
        permalink(href).alias("permalink"),
        href.alias("full_link"),
        *[c for c in entries.columns if c == "arrival"],
    )


def rss_submissions(items: DataFrame) -> DataFrame:
    """RSS items to submission records."""
    identifier = F.coalesce(blank_to_null(F.col("guid._VALUE")), blank_to_null(F.col("link")))
    terms = F.filter("category", lambda c: F.coalesce(c, F.lit("")) != "")
    return items.select(
        last_part(F.regexp_replace(identifier, "/+$", "")).alias("id"),
        "title",
        F.coalesce(blank_to_null(feed_text(F.col("description"))), F.col("title"), F.lit("")).alias("selftext"),
        F.try_element_at(terms, F.lit(1)).alias("subreddit"),
        "author",
        F.unix_timestamp(feed_timestamp(F.col("pubDate"))).cast("double").alias("created_utc"),
        permalink(F.col("link")).alias("permalink"),
        F.col("link").alias("full_link"),
        *[c for c in items.columns if c == "arrival"],
    )


def _xml(spark: SparkSession, path: str, tag: str, schema: T.StructType) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def atom_feed(spark: SparkSession, path: str) -> DataFrame:
    return atom_submissions(_with_arrival(_xml(spark, path, "entry", schemas.ATOM_ENTRY)))


def rss_feed(spark: SparkSession, path: str) -> DataFrame:
    return rss_submissions(_with_arrival(_xml(spark, path, "item", schemas.RSS_ITEM)))
