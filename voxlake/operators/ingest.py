"""Window, keyword and cap operators of the ingestion jobs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxlake.functions.dates import epoch_timestamp
from voxlake.functions.text import contains_any, normalize_keywords
from voxlake.operators.filters import within
from voxlake.operators.normalize import review_text, review_time
from voxlake.operators.ranking import keep_first, top_n_per_group


def in_epoch_window(df: DataFrame, start: int, end: int) -> DataFrame:
    """Closed window on `created_utc`; rows without a readable time stay."""
    return df.where(within(F.col("created_utc"), F.lit(start), F.lit(end), keep_undated=True))


def in_time_window(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Closed window on `created_at`; undated rows are rejected."""
    return df.where(within(F.col("created_at"), start, end, keep_undated=False))


def recent(created: Column, now: Column, days_back: int) -> Column:
    """Not older than so many days; negative numbers count as zero."""
    return created >= now - F.make_dt_interval(F.lit(max(days_back, 0)))


def post_text() -> Column:
    return F.lower(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("selftext", F.lit(""))))


def newest_per_community(posts: DataFrame, n: int | None = None) -> DataFrame:
    """The newest posts of each community (None: all), before any window is applied."""
    return top_n_per_group(
        posts, ["subreddit"], [F.desc_nulls_last("created_utc"), F.asc("id")], n
    )


def matched_posts(posts: DataFrame, keywords: Sequence[str], *, now: Column, days_back: int,
                  order: Sequence[Column]) -> DataFrame:
    """Recent posts with any of the phrases, once per id; no phrases, no posts."""
    words = normalize_keywords(keywords)
    if not words:
        return posts.limit(0)
    hits = posts.where(
        (F.coalesce("id", F.lit("")) != "")
        & recent(F.coalesce(epoch_timestamp(F.col("created_utc")), F.timestamp_seconds(F.lit(0))), now, days_back)
        & contains_any(post_text(), words)
    )
    return keep_first(hits, ["id"], order)


def comments_of(comments: DataFrame, posts: DataFrame, *, per_post: int | None = None,
                order: Sequence[Column]) -> DataFrame:
    """Comments of the given posts, at most `per_post` each (None: all); adds `parent_id`."""
    own = comments.withColumn("parent_id", F.regexp_replace("link_id", "^t3_", "")).join(
        posts.select(F.col("id").alias("parent_id")), "parent_id", "left_semi"
    )
    return top_n_per_group(own, ["parent_id"], order, None if per_post is None else max(per_post, 0))


def newest_reviews(reviews: DataFrame, keywords: Sequence[str], *, now: Column, days_back: int,
                   per_app: int | None = None) -> DataFrame:
    """The newest reviews of each app, first arrivals among equals; the cap comes before window and keywords."""
    newest = top_n_per_group(
        reviews.withColumn("_at", review_time()), ["app_id"],
        [F.desc_nulls_last("_at"), F.asc("arrival")], None if per_app is None else max(per_app, 1)
    )
    words = normalize_keywords(keywords)
    kept = newest.where(F.coalesce(recent(F.col("_at"), now, days_back), F.lit(True))).drop("_at")
    return kept.where(contains_any(F.lower(review_text()), words)) if words else kept


# Query grid ----------------------------------------------------------------------------------
def query_grid(spark: SparkSession, communities: Sequence[str], keywords: Sequence[str]) -> DataFrame:
    """Community by keyword, in job order; without keywords one blank query per community."""
    terms = [k for k in keywords if k and k.strip()] or [""]
    names = [c for c in communities if c and c.strip()]
    rows = [(i * len(terms) + j, c, t) for i, c in enumerate(names) for j, t in enumerate(terms)]
    return spark.createDataFrame(rows, "query_seq long, subreddit string, keyword string")


def grid_hits(posts: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """One row per post and keyword found in it. The blank query finds every post."""
    terms = [k for k in keywords if k and k.strip()] or [""]
    text = post_text()
    found = F.filter(
        F.array(*[F.lit(t) for t in terms]), lambda k: F.contains(text, F.lower(F.trim(k)))
    )
    return posts.withColumn("keyword", F.explode(found))


def capped_hits(hits: DataFrame, n: int | None = None) -> DataFrame:
    """The newest records of each query (None: all)."""
    return top_n_per_group(
        hits, ["subreddit", "keyword"], [F.desc_nulls_last("created_utc"), F.asc("id")], n,
    )


def keyword_or_recent(posts: DataFrame, keywords: Sequence[str], *, include_recent: bool) -> DataFrame:
    """Posts with a keyword; all posts of a community where none has one, if so wanted.

    Whether a community has a match is one small aggregate, joined back.
    """
    words = normalize_keywords(keywords)
    if not words:
        return posts
    marked = posts.withColumn("_match", contains_any(post_text(), words))
    if not include_recent:
        return marked.where("_match").drop("_match")
    per_community = marked.groupBy("subreddit").agg(F.max("_match").alias("_any"))
    return (
        marked.join(per_community, marked["subreddit"].eqNullSafe(per_community["subreddit"]))
        .drop(per_community["subreddit"])
        .where(F.col("_match") | ~F.col("_any"))
        .drop("_match", "_any")
    )


def query_counts(grid: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits of each query of the grid, zero where there are none."""
    found = hits.groupBy("subreddit", "keyword").agg(F.count("*").alias("hits"))
    return grid.join(found, ["subreddit", "keyword"], "left").withColumn(
        "hits", F.coalesce("hits", F.lit(0))
    )


def fetch_diagnostics(counts: DataFrame, fallback_hits: DataFrame) -> DataFrame:
    """One row of query statistics; `fallback_hits` has (subreddit, hits) of the recent-post fallback."""
    label = F.concat(
        F.lit("r/"), "subreddit", F.lit(" :: "),
        F.when(F.col("keyword") == "", F.lit("(blank)")).otherwise(F.col("keyword")),
    )
    named = counts.where("hits = 0").orderBy("query_seq").limit(5).select(F.struct("query_seq", label.alias("label")).alias("q"))
    first_five = F.coalesce(
        named.agg(F.sort_array(F.collect_list("q"))["label"]).scalar(), F.array().cast("array<string>"))
    per_query = counts.agg(
        F.count("*").alias("queries_attempted"),
        F.count_if(F.col("hits") > 0).alias("queries_with_hits"),
        F.sum("hits").alias("search_hits_total"),
    ).withColumn("failed_or_empty_queries_top5", first_five)
    with_hits = (
        counts.select("subreddit", "hits").unionByName(fallback_hits.select("subreddit", "hits"))
        .groupBy("subreddit").agg(F.sum("hits").alias("hits"))
        .agg(F.count_if(F.col("hits") > 0))
    )
    return per_query.select(
        "*",
        with_hits.scalar().alias("subreddits_with_hits"),
        F.coalesce(fallback_hits.agg(F.sum("hits")).scalar(), F.lit(0)).alias("new_fallback_hits_total"),
    )


def adapter_statistics(posts: DataFrame, matched: DataFrame, comments: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: posts seen and matched, comments seen, documents given out."""
    counted = {"posts_seen": posts, "posts_matched": matched, "comments_seen": comments, "documents_emitted": docs}
    one = posts.sparkSession.range(1)
    return one.select(*(df.agg(F.count("*")).scalar().alias(name) for name, df in counted.items()))


def review_statistics(reviews: DataFrame) -> DataFrame:
    """One row: apps and reviews seen."""
    return reviews.agg(F.count_distinct("app_id").alias("apps_seen"), F.count("*").alias("reviews_seen"))


# Source choice ---------------------------------------------------------------------------------
def first_with_rows(candidates: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of the first dataset that has any, as one plan; adds `backend`."""
    tagged = reduce(
        DataFrame.unionByName,
        [df.withColumn("backend", F.lit(name)).withColumn("_priority", F.lit(i)) for i, (name, df) in enumerate(candidates)],
    )
    return tagged.where(F.col("_priority") == tagged.agg(F.min("_priority")).scalar()).drop("_priority")
