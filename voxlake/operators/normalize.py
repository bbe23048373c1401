"""Landed records to canonical documents: projections only, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxlake import constants as K
from voxlake.functions.dates import epoch_timestamp, flexible_timestamp, iso_text
from voxlake.functions.keys import fallback_key
from voxlake.functions.text import blank_to_null, clean_whitespace, strip
from voxlake.functions.urls import domain, is_non_editorial
from voxlake.schemas import CANONICAL_DOC


def _payload(df: DataFrame) -> Column:
    """The landed record as JSON."""
    return F.to_json(F.struct(*[c for c in df.columns if c != "arrival"]))


def _metadata(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def _canonical(df: DataFrame, keep: tuple[str, ...], **columns: Column) -> DataFrame:
    """Project to the canonical schema; absent fields are NULL, `keep` columns pass through."""
    return df.select(
        *[
            columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in CANONICAL_DOC.fields
        ],
        *keep,
    )


def _post(df: DataFrame, url: Column, keep: tuple[str, ...]) -> DataFrame:
    content = F.coalesce(blank_to_null(F.col("selftext")), F.col("title"), F.lit(""))
    created = epoch_timestamp(F.col("created_utc"))
    # A missing title takes part in the key as the text "None".
    text = F.concat(F.coalesce("title", F.lit("None")), F.lit("\n"), content)
    return _canonical(
        df,
        keep,
        source=F.lit(K.REDDIT),
        platform=F.lit(K.REDDIT),
        external_id=F.col("id"),
        doc_type=F.lit("post"),
        entity_type=F.lit("post"),
        community_or_channel=blank_to_null(F.col("subreddit")),
        platform_metadata=_metadata(subreddit=blank_to_null(F.col("subreddit"))),
        author=F.col("author"),
        title=F.col("title"),
        content=content,
        created_at=created,
        url=url,
        dedupe_key=fallback_key(
            F.lit(K.REDDIT), F.col("id"), app_id=None, author=F.col("author"),
            created_at=iso_text(created), text=text,
        ),
        raw_payload=_payload(df),
    )


def posts(df: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Post objects: the link is the post's own `url`."""
    return _post(df, F.col("url"), keep)


def submissions(df: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Flat submissions: full link, else the permalink under the site's host."""
    link = F.concat(F.lit(K.SUBMISSION_HOST), blank_to_null(F.col("permalink")))
    return _post(df, F.coalesce(blank_to_null(F.col("full_link")), link), keep)


def comments(df: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Comments; an explicit `parent_id` wins over the one in `link_id`."""
    content = F.coalesce("body", F.lit(""))
    linked = F.regexp_replace("link_id", "^t3_", "")
    parent = F.coalesce(F.col("parent_id"), linked) if "parent_id" in df.columns else linked
    author = F.col("author.name")
    created = epoch_timestamp(F.col("created_utc"))
    return _canonical(
        df,
        keep,
        source=F.lit(K.REDDIT),
        platform=F.lit(K.REDDIT),
        external_id=F.col("id"),
        parent_external_id=parent,
        doc_type=F.lit("comment"),
        entity_type=F.lit("comment"),
        community_or_channel=blank_to_null(F.col("subreddit")),
        platform_metadata=_metadata(
            subreddit=blank_to_null(F.col("subreddit")), parent_external_id=parent
        ),
        author=author,
        content=content,
        created_at=created,
        url=F.concat(F.lit(K.SUBMISSION_HOST), blank_to_null(F.col("permalink"))),
        dedupe_key=fallback_key(
            F.lit(K.REDDIT), F.col("id"), app_id=None, author=author, created_at=iso_text(created),
            text=F.concat(F.coalesce(parent, F.lit("None")), F.lit("\n"), content),
        ),
        raw_payload=_payload(df),
    )


def review_time() -> Column:
    """Time of an app review: its timestamp, else its epoch seconds."""
    return F.coalesce(F.col("at"), epoch_timestamp(F.col("timestamp")))


def review_text() -> Column:
    return F.coalesce(blank_to_null(F.col("content")), F.col("userContent"), F.lit(""))


def reviews(df: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """App-store reviews."""
    content = strip(review_text())
    author = F.coalesce(blank_to_null(F.col("userName")), F.col("authorName"))
    created = review_time()
    page = F.concat(F.lit(K.APP_PAGE), F.col("app_id"))
    given_id = blank_to_null(F.col("reviewId"))
    return _canonical(
        df,
        keep,
        source=F.lit(K.GOOGLE_PLAY),
        platform=F.lit(K.GOOGLE_PLAY),
        external_id=F.col("reviewId"),
        doc_type=F.lit("review"),
        entity_type=F.lit("review"),
        community_or_channel=F.col("app_id"),
        platform_metadata=_metadata(
            app_id=F.col("app_id"),
            app_version=F.coalesce(blank_to_null(F.col("reviewCreatedVersion")), F.col("appVersion")),
            device=F.col("device"),
            os_version=F.col("osVersion"),
            thumbs_up_count=F.col("thumbsUpCount"),
            reply_content=F.col("replyContent"),
            replied_at=iso_text(F.col("repliedAt")),
        ),
        author=author,
        rating=F.col("score"),
        content=content,
        created_at=created,
        url=F.coalesce(F.concat(page, F.lit("&reviewId="), given_id), page),
        dedupe_key=fallback_key(
            F.lit(K.GOOGLE_PLAY), F.col("reviewId"), app_id=F.col("app_id"), author=author,
            created_at=iso_text(created), text=content,
        ),
        raw_payload=_payload(df),
    )


# Fields a crawled record may carry itself; they win over what the page says, but for `headline`.
_TITLE = (("title",), "page_title", ("headline",))
_AUTHOR = (("author", "byline"), "page_author", ())
_CONTENT = (("content", "body", "review_text"), "page_content", ())
_PUBLISHED = (("published_at", "published", "date"), "page_published", ())


def articles(df: DataFrame, *, min_content_chars: int = K.MIN_ARTICLE_CHARS,
             keep: tuple[str, ...] = ()) -> DataFrame:
    """Extracted articles (`page_*` columns, see `pages.extract_articles`) to documents.

    Listing pages and thin pages are rejected.
    """
    def pick(fields: tuple) -> Column:
        before, extracted, after = fields
        names = [n for n in (*before, extracted, *after) if n in df.columns]
        return F.coalesce(*[blank_to_null(F.col(n).cast("string")) for n in names], F.lit(None))

    url = blank_to_null(strip(F.coalesce("url", F.lit(""))))
    title = blank_to_null(clean_whitespace(pick(_TITLE)))
    author = blank_to_null(clean_whitespace(pick(_AUTHOR)))
    content = clean_whitespace(pick(_CONTENT))
    published = flexible_timestamp(pick(_PUBLISHED))
    site = domain(url)
    good = df.where(~is_non_editorial(url, title)).where(F.length(content) >= max(min_content_chars, 1))
    return _canonical(
        good,
        keep,
        source=F.lit(K.WEB_REVIEWS),
        platform=F.lit(K.WEB_REVIEWS),
        external_id=url,
        doc_type=F.lit("article"),
        entity_type=F.lit("review"),
        community_or_channel=site,
        platform_metadata=_metadata(site=site, subreddit_or_site=site),
        author=author,
        title=title,
        content=content,
        created_at=published,
        url=url,
        dedupe_key=fallback_key(
            F.lit(K.WEB_REVIEWS), url, app_id=site, author=author, created_at=iso_text(published),
            text=F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), content),
        ),
        raw_payload=F.to_json(F.struct(*[c for c in ("url", "html") if c in df.columns])),
    )


def stored_columns(docs: DataFrame, *, ingested_at: Column | None = None) -> DataFrame:
    """Canonical documents to the columns of the documents table.

    The whole record goes to `raw_json`, with the time of its ingestion; the fields that queries filter on become columns.
    """
    ingested = F.lit(None).cast("string") if ingested_at is None else iso_text(ingested_at)
    subreddit = F.when(F.col("platform") == K.REDDIT, F.col("community_or_channel"))
    return docs.select(
        "*",
        F.col("content").alias("body"),
        F.col("created_at").alias("published_at"),
        F.coalesce(F.try_element_at("platform_metadata", F.lit("subreddit")), subreddit).alias("subreddit"),
        F.to_json(
            F.struct(
                F.coalesce("platform", "source").alias("platform"),
                "rating",
                F.coalesce("entity_type", "doc_type").alias("entity_type"),
                "community_or_channel",
                "platform_metadata",
                ingested.alias("ingestion_ts"),
                "dedupe_key",
                "raw_payload",
            ),
            {"ignoreNullFields": "false"},
        ).alias("raw_json"),
    ).drop("content", "created_at", "platform_metadata", "raw_payload")
