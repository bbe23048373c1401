"""Article extraction and link discovery over a table of crawled pages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from voxlake import constants as K
from voxlake.functions import urls
from voxlake.functions.html import read_article, read_links
from voxlake.functions.text import drop_tags, keyword_hits, normalize_keywords
from voxlake.operators.ranking import keep_first, top_n_per_group


def extract_articles(pages: DataFrame) -> DataFrame:
    """Adds page_title, page_author, page_published and page_content to each page.

    Only the markup goes to Python, and only the four texts come back.
    """
    names = ["page_title", "page_author", "page_published", "page_content"]

    def read(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_article(h) for h in html], columns=names)

    article = F.pandas_udf(read, T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return pages.withColumn("_article", article("html")).select(*pages.columns, "_article.*")


def page_links(pages: DataFrame, keywords: Sequence[str] | None = None) -> DataFrame:
    """One row per link of a page, with the keyword hits of the page's own text.

    The hits are counted before the pages go to Python, so that the text goes there once and only
    links come back.
    """
    words = normalize_keywords(keywords)
    ready = pages.select(
        "page_id", "url", "html", keyword_hits(drop_tags(F.col("html")), words).alias("page_hits")
    )
    schema = "page_id long, page_url string, position int, link string, anchor string, page_hits int"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in schema.split(", ")]
        for part in parts:
            rows = [
                (page_id, url, i, link, anchor, hits)
                for page_id, url, html, hits in part.itertuples(index=False, name=None)
                for i, (link, anchor) in enumerate(read_links(url, html))
            ]
            yield pd.DataFrame(rows, columns=columns)

    return ready.mapInPandas(run, schema)


def candidate_links(links: DataFrame, *, site: str = "site") -> DataFrame:
    """Article-shaped links to the host they were found on, each once per site, first place wins."""
    own = links.withColumn(site, urls.authority(F.col("page_url"))).where(
        urls.is_web_link(F.col("link"))
        & urls.same_host(F.col("page_url"), F.col("link"))
        & urls.looks_like_article(F.col("link"))
    )
    return keep_first(own, [site, "link"], [F.asc("page_id"), F.asc("position")])


def score_links(links: DataFrame, keywords: Sequence[str] | None = None) -> DataFrame:
    """Relevance: anchor text over page text over URL path; zero without keywords."""
    words = normalize_keywords(keywords)
    slug = F.regexp_replace(urls.path(F.col("link")), "-", " ")
    return links.withColumn(
        "score",
        (
            K.ANCHOR_WEIGHT * keyword_hits(F.col("anchor"), words)
            + K.PAGE_WEIGHT * F.col("page_hits")
            + K.PATH_WEIGHT * keyword_hits(slug, words)
        ).cast("long"),
    )


def first_links(links: DataFrame, *, per_site: int | None = None, site: str = "site") -> DataFrame:
    """Links in discovery order, at most `per_site` of a site (None: all); `place` starts at 1."""
    return top_n_per_group(
        links, [site], [F.asc("page_id"), F.asc("position")], per_site, rank="place",
    )


def ranked_links(scored: DataFrame, *, per_site: int | None = None, site: str = "site") -> DataFrame:
    """Links by relevance, every three ranked ones followed by one without hits.

    Only the first `per_site` of either kind can reach a place within the limit, so a very large
    site is cut down by all tasks before its places are worked out. For the same reason the sizes of
    the two kinds need only be known up to the limit, and are counted on what is left.
    """
    kinds = scored.withColumn("is_broad", F.col("score") <= 0)
    # Among links without hits discovery order alone counts.
    by_score = F.when(~F.col("is_broad"), F.col("score"))
    top = top_n_per_group(
        kinds, [site, "is_broad"],
        [F.desc_nulls_last(by_score), F.asc("page_id"), F.asc("position")], per_site, rank="_i",
    )
    of_site = Window.partitionBy(site)
    ranked = F.count_if(~F.col("is_broad")).over(of_site)
    broad = F.count_if("is_broad").over(of_site)
    i, block = F.col("_i") - 1, K.RANKED_PER_BROAD
    place = F.when(F.col("is_broad"), F.least(block * (i + 1), ranked) + i).otherwise(
        i + F.least(F.floor(i / block), broad)
    )
    placed = top.withColumn("place", (place + 1).cast("long")).drop("_i", "is_broad")
    return placed if per_site is None else placed.where(F.col("place") <= per_site)
