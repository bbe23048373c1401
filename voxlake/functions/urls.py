"""URL expressions, following the generic URI syntax."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from voxlake import constants as K
from voxlake.functions.text import blank_to_null, contains_any, strip

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
_HOST = r"^(?:.*@)?([^:]*)"
_PORT = r":(\d+)$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _AUTHORITY, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _QUERY, 1)


def drop_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"#.*$", "")


def _decode(c: Column) -> Column:
    # A percent sign that starts no escape stands for itself.
    return F.url_decode(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(c: Column) -> Column:
    # Form encoding differs from RFC 3986 in these two characters.
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, drop tracking parameters and the fragment."""
    u = strip(F.coalesce(url, F.lit("")))
    pairs = F.transform(
        F.filter(F.split(query(u), "&"), lambda p: p != ""),
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("k"),
            _decode(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, r"^[^=]*=", ""))
                    .otherwise("")).alias("v"),
        ),
    )
    kept = F.filter(
        pairs,
        lambda p: ~(F.lower(p["k"]).startswith(K.TRACKING_PREFIX)
                    | F.lower(p["k"]).isin(*K.TRACKING_PARAMS)),
    )
    params = F.array_join(F.transform(kept, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")
    host = F.lower(authority(u))
    return F.concat(
        F.when(scheme(u) != "", F.concat(scheme(u), F.lit(":"))).otherwise(""),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""),
        path(u),
        F.when(params != "", F.concat(F.lit("?"), params)).otherwise(""),
    )


def canonical_url(url: Column) -> Column:
    """Scheme, host, odd port and path only; NULL where the URL is not absolute."""
    u = strip(url)
    net = authority(u)
    host = F.lower(F.regexp_extract(net, _HOST, 1))
    port = F.regexp_extract(net, _PORT, 1).try_cast("int")
    bare = F.regexp_replace(F.regexp_replace(path(u), r";[^/]*$", ""), r"/+$", "")
    return F.when(
        (scheme(u) != "") & (host != ""),
        F.concat(
            scheme(u), F.lit("://"), host,
            F.when((port > 0) & ~port.isin(*K.DEFAULT_PORTS), F.concat(F.lit(":"), port.cast("string")))
            .otherwise(""),
            F.when(bare == "", F.lit("/")).otherwise(bare),
        ),
    )


def domain(url: Column) -> Column:
    """Host and port in lower case without a leading `www.`; NULL where there is none."""
    return blank_to_null(F.regexp_replace(strip(F.lower(authority(url))), r"^www\.", ""))


def site_homepage(site: Column) -> Column:
    """Configured site name to home page address; bad values stop the job."""
    cleaned = strip(F.coalesce(site, F.lit("")))
    full = F.when(cleaned.rlike(r"^https?://"), cleaned).otherwise(F.concat(F.lit("https://"), cleaned))
    return (
        F.when(cleaned == "", F.raise_error(F.lit("empty site value")))
        .when(authority(full) == "", F.raise_error(F.concat(F.lit("invalid site URL: "), cleaned)))
        .otherwise(F.concat(scheme(full), F.lit("://"), authority(full)))
    )


def is_web_link(url: Column) -> Column:
    return scheme(url).isin("http", "https")


def same_host(a: Column, b: Column) -> Column:
    return authority(a) == authority(b)


def looks_like_article(url: Column) -> Column:
    """At least two path parts, and a marker word, a year folder or a long slug."""
    p = F.regexp_replace(F.lower(path(url)), r"^/+|/+$", "")
    parts = F.filter(F.split(p, "/"), lambda s: s != "")
    slug = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return (F.size(parts) >= 2) & (
        contains_any(p, K.ARTICLE_PATH_MARKERS)
        | F.exists(parts, lambda s: s.rlike(r"^\d{4}$"))
        | (F.size(F.split(slug, "-")) >= 4)
    )


def is_non_editorial(url: Column, title: Column) -> Column:
    return contains_any(F.lower(F.coalesce(url, F.lit(""))), K.NON_EDITORIAL_URL_PARTS) | contains_any(
        F.lower(F.coalesce(title, F.lit(""))), K.NON_EDITORIAL_TITLE_MARKERS
    )


def is_blocked(status: Column, html: Column) -> Column:
    """Error responses and anti-bot pages."""
    return (
        status.isin(*K.BLOCKED_STATUS)
        | (status >= 400)
        | contains_any(F.lower(F.coalesce(html, F.lit(""))), K.ANTI_BOT_MARKERS)
    )


def last_part(url: Column) -> Column:
    """Text after the last slash."""
    return F.substring_index(url, "/", -1)


def permalink(url: Column, host: str = "reddit.com") -> Column:
    """What follows the first mention of the host."""
    return F.when(
        F.contains(url, F.lit(host)),
        F.substring(url, F.locate(host, url) + F.lit(len(host)), F.length(url)),
    )
