"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from collections.abc import Sequence

from voxlake.functions.text import accents
from workload.views import PHRASES, TAXONOMY

# White space as the library sees it, and word characters, spelled out for RE2.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WORD = r"[\p{L}\p{N}_]"
_ACCENTS = accents()


# Expressions ---------------------------------------------------------------------------------
def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def day(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S+00:00')"


def clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_SPACE}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def deleted(x: str) -> str:
    return f"(lower({clean(x)}) IN ('', '[deleted]', '[removed]', 'deleted', 'removed', 'na', 'n/a'))"


def tokens(x: str) -> str:
    return f"regexp_extract_all(translate(lower(coalesce({x}, '')), '{_ACCENTS[0]}', '{_ACCENTS[1]}'), '[\\p{{L}}\\p{{N}}]+')"


def contains_any(x: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def hits(x: str, words: Sequence[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({x}), '{w}') AS INT)" for w in words) + ")"


def prefix_text(x: str) -> str:
    return f"lower({clean(x)})"


# Views ---------------------------------------------------------------------------------------
_DOCS = """documents_c AS (
  SELECT doc_id AS id, 1 + doc_id % 3 AS source_id, CAST(doc_id AS VARCHAR) AS external_id,
         split_part(text, chr(10), 1) AS title, text AS body, 'user' || (doc_id % 97) AS author,
         'https://' || platform || '.example.com/reviews/' || doc_id AS url,
         CASE WHEN doc_id % 11 <> 0 THEN TIMESTAMP '2024-01-01'
              + to_days(CAST(doc_id % 60 AS INTEGER)) + to_hours(CAST(doc_id % 24 AS INTEGER)) END AS published_at,
         TIMESTAMP '2024-03-15' AS created_at, lang AS subreddit, source AS community_or_channel,
         CASE WHEN doc_id % 6 <> 0 THEN doc_id % 6 END AS rating, platform
  FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'reddit' WHEN 1 THEN 'google_play' ELSE 'web_reviews' END AS platform
        FROM documents)),
docs_t AS (SELECT *, coalesce(published_at, created_at) AS event_time FROM documents_c)"""

_SOURCES = "sources_c AS (SELECT * FROM (VALUES (1, 'reddit'), (2, 'google_play'), (3, 'web_reviews')) v(id, name))"

_ENRICH = """enrichments_c AS (
  SELECT doc_id AS document_id, CASE WHEN doc_id % 7 = 0 THEN 'Summary of ' || doc_id END AS summary,
         CASE WHEN quality = 1 AND toxic = 1 THEN 'mixed' WHEN toxic = 1 THEN 'negative'
              WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label,
         CASE WHEN doc_id % 13 <> 0 THEN ['bug','performance','ux','pricing','support','integration','account',
              'reliability','other'][CAST(doc_id % 9 + 1 AS INTEGER)] END AS category,
         doc_id % 4 = 0 AS flag
  FROM labels)"""


def _tags_view(name: str, rows: str, types: Sequence[str]) -> str:
    """One branch per alias, so that each pattern is a constant."""
    text = f"CASE WHEN {deleted('text')} THEN '' ELSE lower({clean('text')}) END"
    branches = " UNION ".join(
        f"SELECT id AS document_id, '{t}' AS tag_type, '{c}' AS tag_value FROM {name}_text "
        f"WHERE contains(t, '{a}') AND regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_]){a}($|[^\\p{{L}}\\p{{N}}_])')"
        for t, c, a in TAXONOMY.entries if t in types
    )
    return f"{name}_text AS (SELECT id, {text} AS t FROM ({rows})), {name} AS ({branches})"


def _claims() -> str:
    """One step per phrase, longest first: the first place of each is marked, and gone for later ones."""
    border = f"[^\\p{{L}}\\p{{N}}_]"
    text = "concat_ws(' ', nullif(title, ''), nullif(body, ''))"
    steps = [f"claims_0 AS (SELECT id, [] :: VARCHAR[] AS found, CASE WHEN {deleted(text)} THEN '' ELSE lower({clean(text)}) END AS t FROM documents_c)"]
    for i, phrase in enumerate(sorted(PHRASES, key=len, reverse=True)):
        pattern = f"(^|{border}){phrase}($|{border})"
        steps.append(
            f"claims_{i + 1} AS (SELECT id, CASE WHEN regexp_matches(t, '{pattern}') THEN list_append(found, '{phrase}') ELSE found END AS found, "
            f"regexp_replace(t, '{pattern}', '\\1{'_' * len(phrase)}\\2') AS t FROM claims_{i})")
    words = f"list_filter(list_distinct(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+')), lambda w: regexp_full_match(w, '[a-z]{{3}}'))"
    return ", ".join(steps) + f", claims AS (SELECT id, unnest(list_concat(found, {words})) AS tag_value FROM claims_{len(PHRASES)})"


_TAGS = _tags_view(
    "tags_c", "SELECT id, concat_ws(' ', nullif(title, ''), nullif(body, '')) AS text FROM documents_c",
    ("product", "issue", "competitor", "feature"),
)
_INSTANT = "event_time >= TIMESTAMP '2024-01-10' AND event_time <= TIMESTAMP '2024-02-20'"
_DAYS = "CAST(event_time AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-02-20'"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + "\n"


_E = _with(
    _DOCS, _SOURCES, _ENRICH,
    f"rows AS (SELECT d.*, e.summary, e.label, e.category, e.flag FROM docs_t d JOIN enrichments_c e ON e.document_id = d.id WHERE {_INSTANT})",
    f"day_rows AS (SELECT d.*, e.label, e.category, e.flag FROM docs_t d JOIN enrichments_c e ON e.document_id = d.id WHERE {_DAYS})",
    f"left_rows AS (SELECT d.*, e.label, e.flag FROM docs_t d LEFT JOIN enrichments_c e ON e.document_id = d.id WHERE {_DAYS})",
)
_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE label = '{n}') AS {n}_count" for n in ("positive", "neutral", "negative", "mixed")
)
_TREND = f"SELECT {day('event_time')} AS day, {_COUNTS} FROM rows GROUP BY 1 ORDER BY 1 DESC LIMIT 14"
_SEVERITY = "CASE coalesce(label, 'neutral') WHEN 'negative' THEN 3 WHEN 'mixed' THEN 2 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 0 ELSE 1 END"
_TOP_FEATURES = """SELECT t.tag_value AS feature, count(*) AS count FROM rows r JOIN tags_c t ON t.document_id = r.id AND t.tag_type = 'feature'
WHERE r.flag GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
_TOP_CATEGORIES = "SELECT coalesce(category, 'other') AS category, count(*) AS count FROM rows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8"
_ET = _E.rstrip() + ",\n" + _TAGS + "\n"


def _day_counts(name: str, where: str = "true") -> str:
    return _E + f"SELECT {day('event_time')} AS day, count(*) AS {name} FROM rows WHERE {where} GROUP BY 1 ORDER BY 1 DESC LIMIT 14"


def _evidence(where: str, limit: int) -> str:
    return _E + f"""SELECT r.id AS doc_id, title, url, substr(coalesce(summary, body, ''), 1, 280) AS snippet,
  {ts('event_time')} AS date, s.name AS source, url AS evidence_url
FROM rows r JOIN sources_c s ON s.id = r.source_id WHERE {where} ORDER BY event_time DESC, r.id DESC LIMIT {limit}"""


def _ranked(where: str = "true", after: str = "true") -> str:
    return _E + f"""SELECT * FROM (
  SELECT id, {ts('event_time')} AS published_at, title, url, coalesce(category, 'other') AS issue_category,
         coalesce(label, 'neutral') AS sentiment_label, {_SEVERITY} AS severity_rank, sha256(body) AS body_hash
  FROM day_rows WHERE {where} ORDER BY severity_rank DESC, event_time DESC, id DESC LIMIT 100) WHERE {after}"""


_SHOWN = f"id, source_id, title, url, {ts('published_at')} AS published_at"


def _docs_where(where: str, *views: str) -> str:
    return _with(_DOCS, *views) + f"SELECT {_SHOWN} FROM docs_t d WHERE {where}"


def _has_tag(tag_type: str, *values: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"EXISTS (SELECT 1 FROM tags_c t WHERE t.document_id = d.id AND t.tag_type = '{tag_type}' AND t.tag_value IN ({listed}))"


# Full text -----------------------------------------------------------------------------------
def word(w: str) -> str:
    return f"len(list_filter({{t}}, lambda x: x = '{w}'))"


def prefix(p: str) -> str:
    return f"len(list_filter({{t}}, lambda x: starts_with(x, '{p}')))"


def phrase(*words: str) -> str:
    same = " AND ".join(f"{{t}}[i + {k}] = '{w}'" for k, w in enumerate(words))
    return f"len(list_filter(range(1, len({{t}}) + 1), lambda i: {same}))"


def scored(units: Sequence[str], where: str, *, weights: tuple[float, float] = (1.5, 1.8)) -> str:
    """Common table expressions ending in `scored`: matching documents with `fts_score`."""
    f = ", ".join(
        f"{weights[0]} * {u.format(t='tt')} + {weights[1]} * {u.format(t='tb')} AS f{i}" for i, u in enumerate(units)
    )
    n = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS n{i}" for i in range(len(units)))
    idf = [f"ln((n_docs - n{i} + 0.5) / (n{i} + 0.5))" for i in range(len(units))]
    score = " + ".join(
        f"(CASE WHEN {x} > 0 THEN {x} ELSE 1e-6 END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avg_dl))"
        for i, x in enumerate(idf)
    )
    return _with(
        _DOCS, _SOURCES,
        f"cut AS (SELECT id, {tokens('title')} AS tt, {tokens('body')} AS tb FROM documents_c)",
        f"freq AS (SELECT id, len(tt) + 2 * len(tb) AS dl, {f} FROM cut)",
        f"figures AS (SELECT CAST(count(*) AS DOUBLE) AS n_docs, sum(dl) / CAST(count(*) AS DOUBLE) AS avg_dl, {n} FROM freq)",
        f"scored AS (SELECT d.*, -({score}) AS fts_score FROM freq JOIN figures ON true JOIN docs_t d USING (id) WHERE {where})",
    )


def _search(units: Sequence[str], where: str, *, filters: str = "true", limit: int = 200, offset: int = 0,
            weights: tuple[float, float] = (1.5, 1.8)) -> str:
    return scored(units, where, weights=weights) + f"""SELECT id, source_id, title, url, {ts('published_at')} AS published_at, round(fts_score, 6) AS fts_score
FROM (SELECT * FROM scored WHERE {filters} ORDER BY fts_score, event_time DESC, id DESC LIMIT {limit} OFFSET {offset})"""


# Enrichment ----------------------------------------------------------------------------------
_WAITING = _with(
    _DOCS, _ENRICH,
    "waiting AS (SELECT * FROM documents_c WHERE id NOT IN (SELECT document_id FROM enrichments_c))",
    f"""ready AS (SELECT id AS document_id, platform, rating,
  concat_ws(chr(10) || chr(10), nullif({strip('title')}, ''), nullif({strip('body')}, '')) AS full_text FROM waiting)""",
    "cut AS (SELECT *, length(full_text) < 400 AS is_short, full_text AS text FROM ready)",
)


def _sentiment(text: str, rating: str) -> str:
    return f"""CASE WHEN {rating} <= 2 THEN 'negative' WHEN {rating} >= 4 THEN 'positive'
  WHEN {contains_any(f'lower({text})', ('bad', 'bug', 'crash', 'broken', 'hate'))} THEN 'negative'
  WHEN {contains_any(f'lower({text})', ('good', 'great', 'love', 'nice'))} THEN 'positive' ELSE 'neutral' END"""


_FALLBACK_PARTS = "sha256(concat_ws('|', {name}, {app}, {author}, {created}, {text}))"


def _fallback(name: str, *, app: str = "''", author: str = "''", created: str = "''", text: str) -> str:
    digest = _FALLBACK_PARTS.format(
        name=f"'{name}'" if name.isidentifier() and name != "platform" else name,
        app=f"lower({app})", author=f"lower({author})", created=created, text=text,
    )
    return digest


# URLs ----------------------------------------------------------------------------------------
_NET = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_QUERY = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"
_SCHEME = "regexp_extract(url, '^([a-z]+):', 1)"
_BARE = f"regexp_replace({_PATH}, '/+$', '')"
_CANONICAL = f"{_SCHEME} || '://' || lower({_NET}) || CASE WHEN {_BARE} = '' THEN '/' ELSE {_BARE} END"
_KEPT = f"array_to_string(list_filter(string_split({_QUERY}, '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_')), '&')"
_NORMALIZED = f"{_SCHEME} || '://' || lower({_NET}) || {_PATH} || CASE WHEN {_KEPT} <> '' THEN '?' || {_KEPT} ELSE '' END"
_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


def _article_shaped(path: str) -> str:
    p = f"regexp_replace(lower({path}), '^/+|/+$', '', 'g')"
    parts = f"list_filter(string_split({p}, '/'), lambda s: s <> '')"
    return f"""(len({parts}) >= 2 AND ({contains_any(p, ('review', 'reviews', 'article', 'news', 'features'))}
  OR len(list_filter({parts}, lambda s: regexp_full_match(s, '[0-9]{{4}}'))) > 0 OR len(string_split({parts}[-1], '-')) >= 4))"""


# Entities may lack their semicolon, as where a title was cut.
_UNESCAPE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '&quot;?', '\"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g')"
_ARTICLE = clean(_UNESCAPE.format(x="regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]+>', ' ', 'g')"))
_PAGE_TITLE = clean(_UNESCAPE.format(x=_TITLE))
_EDITORIAL = f"""({contains_any('lower(url)', ('/author/', '/authors/', '/category/', '/categories/', '/tag/', '/tags/', '/topic/', '/topics/', '/search', '/subscribe', '/membership', '/newsletter'))}
  OR {contains_any('lower({t})', ('authors', 'categories', 'tags', 'subscribe', 'newsletter', 'sign in', 'log in'))})"""

_WORDS = ("the", "ing", "que")
_LINKS = _with(
    r"""linked AS (SELECT page_id, url, replace(html, '<a href="/', '<a href="/reviews/') AS html FROM pages)""",
    rf"""anchors AS (SELECT page_id, url AS page_url, html, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
  unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text,
  unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)))) AS position,
  {hits("regexp_replace(html, '<[^>]+>', ' ', 'g')", _WORDS)} AS page_hits FROM linked)""",
    f"""links AS (SELECT page_id, page_url, position, {_SCHEME.replace('url', 'page_url')} || '://' || {_NET.replace('url', 'page_url')} || href AS link,
  {strip(_UNESCAPE.format(x='text'))} AS anchor, page_hits FROM anchors)""",
    f"""own AS (SELECT *, {_NET.replace('url', 'page_url')} AS site FROM links WHERE {_article_shaped(_PATH.replace('url', 'link'))}),
first_seen AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY site, link ORDER BY page_id, position) = 1)""",
    f"""scored AS (SELECT *, 6 * {hits('anchor', _WORDS)} + 3 * page_hits + {hits("replace(" + _PATH.replace('url', 'link') + ", '-', ' ')", _WORDS)} AS score FROM first_seen)""",
)

# Posts, comments, reviews --------------------------------------------------------------------
_CREATED = "to_timestamp(CAST(1704067200 + conv_id * 3600 + turn AS DOUBLE)) AT TIME ZONE 'UTC'"
_POSTS = f"""posts AS (SELECT conv_id, 'p' || conv_id AS id, CASE WHEN conv_id % 2 = 0 THEN split_part(text, chr(10), 1) END AS title,
  CASE WHEN conv_id % 3 <> 0 THEN text END AS selftext, 'c' || (conv_id % 7) AS subreddit, role AS author,
  1704067200 + conv_id * 3600 + turn AS epoch, {_CREATED} AS created_at
  FROM conversations WHERE turn = 0)"""
_COMMENTS = f"""comments AS (SELECT conv_id, turn, conv_id || '_' || turn AS id, text AS body, 'p' || conv_id AS parent_id,
  'c' || (conv_id % 7) AS subreddit, role AS author, 1704067200 + conv_id * 3600 + turn AS epoch, {_CREATED} AS created_at
  FROM conversations WHERE turn > 0)"""
_REVIEWS = _with(_DOCS, """reviews AS (SELECT id, community_or_channel AS app_id, CASE WHEN id % 9 <> 0 THEN 'r' || id END AS review_id, author,
  CASE WHEN id % 4 <> 0 AND body <> '' THEN body ELSE title END AS text, rating, published_at, subreddit AS device FROM documents_c)""")
_POST_TEXT = "lower(coalesce(title, '') || chr(10) || coalesce(selftext, ''))"
_CONTENT = "coalesce(nullif(selftext, ''), title, '')"


def _post_doc(key: str, external: str, url: str) -> str:
    return f"""SELECT {external} AS external_id, CAST(NULL AS VARCHAR) AS parent_external_id, 'post' AS doc_type, subreddit AS community_or_channel,
  author, CAST(NULL AS BIGINT) AS rating, title, sha256({_CONTENT}) AS content_hash, {ts('created_at')} AS created_at, {url} AS url, {key} AS dedupe_key FROM posts"""


def _recent_posts(days: int) -> str:
    return f"created_at >= TIMESTAMP '2024-01-05' - INTERVAL {days} DAY"


_FEED = r"regexp_replace(body, '[^\p{L}\p{N} .,]', ' ', 'g')"
_DATE_TEXT = """CASE id % 7 WHEN 0 THEN strftime(event_time, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN 'off' WHEN 2 THEN 'naive' WHEN 3 THEN 'day' WHEN 4 THEN 'epoch' END"""
_DATES = _with(_DOCS, f"""parsed AS (SELECT id, CASE id % 7 WHEN 0 THEN event_time WHEN 1 THEN event_time + INTERVAL 5 HOUR WHEN 2 THEN event_time
  WHEN 3 THEN date_trunc('day', event_time) WHEN 4 THEN event_time END AS created_at FROM docs_t)""")

_RUNS = _with("""runs AS (SELECT event_id AS run_id, event_type AS source_name, ts AS completed_at,
  CASE WHEN value < 2 THEN 'failed' ELSE 'completed' END AS status,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS records_fetched, CAST(floor(value) AS BIGINT) AS records_inserted, user_id FROM events)""")

_SENTIMENT_SUMMARY = f"""SELECT 'sentiment' AS module, printf('Sentiment insight: %d documents analyzed; negative=%d, positive=%d, neutral=%d, mixed=%d.',
  count(*), count(*) FILTER (WHERE label = 'negative'), count(*) FILTER (WHERE label = 'positive'),
  count(*) FILTER (WHERE label = 'neutral'), count(*) FILTER (WHERE label = 'mixed')) AS summary FROM rows"""

# Reviews as the refresh stores them: recent or undated, copies without id once.
_STORED_REVIEWS = _REVIEWS.rstrip() + f""",
kept AS (SELECT *, {prefix_text('text')} AS key_text FROM reviews
  WHERE published_at IS NULL OR published_at >= TIMESTAMP '2024-03-15 12:00:00' - INTERVAL 100 DAY),
stored_reviews AS (SELECT * FROM kept QUALIFY review_id IS NOT NULL
  OR row_number() OVER (PARTITION BY review_id, app_id, author, published_at, key_text ORDER BY id) = 1)"""

_LATE = "created_at >= TIMESTAMP '2024-03-15 12:00:00' - INTERVAL 100 DAY"
_STORED_POSTS = f"""{_POSTS}, {_COMMENTS},
grid_hits AS (SELECT * FROM posts, (VALUES ('the'), ('que la')) k(word) WHERE contains({_POST_TEXT}, word)),
grid AS (SELECT DISTINCT id FROM (SELECT id FROM grid_hits UNION ALL
  SELECT id FROM posts WHERE subreddit NOT IN (SELECT subreddit FROM grid_hits))),
matched AS (SELECT * FROM posts WHERE {_LATE} AND {contains_any(_POST_TEXT, ('the', 'que'))}),
more AS (SELECT id FROM posts WHERE {_LATE} AND id IN (SELECT id FROM matched) AND id NOT IN (SELECT id FROM grid)),
replies AS (SELECT * FROM comments WHERE parent_id IN (SELECT id FROM matched))"""

ORACLES: dict[str, str] = {
    "sentiment_totals": _E + f"SELECT count(*) AS total_docs, {_COUNTS} FROM rows",
    "sentiment_daily_trend": _E + _TREND,
    "sentiment_trend_long": _E + f"""SELECT day, replace(sentiment, '_count', '') AS sentiment, count FROM
(UNPIVOT ({_TREND}) ON positive_count, neutral_count, negative_count, mixed_count INTO NAME sentiment VALUE count)""",
    "complaint_total": _E + "SELECT count(*) AS complaint_docs FROM rows",
    "complaint_categories": _E + _TOP_CATEGORIES,
    "complaint_daily_trend": _day_counts("complaint_count"),
    "feature_total": _E + "SELECT count(*) AS feature_request_docs FROM rows WHERE flag",
    "top_features": _ET + _TOP_FEATURES,
    "feature_daily_trend": _day_counts("feature_request_count", "flag"),
    "daily_metrics": _E + f"SELECT {day('event_time')} AS day, count(*) AS docs, {_COUNTS}, count(*) FILTER (WHERE flag) AS feature_requests FROM rows GROUP BY 1",
    "evidence_negative": _evidence("label IN ('negative', 'mixed')", 8),
    "evidence_features": _evidence("flag", 20),
    "insight_summaries": _ET + f"""{_SENTIMENT_SUMMARY}
UNION ALL SELECT 'complaints', printf('Complaints insight: %d complaint-like documents, with top issue category ''%s''.', count(*),
  coalesce((SELECT category FROM ({_TOP_CATEGORIES}) LIMIT 1), 'none')) FROM rows
UNION ALL SELECT 'feature_requests', printf('Feature request insight: %d feature request documents, top requested feature ''%s''.', count(*),
  coalesce((SELECT feature FROM ({_TOP_FEATURES}) LIMIT 1), 'none')) FROM rows WHERE flag""",
    "dashboard_kpis": _E + """SELECT count(*) AS total_docs, count(DISTINCT subreddit) AS subreddits,
  count(*) FILTER (WHERE label = 'negative') AS negative_docs, count(*) FILTER (WHERE coalesce(flag, false)) AS feature_requests FROM left_rows""",
    "volume_by_day": _E + f"SELECT {day('event_time')} AS day, count(*) AS docs FROM docs_t GROUP BY 1",
    "sentiment_split": _E + "SELECT coalesce(label, 'unknown') AS sentiment, count(*) AS count FROM left_rows GROUP BY 1",
    "ranked_complaints": _ranked(),
    "ranked_complaints_by_category": _ranked("coalesce(category, 'other') = 'other'"),
    "ranked_complaints_then_category": _ranked(after="issue_category = 'bug'"),
    "complaint_category_choices": f"SELECT DISTINCT issue_category FROM ({_ranked()})",
    "date_bounds": _with(_DOCS) + f"SELECT {day('min(event_time)')} AS min_date, {day('max(event_time)')} AS max_date FROM docs_t",
    "facets": _with(_DOCS, _SOURCES, _TAGS) + """SELECT DISTINCT * FROM (
  SELECT 'source' AS kind, name AS value FROM sources_c
  UNION ALL SELECT 'subreddit', subreddit FROM documents_c
  UNION ALL SELECT 'web_domain', community_or_channel FROM documents_c WHERE platform = 'web_reviews'
  UNION ALL SELECT 'google_play_app', community_or_channel FROM documents_c WHERE platform = 'google_play'
  UNION ALL SELECT 'rating', CAST(rating AS VARCHAR) FROM documents_c WHERE platform = 'google_play' AND rating BETWEEN 1 AND 5
  UNION ALL SELECT tag_type, tag_value FROM tags_c) WHERE coalesce(value, '') <> ''""",
    "filter_sources": _docs_where("platform IN ('reddit', 'google_play')"),
    "filter_community": _docs_where("subreddit = 'fr'"),
    "filter_domain": _docs_where("platform = 'web_reviews' AND community_or_channel = 'src3'"),
    "filter_app": _docs_where("platform = 'google_play' AND community_or_channel = 'src8'"),
    "filter_rating": _docs_where("rating = 4"),
    "filter_tags": _docs_where(
        " AND ".join([_has_tag("product", "this", "with"), _has_tag("feature", "tion"), _has_tag("issue", "from")]), _TAGS),
    "filter_sentiment": _docs_where("EXISTS (SELECT 1 FROM enrichments_c e WHERE e.document_id = d.id AND e.label = 'mixed')", _ENRICH),
    "date_strict_instant": _docs_where("published_at >= TIMESTAMP '2024-01-10' AND published_at <= TIMESTAMP '2024-02-20'"),
    "date_coalesced_instant": _docs_where("event_time >= TIMESTAMP '2024-02-20' AND event_time <= TIMESTAMP '2024-03-15'"),
    "date_coalesced_day": _docs_where(_DAYS),
    "dates_from_store": _with(_DOCS) + f"""SELECT id, title, {ts('published_at')} AS published_at, mode FROM (
  SELECT *, 'coalesced_day' AS mode FROM docs_t WHERE {_DAYS}
  UNION ALL SELECT *, 'strict_instant' FROM docs_t WHERE published_at >= TIMESTAMP '2024-01-10' AND published_at <= TIMESTAMP '2024-02-20'
  UNION ALL SELECT *, 'coalesced_instant' FROM docs_t WHERE event_time >= TIMESTAMP '2024-02-20' AND event_time <= TIMESTAMP '2024-03-15')""",
    "enrichment_promotion": _with(_ENRICH) + "SELECT document_id, label AS sentiment_label, category AS primary_issue_category, flag AS feature_request_flag FROM enrichments_c",
    "browse_page": _with(_DOCS) + f"SELECT {_SHOWN} FROM docs_t WHERE platform = 'reddit' ORDER BY event_time DESC, id DESC LIMIT 50 OFFSET 20",
    "browse_after": _with(_DOCS) + f"SELECT {_SHOWN} FROM docs_t WHERE platform = 'reddit' ORDER BY event_time DESC, id DESC LIMIT 50 OFFSET 20",
    "search_after_last": _search([word("anble"), word("inble")], "f0 > 0 OR f1 > 0", limit=25, offset=50),
    "insights_from_rollup": _E + f"SELECT {day('event_time')} AS day, count(*) AS docs, {_COUNTS}, count(*) FILTER (WHERE flag) AS feature_requests FROM rows GROUP BY 1",
    "features_from_rollup": _ET + _TOP_FEATURES,
    "fetch_by_ids": _with(_DOCS) + """SELECT id, title, url, position FROM documents_c
JOIN (SELECT conv_id AS id, min(turn * 1000000 - conv_id) AS position FROM conversations GROUP BY 1) USING (id)""",
    "search_all": _search([word("anble"), word("inble")], "f0 > 0 AND f1 > 0"),
    "search_any": _search([word("anble"), word("inble"), word("reble")], "f0 > 0 OR f1 > 0 OR f2 > 0"),
    "search_not": _search([word("anble"), word("inble")], "f0 > 0 AND NOT f1 > 0"),
    "search_prefix": _search([prefix("anb")], "f0 > 0"),
    "search_phrase": _search([phrase("the", "and")], "f0 > 0"),
    "search_column": _search([word("anble")], "f0 > 0", weights=(1.5, 0.0)),
    "search_filtered_page": _search(
        [word("anble"), word("inble")], "f0 > 0 OR f1 > 0", limit=30, offset=10,
        filters="published_at >= TIMESTAMP '2024-01-10' AND published_at <= TIMESTAMP '2024-02-20' AND platform IN ('reddit', 'web_reviews')"),
    "search_indexed": _search([word("anble"), word("reble"), word("inble")], "(f0 > 0 OR f1 > 0) AND NOT f2 > 0"),
    "search_written_index": _search([word("anble"), word("reble"), word("inble")], "(f0 > 0 OR f1 > 0) AND NOT f2 > 0"),
    "search_top_k": _search([word("anble"), word("reble"), word("inble")], "(f0 > 0 OR f1 > 0) AND NOT f2 > 0", limit=20),
    "search_top_filtered": _search(
        [word("anble"), word("inble")], "f0 > 0 OR f1 > 0", limit=30, offset=10,
        filters="published_at >= TIMESTAMP '2024-01-10' AND published_at <= TIMESTAMP '2024-02-20' AND platform IN ('reddit', 'web_reviews')"),
    "search_after_merge": _search([word("anble"), word("reble"), word("inble")], "(f0 > 0 OR f1 > 0) AND NOT f2 > 0"),
    "search_written_prefix": _search([prefix("anb")], "f0 > 0"),
    "search_after_insert": _search([phrase("the", "and")], "f0 > 0"),
    "index_terms": _with(
        _DOCS,
        f"words AS (SELECT id, unnest({tokens('title')}) AS term, generate_subscripts({tokens('title')}, 1) - 1 AS position FROM documents_c "
        f"UNION ALL SELECT id, unnest({tokens('body')}), generate_subscripts({tokens('body')}, 1) - 1 FROM documents_c)",
    ) + "SELECT term, count(DISTINCT id) AS n_docs, count(*) AS occurrences, min(position) AS first_position FROM words GROUP BY 1",
    "answer_evidence": scored([word("anble"), word("reble")], "f0 > 0 AND f1 > 0") + f"""SELECT id, {day('event_time')} AS date,
  CASE WHEN platform = 'reddit' THEN 'unknown' ELSE platform END AS source, url,
  substr({strip("replace(coalesce(nullif(body, ''), title, ''), chr(10), ' ')")}, 1, 280) AS snippet, {strip("coalesce(title, '')")} AS title
FROM (SELECT * FROM scored ORDER BY fts_score, event_time DESC, id DESC LIMIT 40)""",
    "cited_evidence": f"""SELECT conv_id, turn, insufficient_evidence,
  CASE WHEN insufficient_evidence THEN 'Based on Reddit data in selected filters.' || chr(10) || chr(10) || 'Insufficient evidence to answer confidently.'
       WHEN role = 'user' THEN 'Based on Reddit data in selected filters.' || chr(10) || chr(10) || 'No grounded answer available.'
       ELSE 'Answer ' || conv_id END AS answer,
  CASE WHEN insufficient_evidence THEN '' ELSE array_to_string(list_filter([{strip('x')} FOR x IN string_split(text, chr(10))], lambda x: x <> ''), '|') END AS key_points,
  CASE WHEN turn % 3 = 2 THEN 'Question is empty.' WHEN turn < 2 THEN 'Insufficient evidence in selected filters.' ELSE role END AS caveats,
  '' AS contradictions, CASE WHEN insufficient_evidence THEN '' ELSE turn || '|1|' || turn END AS cited_evidence_ids,
  CASE WHEN turn > 0 THEN array_to_string(range(1, turn + 1), '|') ELSE '' END AS evidence_ids
FROM (SELECT *, turn % 3 = 2 OR turn < 2 OR {strip('text')} = '' AS insufficient_evidence FROM conversations)""",
    "tag_all": _with(_DOCS, _TAGS) + "SELECT document_id, tag_type, tag_value, 'rules' AS tag_source, CAST(1.0 AS DOUBLE) AS confidence FROM tags_c",
    "tag_overlapping": _with(_DOCS, _claims())
    + "SELECT id AS document_id, 'feature' AS tag_type, tag_value, 'rules' AS tag_source, CAST(1.0 AS DOUBLE) AS confidence FROM claims",
    "tag_competitors": _with(_tags_view("t", "SELECT conv_id * 100 + turn AS id, text FROM conversations", ("competitor",)))
    + "SELECT document_id, tag_type, tag_value, 'rules' AS tag_source, CAST(NULL AS DOUBLE) AS confidence FROM t",
    "enrich_candidates": _WAITING + "SELECT id, title, platform, rating FROM waiting",
    "enrich_first_batch": _WAITING + "SELECT id, platform FROM waiting ORDER BY id LIMIT 100",
    "rule_enrichment": _WAITING + f"""SELECT document_id, 'fallback_rules' AS model_name, substr(text, 1, 300) AS summary,
  {_sentiment('text', 'rating')} AS sentiment_label, 'other' AS primary_issue_category, false AS feature_request_flag,
  '' AS competitor_mentions, rating FROM cut WHERE is_short""",
    "scored_by_plugin": _WAITING + f"""SELECT document_id, 'rules' AS model_name, substr({strip('text')}, 1, 400) AS summary,
  {_sentiment('text', "(CASE WHEN platform = 'google_play' THEN rating END)")} AS sentiment_label, 'other' AS primary_issue_category,
  false AS feature_request_flag, '' AS competitor_mentions, 'enriched' AS status FROM cut WHERE NOT is_short""",
    "enrichment_stats": _WAITING + """SELECT count(*) AS candidates, count(*) AS enriched, count(*) FILTER (WHERE is_short) AS skipped_short,
  CAST(0 AS BIGINT) AS failed_batches FROM cut""",
    "classifier_reply_clean": f"""SELECT doc_id AS document_id, 'model-a' AS model_name, substr({strip("'  ' || text")}, 1, 400) AS summary,
  ['positive', 'negative', 'mixed', 'neutral', 'neutral'][CAST(doc_id % 5 + 1 AS INTEGER)] AS sentiment_label,
  ['bug', 'ux', 'other', 'other'][CAST(doc_id % 4 + 1 AS INTEGER)] AS primary_issue_category, doc_id % 3 = 0 AS feature_request_flag,
  'Acme|' || lang || '|' || source AS competitor_mentions FROM documents WHERE doc_id % 17 <> 0""",
    "dedupe_fallback_key": _with(_DOCS) + f"""SELECT id, CASE WHEN platform <> 'reddit' THEN platform || ':fallback:' ||
  {_fallback('platform', app='community_or_channel', author='author', created=f"coalesce({iso('published_at')}, '')", text=prefix_text('body'))} END AS dedupe_key FROM documents_c""",
    "dedupe_first_wins": """SELECT doc_id, source, dedupe_key FROM (SELECT *, CASE WHEN lang <> 'es' THEN sha256(text) END AS dedupe_key FROM documents)
QUALIFY dedupe_key IS NULL OR row_number() OVER (PARTITION BY dedupe_key ORDER BY doc_id) = 1""",
    "dedupe_against_store": _with(
        _DOCS,
        "keyed AS (SELECT id, source_id, CASE WHEN source_id <> 2 THEN sha256(title) END AS external_id, CASE WHEN source_id <> 1 THEN sha256(body) END AS dedupe_key FROM documents_c)",
        "stored AS (SELECT * FROM keyed WHERE id IN (SELECT doc_id FROM labels))",
        "s1 AS (SELECT * FROM keyed QUALIFY dedupe_key IS NULL OR row_number() OVER (PARTITION BY dedupe_key ORDER BY id) = 1)",
        "s2 AS (SELECT * FROM s1 WHERE NOT EXISTS (SELECT 1 FROM stored t WHERE t.dedupe_key = s1.dedupe_key))",
        "s3 AS (SELECT * FROM s2 QUALIFY external_id IS NULL OR row_number() OVER (PARTITION BY source_id, external_id ORDER BY id) = 1)",
    ) + "SELECT * FROM s3 WHERE NOT EXISTS (SELECT 1 FROM stored t WHERE t.source_id = s3.source_id AND t.external_id = s3.external_id)",
    "web_dedupe_key": f"""SELECT page_id, 'web_reviews:canonical:' || sha256('web_reviews|' || {_CANONICAL} || '|' ||
  sha256(concat_ws(' ', nullif({strip(f'lower({_TITLE})')}, ''), nullif({strip('lower(html)')}, '')))) AS dedupe_key FROM pages""",
    "url_forms": f"""SELECT page_id, {_NORMALIZED} AS normalized, {_CANONICAL} AS canonical, regexp_replace(lower({_NET}), '^www\\.', '') AS domain,
  {_SCHEME} || '://' || {_NET} AS homepage, string_split({_PATH}, '/')[-1] AS last_part FROM pages""",
    "editorial_pages": f"SELECT page_id, {_EDITORIAL.format(t=_TITLE)} AS non_editorial, {_article_shaped(_PATH)} AS article_shaped FROM pages",
    "blocked_pages": f"""SELECT page_id, [200, 404, 403, 200, 429, 500, 301][CAST(page_id % 7 + 1 AS INTEGER)] >= 400
  OR {contains_any('lower(html)', ('captcha', 'access denied', 'verify you are human', 'cloudflare', 'bot detection'))} AS blocked FROM pages""",
    "extract_articles": f"""SELECT page_id, {_PAGE_TITLE} AS page_title, CAST(NULL AS VARCHAR) AS page_author, CAST(NULL AS VARCHAR) AS page_published,
  sha256({_ARTICLE}) AS content_hash, length({_ARTICLE}) AS n_chars FROM pages""",
    "articles_normalized": f"""SELECT url AS external_id, regexp_replace(lower({_NET}), '^www\\.', '') AS community_or_channel, 'article' AS doc_type,
  {_PAGE_TITLE} AS title, length({_ARTICLE}) AS n_chars FROM pages WHERE length({_ARTICLE}) >= 500 AND NOT {_EDITORIAL.format(t=_PAGE_TITLE)}""",
    "page_links": _LINKS + "SELECT page_id, page_url, position, link, anchor, page_hits FROM links",
    "link_scores": _LINKS + "SELECT site, link, page_id, position, anchor, score FROM scored",
    "link_order": _LINKS + """SELECT site, link, score, place FROM (
  SELECT *, 1 + CASE WHEN score > 0 THEN i + least(i // 3, broad) ELSE least(3 * (i + 1), ranked) + i END AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY site, score > 0 ORDER BY CASE WHEN score > 0 THEN -score END, page_id, position) - 1 AS i,
      count(*) FILTER (WHERE score > 0) OVER (PARTITION BY site) AS ranked, count(*) FILTER (WHERE score <= 0) OVER (PARTITION BY site) AS broad
    FROM scored)) WHERE place <= 12""",
    "link_discovery_order": _LINKS + "SELECT site, link, row_number() OVER (PARTITION BY site ORDER BY page_id, position) AS place FROM scored QUALIFY place <= 12",
    "submissions_normalized": _with(_POSTS) + _post_doc(
        "CAST(NULL AS VARCHAR)", "id", "CASE WHEN conv_id % 5 = 0 THEN 'https://reddit.com/full' ELSE 'https://reddit.com/r/' || subreddit || '/' || conv_id END"),
    "posts_normalized": _with(_POSTS) + _post_doc(
        "'reddit:fallback:' || " + _fallback("reddit", author="author", created=iso("created_at"),
                                             text=prefix_text(f"coalesce(title, 'None') || chr(10) || {_CONTENT}")),
        "CAST(NULL AS VARCHAR)", "'https://reddit.com/p/' || conv_id"),
    "comments_normalized": _with(_COMMENTS) + f"""SELECT id AS external_id, parent_id AS parent_external_id, 'comment' AS doc_type, subreddit AS community_or_channel,
  author, CAST(NULL AS BIGINT) AS rating, CAST(NULL AS VARCHAR) AS title, sha256(body) AS content_hash, {ts('created_at')} AS created_at,
  CASE WHEN turn <> 2 THEN 'https://reddit.com/c/' || conv_id END AS url, CAST(NULL AS VARCHAR) AS dedupe_key FROM comments""",
    "reviews_normalized": _REVIEWS + f"""SELECT review_id AS external_id, CAST(NULL AS VARCHAR) AS parent_external_id, 'review' AS doc_type,
  app_id AS community_or_channel, author, rating, CAST(NULL AS VARCHAR) AS title, sha256({strip('text')}) AS content_hash, {ts('published_at')} AS created_at,
  'https://play.google.com/store/apps/details?id=' || app_id || coalesce('&reviewId=' || review_id, '') AS url,
  CASE WHEN review_id IS NULL THEN 'google_play:fallback:' || {_fallback('google_play', app='app_id', author='author', created=f"coalesce({iso('published_at')}, '')", text=prefix_text('text'))} END AS dedupe_key,
  app_id, '1.0' AS app_version, device, CAST(id % 50 AS VARCHAR) AS thumbs_up_count FROM reviews""",
    "stored_documents": _with(_POSTS) + """SELECT id AS external_id, subreddit, 'reddit' AS platform, 'post' AS entity_type, subreddit AS meta_subreddit,
  CAST(NULL AS VARCHAR) AS rating FROM posts""",
    "post_comments_capped": _with(_COMMENTS) + """SELECT id, parent_id, CAST(epoch AS DOUBLE) AS created_utc FROM
(SELECT * FROM comments QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY turn) <= 3) WHERE subreddit IN ('c1', 'c2', 'c3')""",
    "post_docs_union": _with(
        _POSTS, _COMMENTS,
        f"newest AS (SELECT * FROM posts QUALIFY row_number() OVER (PARTITION BY subreddit ORDER BY epoch DESC, id) <= 40)",
        f"matched AS (SELECT * FROM posts WHERE {_recent_posts(3)} AND {contains_any(_POST_TEXT, ('the', 'que'))})",
    ) + f"""SELECT id AS external_id, CAST(NULL AS VARCHAR) AS parent_external_id, 'post' AS doc_type, subreddit AS community_or_channel
FROM newest WHERE {_recent_posts(3)} AND id IN (SELECT id FROM matched)
UNION ALL SELECT id, parent_id, 'comment', subreddit FROM (SELECT * FROM comments QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY turn) <= 2)
WHERE parent_id IN (SELECT id FROM matched)""",
    "adapter_statistics": _REVIEWS.rstrip() + f""", {_POSTS}, {_COMMENTS},
matched AS (SELECT * FROM posts WHERE {_recent_posts(3)} AND {contains_any(_POST_TEXT, ('the', 'que'))}),
replies AS (SELECT * FROM comments WHERE parent_id IN (SELECT id FROM matched))
SELECT (SELECT count(*) FROM posts) AS posts_seen, (SELECT count(*) FROM matched) AS posts_matched, (SELECT count(*) FROM replies) AS comments_seen,
  (SELECT count(*) FROM matched) + (SELECT count(*) FROM replies) AS documents_emitted,
  count(DISTINCT app_id) AS apps_seen, count(*) AS reviews_seen FROM reviews""",
    "keyword_search": _with(_POSTS) + f"""SELECT id, subreddit, CAST(epoch AS DOUBLE) AS created_utc FROM posts
WHERE {_recent_posts(2)} AND {contains_any(_POST_TEXT, ('que la', 'the'))}""",
    "review_ingest_capped": _REVIEWS + f"""SELECT app_id, review_id AS "reviewId", author AS "userName", rating AS score, id AS arrival FROM
(SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY published_at DESC NULLS LAST, id) <= 30)
WHERE (published_at IS NULL OR published_at >= TIMESTAMP '2024-02-25' - INTERVAL 40 DAY) AND {contains_any('lower(text)', ('the', 'la'))}""",
    "epoch_window": _with(_DOCS) + """SELECT external_id AS id, CAST(epoch(published_at) AS DOUBLE) AS created_utc FROM documents_c
WHERE published_at IS NULL OR epoch(published_at) BETWEEN 1705276800 AND 1706745600""",
    "keyword_or_recent": _with(
        _DOCS,
        f"""p AS (SELECT external_id AS id, concat_ws('-', community_or_channel, author) AS subreddit,
  {contains_any("lower(coalesce(title, '') || chr(10) || coalesce(body, ''))", ('the and', 'que la'))} AS hit FROM documents_c)""",
    ) + "SELECT id, subreddit FROM (SELECT *, bool_or(hit) OVER (PARTITION BY subreddit) AS any_hit FROM p) WHERE hit OR NOT any_hit",
    "query_grid_diagnostics": _with(
        _DOCS,
        "grid AS (SELECT c.i * 3 + k.j AS seq, c.name AS subreddit, k.word FROM (SELECT unnest(range(21)) AS i, unnest(['src' || x FOR x IN range(20)] || ['nowhere']) AS name) c, (VALUES (0, 'que la'), (1, 'anble'), (2, 'zzz')) k(j, word))",
        "counts AS (SELECT g.seq, g.subreddit, g.word, count(d.id) AS hits FROM grid g LEFT JOIN documents_c d ON d.community_or_channel = g.subreddit AND contains(lower(coalesce(d.title, '') || chr(10) || coalesce(d.body, '')), g.word) GROUP BY 1, 2, 3)",
        "fallback AS (SELECT community_or_channel AS subreddit, count(*) AS hits FROM documents_c WHERE community_or_channel = 'src1' GROUP BY 1)",
    ) + """SELECT count(*) AS queries_attempted, count(*) FILTER (WHERE hits > 0) AS queries_with_hits, CAST(sum(hits) AS BIGINT) AS search_hits_total,
  (SELECT string_agg(label, '|' ORDER BY seq) FROM (SELECT seq, 'r/' || subreddit || ' :: ' || word AS label FROM counts WHERE hits = 0 ORDER BY seq LIMIT 5)) AS failed_or_empty_queries_top5,
  (SELECT count(DISTINCT subreddit) FROM (SELECT subreddit, hits FROM counts UNION ALL SELECT * FROM fallback) WHERE hits > 0) AS subreddits_with_hits,
  (SELECT CAST(coalesce(sum(hits), 0) AS BIGINT) FROM fallback) AS new_fallback_hits_total FROM counts""",
    "per_query_cap": _with(
        _DOCS,
        "hits AS (SELECT community_or_channel AS subreddit, word AS keyword, external_id AS id, published_at FROM documents_c, (VALUES ('the'), ('la')) k(word) WHERE contains(lower(coalesce(title, '') || chr(10) || coalesce(body, '')), word))",
    ) + "SELECT subreddit, keyword, id FROM hits QUALIFY row_number() OVER (PARTITION BY subreddit, keyword ORDER BY published_at DESC NULLS LAST, id) <= 25",
    "source_priority": "SELECT 'items' AS backend, item_id AS id, sha256(text) AS text_hash FROM benchmark",
    "atom_entries": _with(_DOCS) + f"""SELECT external_id AS id, 'Post ' || external_id AS title,
  sha256(CASE WHEN id % 7 <> 0 THEN {clean(_FEED + " || ' & more'")} ELSE 'Post ' || external_id END) AS selftext, subreddit, author,
  CAST(epoch(event_time) AS BIGINT) AS created_utc, '/r/a/' || external_id AS permalink, 'https://www.reddit.com/r/a/' || external_id AS full_link FROM docs_t""",
    "rss_items": _with(_DOCS) + f"""SELECT external_id AS id, 'Item ' || external_id AS title,
  sha256(coalesce(nullif({clean(_FEED)}, ''), 'Item ' || external_id)) AS selftext, subreddit, author,
  CAST(epoch(event_time) - CASE WHEN id % 2 = 0 THEN 0 ELSE 7200 END AS BIGINT) AS created_utc, '/r/b/' || external_id || '/' AS permalink,
  'https://www.reddit.com/r/b/' || external_id || '/' AS full_link FROM docs_t""",
    "flexible_dates": _DATES + f"SELECT id, {ts('created_at')} AS created_at, {day('created_at')} AS day, {iso('created_at')} AS iso FROM parsed",
    "ingest_window": _DATES + f"SELECT id, {ts('created_at')} AS created_at FROM parsed WHERE created_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-02-01 05:00:00'",
    "clean_text": f"""SELECT id, sha256({clean('text')}) AS cleaned, {deleted('text')} AS deleted,
  CASE WHEN {deleted('text')} THEN 0 ELSE length(lower({clean('text')})) END AS tagging_chars, {hits('text', ('the', 'que', 'und'))} AS hits FROM (
  SELECT doc_id AS id, text FROM documents UNION ALL
  SELECT -conv_id * 100 - turn - 1, CASE turn WHEN 3 THEN ' [Removed]' || chr(10) WHEN 4 THEN 'N/A' ELSE text END FROM conversations)""",
    "clean_documents": f"""SELECT page_id, {clean(_TITLE)} AS title, sha256(CASE WHEN page_id % 4 = 0 THEN '' ELSE {clean('html')} END) AS content, {_NORMALIZED} AS url FROM pages""",
    "run_metrics": _RUNS + f"""SELECT source_name AS platform, CAST(sum(records_fetched) AS BIGINT) AS fetched, CAST(sum(records_inserted) AS BIGINT) AS inserted,
  count(*) FILTER (WHERE status = 'failed') AS errors, {ts('max(completed_at)')} AS last_completed_at FROM runs GROUP BY 1""",
    "recent_runs": _RUNS + f"SELECT run_id, source_name, {ts('completed_at')} AS completed_at, status, records_fetched, records_inserted FROM runs ORDER BY run_id DESC LIMIT 10",
    "run_stage_rows": _RUNS + """SELECT run_id, stage_no, stage, CASE stage WHEN 'fetch' THEN 'succeeded' WHEN 'normalize' THEN 'succeeded' WHEN 'insert' THEN 'failed' ELSE 'unknown' END AS status,
  CASE WHEN stage = 'normalize' THEN records_fetched END AS count, CAST(NULL AS BIGINT) AS inserted, CAST(NULL AS BIGINT) AS dedupe_skipped,
  CASE WHEN stage = 'insert' THEN 'E' END AS error_class, CASE WHEN stage = 'insert' THEN 'user ' || user_id END AS error_message
FROM runs, (VALUES (1, 'fetch'), (2, 'normalize'), (3, 'dedupe'), (4, 'insert'), (5, 'enrich_trigger')) v(stage_no, stage) WHERE run_id % 3 = 0""",
    "run_state": _RUNS + f"""SELECT run_id, source_name, CASE WHEN source_name <> 'error' THEN {ts('completed_at')} END AS completed_at,
  CASE WHEN source_name <> 'error' THEN status ELSE 'running' END AS status, CASE WHEN source_name <> 'error' THEN records_fetched ELSE 0 END AS records_fetched,
  CASE WHEN source_name <> 'error' THEN records_inserted ELSE 0 END AS records_inserted, CASE WHEN source_name <> 'error' THEN 2 ELSE 1 END AS event_seq FROM runs""",
    "snapshot_latest_valid": f"""SELECT event_type AS module, CAST(user_id AS VARCHAR) AS cache_key, event_id AS snapshot_id, props AS payload, {ts('ts')} AS created_at
FROM events WHERE ts >= TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "ingest_cleaned_tagged": _with(
        _POSTS, f"""cleaned AS (SELECT id AS external_id, {clean('title')} AS title,
  CASE WHEN conv_id % 4 = 0 OR {deleted(_CONTENT)} THEN '' ELSE {clean(_CONTENT)} END AS body FROM posts)""",
        _tags_view("found", "SELECT external_id AS id, concat_ws(' ', nullif(title, ''), nullif(body, '')) AS text FROM cleaned",
                   ("product", "issue", "competitor", "feature")),
        """joined AS (SELECT document_id AS external_id, string_agg(tag_type || ':' || tag_value, ',' ORDER BY tag_type || ':' || tag_value) AS tags
  FROM found GROUP BY 1)""",
    ) + """SELECT external_id, title, sha256(body) AS body_hash, coalesce(tags, '') AS tags, '2024-03-15T12:00:00+00:00' AS ingestion_ts
FROM cleaned LEFT JOIN joined USING (external_id)""",
    "ingest_end_to_end": _STORED_REVIEWS + ", " + _STORED_POSTS + f""",
stored AS (
  SELECT 1 AS source_id, 'post' AS entity_type, id AS external_id, CAST(NULL AS VARCHAR) AS dedupe_key, title, {_CONTENT} AS body, subreddit,
    subreddit AS community_or_channel, author, CAST(NULL AS BIGINT) AS rating, created_at AS published_at,
    CASE WHEN id IN (SELECT id FROM grid) THEN CASE WHEN conv_id % 5 = 0 THEN 'https://reddit.com/full' ELSE 'https://reddit.com/r/' || subreddit || '/' || conv_id END
      ELSE 'https://reddit.com/p/' || conv_id END AS url
  FROM posts WHERE id IN (SELECT id FROM grid UNION ALL SELECT id FROM more)
  UNION ALL SELECT 1, 'comment', id, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), body, subreddit, subreddit, author, CAST(NULL AS BIGINT),
    created_at, CASE WHEN turn <> 2 THEN 'https://reddit.com/c/' || conv_id END FROM replies
  UNION ALL SELECT 2, 'review', review_id, CASE WHEN review_id IS NULL THEN 'google_play:fallback:' || {_fallback('google_play', app='app_id', author='author', created=f"coalesce({iso('published_at')}, '')", text=prefix_text('text'))} END,
    CAST(NULL AS VARCHAR), {strip('text')}, CAST(NULL AS VARCHAR), app_id, author, rating, published_at,
    'https://play.google.com/store/apps/details?id=' || app_id || coalesce('&reviewId=' || review_id, '') FROM stored_reviews),
numbered AS MATERIALIZED (SELECT *, row_number() OVER () AS id FROM stored), """ + _tags_view(
        "stored_tags", "SELECT id, concat_ws(' ', nullif(title, ''), nullif(body, '')) AS text FROM numbered", ("product", "issue", "competitor", "feature")) + f"""
SELECT CAST(source_id AS BIGINT) AS source_id, entity_type, external_id, dedupe_key, title, sha256(body) AS body_hash, subreddit, community_or_channel, author, rating,
  {ts('published_at')} AS published_at, url,
  coalesce((SELECT string_agg(tag_type || ':' || tag_value, ',' ORDER BY tag_type || ':' || tag_value) FROM stored_tags t WHERE t.document_id = n.id), '') AS tags
FROM numbered n""",
    "stored_ids": _STORED_REVIEWS + ", " + _STORED_POSTS + """,
sizes AS (SELECT 1 AS k, 1 AS source_id, 'post' AS entity_type, (SELECT count(*) FROM grid) + (SELECT count(*) FROM more) AS docs
  UNION ALL SELECT 2, 1, 'comment', (SELECT count(*) FROM replies)
  UNION ALL SELECT 3, 2, 'review', (SELECT count(*) FROM stored_reviews))
SELECT CAST(source_id AS BIGINT) AS source_id, entity_type, docs, CAST(last_id - docs + 1 AS BIGINT) AS first_id, CAST(last_id AS BIGINT) AS last_id
FROM (SELECT *, sum(docs) OVER (ORDER BY k) AS last_id FROM sizes)""",
    "fetch_diagnostics_ledger": _with(
        _POSTS,
        f"shown AS (SELECT id, subreddit, CASE WHEN subreddit = 'c0' THEN '-' || chr(10) || '-' ELSE {_POST_TEXT} END AS txt FROM posts)",
        "grid AS (SELECT c.i * 3 + k.j AS seq, c.name AS subreddit, k.word FROM (VALUES (0, 'c0'), (1, 'c1'), (2, 'c2'), (3, 'nowhere')) c(i, name), (VALUES (0, 'the'), (1, 'que la'), (2, 'zzz')) k(j, word))",
        "counts AS (SELECT g.seq, g.subreddit, g.word, count(p.id) AS hits FROM grid g LEFT JOIN shown p ON p.subreddit = g.subreddit AND contains(p.txt, g.word) GROUP BY 1, 2, 3)",
        "found AS (SELECT subreddit, sum(hits) AS hits FROM counts GROUP BY 1)",
        "fallback AS (SELECT p.id, p.subreddit FROM shown p JOIN found f ON f.subreddit = p.subreddit AND f.hits = 0)",
    ) + """SELECT 'completed' AS status,
  (SELECT count(DISTINCT p.id) FROM shown p JOIN grid g ON p.subreddit = g.subreddit AND contains(p.txt, g.word)) + (SELECT count(*) FROM fallback) AS records_inserted,
  count(*) AS queries_attempted, count(*) FILTER (WHERE hits > 0) AS queries_with_hits, CAST(sum(hits) AS BIGINT) AS search_hits_total,
  (SELECT count(DISTINCT subreddit) FROM (SELECT subreddit FROM counts WHERE hits > 0 UNION ALL SELECT subreddit FROM fallback)) AS subreddits_with_hits,
  (SELECT count(*) FROM fallback) AS new_fallback_hits_total,
  (SELECT string_agg(label, '|' ORDER BY seq) FROM (SELECT seq, 'r/' || subreddit || ' :: ' || word AS label FROM counts WHERE hits = 0 ORDER BY seq LIMIT 5)) AS failed_or_empty_queries_top5
FROM counts""",
    "empty_run_ledger": _with(_POSTS, "late AS (SELECT count(*) AS n FROM posts WHERE epoch > 2000000000)") + """SELECT stage_no, stage,
  CASE stage WHEN 'enrich_trigger' THEN 'not_triggered' ELSE 'succeeded' END AS status, CASE WHEN stage = 'normalize' THEN n END AS count,
  CASE WHEN stage = 'insert' THEN n END AS inserted, CASE WHEN stage = 'dedupe' THEN n END AS dedupe_skipped, CAST(NULL AS VARCHAR) AS error_class,
  CAST(NULL AS VARCHAR) AS error_message, 'completed' AS run_status, n AS records_fetched, n AS records_inserted
FROM late, (VALUES (1, 'fetch'), (2, 'normalize'), (3, 'dedupe'), (4, 'insert'), (5, 'enrich_trigger')) v(stage_no, stage)""",
    "stream_ingest_end_to_end": _with(_POSTS) + f"""SELECT id AS external_id, title,
  sha256({_CONTENT}) AS body_hash, subreddit,
  list_contains({tokens('title')}, 'the') OR list_contains({tokens(_CONTENT)}, 'the') AS found FROM posts""",
    "web_ingest_end_to_end": _with(
        f"""found AS (SELECT page_id, {_CANONICAL} AS external_id, regexp_replace(lower({_NET}), '^www\\.', '') AS community_or_channel,
  lower({_PAGE_TITLE}) AS title, lower({_ARTICLE}) AS content FROM pages WHERE length({_ARTICLE}) >= 500 AND NOT {_EDITORIAL.format(t=_PAGE_TITLE)})""",
        "s1 AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY external_id, title, content ORDER BY page_id) = 1)",
        "s2 AS (SELECT * FROM s1 QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY page_id) = 1)",
    ) + """SELECT row_number() OVER (ORDER BY page_id) AS id, external_id, community_or_channel, '2024-02-01 10:00:00.000000' AS published_at FROM s2""",
    "web_refresh_end_to_end": _LINKS.rstrip() + f""",
placed AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id, position) AS place FROM scored QUALIFY place <= 12),
crawl AS (SELECT link, min(page_id) AS page_id FROM scored GROUP BY 1),
fetched AS (SELECT c.link AS url, p.html, s.site, s.place FROM placed s JOIN crawl c ON c.link = s.link JOIN pages p ON p.page_id = c.page_id
  WHERE p.page_id % 7 <> 3 AND NOT {contains_any('lower(p.html)', ('captcha', 'access denied', 'verify you are human', 'cloudflare', 'bot detection'))}),
found AS (SELECT site, place, {_CANONICAL} AS external_id, regexp_replace(lower({_NET}), '^www\\.', '') AS community_or_channel,
  {_PAGE_TITLE} AS title, {_ARTICLE} AS content FROM fetched WHERE length({_ARTICLE}) >= 500 AND NOT {_EDITORIAL.format(t=_PAGE_TITLE)}),
s1 AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY external_id, lower(title), lower(content) ORDER BY site, place) = 1),
s2 AS (SELECT * FROM s1 QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY site, place) = 1)
SELECT row_number() OVER (ORDER BY site, place) AS id, external_id, community_or_channel, title, sha256(content) AS body_hash,
  '2024-02-01 10:00:00.000000' AS published_at FROM s2""",
    "landed_corrupt_rows": _with(_POSTS) + """SELECT 'completed' AS status, count(*) FILTER (WHERE conv_id % 10 <> 0) AS records_fetched,
  count(*) FILTER (WHERE conv_id % 10 <> 0) AS records_inserted, count(*) FILTER (WHERE conv_id % 10 = 0) AS broken_lines,
  count(*) FILTER (WHERE conv_id % 10 = 0) AS kept_lines FROM posts""",
    "enrich_end_to_end": _STORED_REVIEWS + f""",
texts AS (SELECT *, {strip('text')} AS body FROM stored_reviews),
ready AS (SELECT *, length(body) < 15 AS is_short, {_sentiment('body', 'rating')} AS label FROM texts)
SELECT review_id AS external_id, CASE WHEN review_id IS NULL THEN 'google_play:fallback:' || {_fallback('google_play', app='app_id', author='author', created=f"coalesce({iso('published_at')}, '')", text=prefix_text('text'))} END AS dedupe_key,
  sha256(body) AS body_hash, CASE WHEN is_short THEN 'fallback_rules' ELSE 'rules' END AS model_name, label AS sentiment_label, rating, label AS payload_label FROM ready""",
}
