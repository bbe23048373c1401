"""Lists, limits and patterns that results depend on."""

# Platforms and tag types
REDDIT = "reddit"
GOOGLE_PLAY = "google_play"
WEB_REVIEWS = "web_reviews"
TAG_TYPES = ("product", "issue", "competitor", "feature")

# Texts that stand for removed content (besides the empty text)
DELETED_TEXTS = ("[deleted]", "[removed]", "deleted", "removed", "na", "n/a")

# URL clean-up
TRACKING_PREFIX = "utm_"
TRACKING_PARAMS = ("fbclid", "gclid")
DEFAULT_PORTS = (80, 443)

# Dedupe keys

# Pages that are not editorial articles
NON_EDITORIAL_URL_PARTS = (
    "/author/", "/authors/", "/category/", "/categories/", "/tag/", "/tags/",
    "/topic/", "/topics/", "/search", "/subscribe", "/membership", "/newsletter",
)
NON_EDITORIAL_TITLE_MARKERS = (
    "authors", "categories", "tags", "subscribe", "newsletter", "sign in", "log in",
)
ARTICLE_PATH_MARKERS = ("review", "reviews", "article", "news", "features")

# Responses that carry no article
BLOCKED_STATUS = (403, 429)
ANTI_BOT_MARKERS = (
    "captcha", "access denied", "verify you are human", "cloudflare", "bot detection",
)

# Article extraction
SKIP_TAGS = ("script", "style", "nav", "header", "footer", "aside", "form", "noscript", "svg")
TEXT_TAGS = ("p", "li", "blockquote", "h2", "h3", "h4")
CONTENT_TAGS = ("article", "main")
CONTENT_HINTS = ("article", "content", "post-body", "entry-content", "review-body", "story-body")
BOILERPLATE_HINTS = (
    "nav", "menu", "footer", "header", "subscribe", "newsletter", "breadcrumb",
    "sidebar", "cookie", "advert", "social", "related", "promo",
)
TITLE_META = ("og:title",)
AUTHOR_META = ("author", "article:author", "og:article:author")
PUBLISHED_META = ("article:published_time", "published_time", "pubdate", "date")
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
    "param", "source", "track", "wbr",
)
MIN_ARTICLE_CHARS = 500

# Link relevance weights: anchor text, page text, URL path
ANCHOR_WEIGHT, PAGE_WEIGHT, PATH_WEIGHT = 6, 3, 1
RANKED_PER_BROAD = 3

# Enrichment labels and rule words
SENTIMENT_LABELS = ("positive", "neutral", "negative", "mixed")
ISSUE_CATEGORIES = (
    "bug", "performance", "ux", "pricing", "support", "integration", "account",
    "reliability", "other",
)
NEGATIVE_WORDS = ("bad", "bug", "crash", "broken", "hate")
POSITIVE_WORDS = ("good", "great", "love", "nice")
SEVERITY = {"negative": 3, "mixed": 2, "neutral": 1, "positive": 0}
FALLBACK_MODEL = "fallback_rules"
FALLBACK_SNIPPET_CHARS = 300
SNIPPET_CHARS = 400

# Full-text ranking: column weights and BM25 parameters
TITLE_WEIGHT, CONTENT_WEIGHT, REVIEW_WEIGHT = 1.5, 1.0, 0.8
BM25_K1, BM25_B, MIN_IDF = 1.2, 0.75, 1e-6

# Report sizes
TREND_DAYS = 14
TOP_CATEGORIES = 8
TOP_FEATURES = 10
RANKED_COMPLAINTS = 100
RECENT_RUNS = 10
EVIDENCE_ROWS = 8
EVIDENCE_CHARS = 280
MIN_ANSWER_EVIDENCE = 2
SNAPSHOT_TTL_MINUTES = 120
INSIGHT_MODULES = ("sentiment", "complaints", "feature_requests")
NO_EVIDENCE_ANSWER = (
    "Based on Reddit data in selected filters.\n\nInsufficient evidence to answer confidently."
)
NO_ANSWER = "Based on Reddit data in selected filters.\n\nNo grounded answer available."
EMPTY_QUESTION_REASON = "Question is empty."
FEW_EVIDENCE_REASON = "Insufficient evidence in selected filters."

# Ingestion
RUN_STAGES = ("fetch", "normalize", "dedupe", "insert", "enrich_trigger")
SUBMISSION_HOST = "https://reddit.com"
APP_PAGE = "https://play.google.com/store/apps/details?id="
