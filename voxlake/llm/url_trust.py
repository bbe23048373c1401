"""URL filters: rules first, then trust and distrust that spread over the links between hosts.

A page's verdict is that of the longest rule that fits its url. Pages without a rule get the verdict of their host:
personalised PageRank spreads trust along links from hosts with allowed pages, and distrust against the links from
hosts with blocked pages, that is, to hosts that link to them. A host starts with the share of its pages that rules
allow, and block. Both divide among hosts: of a blocked host's distrust, each of many linkers gets little. So a host has
leads as well, the damped share of its own links that lead to blocked pages, over any number of hosts, however many
others link there. It is blocked if its distrust is over its trust, and either its distrust is over the threshold, or
leads / (leads + trust + PRIOR) is. The prior lets a host without trust have one link in a hundred to a blocked host.

Scores go round until no host's changes by more than TOLERANCE in a round; what then is missing of a score is at most
TOLERANCE * damping / (1 - damping).

Null urls and urls without :// have an empty host and path, and no rule. Hosts without pages pass scores on. Repeated
pages count as often as they are there. Null html has no links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import cut, lower_ascii, whole

DAMPING, THRESHOLD, PRIOR, TOLERANCE = 0.85, 0.5, 0.02, 1e-3
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_after(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    """What follows the first ://."""
    at = F.locate("://", whole(url))
    return F.when(at > 0, whole(url).substr(at + 3, F.length(whole(url)))).otherwise("")


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (host/path) that fits, or null."""
    fitting = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        fitting.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*fitting, F.lit(None).cast("string"))


def host_scores(pages: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int | None = None,
                tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust and leads, each at most 1. pages: host, verdict (null without a rule); links: source, target.

    Rounds go on to the tolerance if their number is not given. Counts are combined before their shuffle, so a host may
    have any number of pages and links.
    """
    share = {v: F.avg(F.when(F.col("verdict") == v, 1.0).otherwise(0.0)) for v in ("allow", "block")}
    seeds = cut(pages.groupBy("host").agg(share["allow"].alias("trust"), share["block"].alias("distrust")))
    edges = cut(links.filter("source <> target and source <> '' and target <> ''").groupBy("source", "target").agg(
        F.count("*").alias("n")))
    out = edges.groupBy("source").agg(F.sum("n").alias("total"))
    into = edges.groupBy("target").agg(F.sum("n").alias("total"))
    zero, part = F.lit(0.0), F.col("n") / F.col("total")
    ways = cut(
        edges.join(out, "source").select(
            F.col("source").alias("host"), F.col("target").alias("to"), part.alias("t"), zero.alias("d"), zero.alias("l"))
        .unionByName(edges.join(into, "target").select(
            F.col("target").alias("host"), F.col("source").alias("to"), zero.alias("t"), part.alias("d"), zero.alias("l")))
        .unionByName(edges.join(out, "source").select(
            F.col("target").alias("host"), F.col("source").alias("to"), zero.alias("t"), zero.alias("d"), part.alias("l"))))
    start = seeds.select("host", *((F.col(c) * (1 - damping)).alias(c) for c in ("trust", "distrust")),
                         F.col("distrust").alias("own"), zero.alias("leads"))
    scores, done = start.withColumn("change", zero), 0
    while done != rounds:
        sent = ways.join(scores, "host").select(
            F.col("to").alias("host"), (F.col("t") * F.col("trust") * damping).alias("trust"),
            (F.col("d") * F.col("distrust") * damping).alias("distrust"), zero.alias("own"),
            # what a host passes on is at most 1: its own blocked share, and of the rest where its links lead
            (F.col("l") * (F.col("own") + (1 - F.col("own")) * F.col("leads")) * damping).alias("leads"))
        names = ("trust", "distrust", "own", "leads")
        now = start.unionByName(sent).groupBy("host").agg(*(F.sum(c).alias(c) for c in names))
        old = scores.select("host", *(F.col(c).alias(f"old_{c}") for c in names))
        change = F.greatest(*(F.abs(F.col(c) - F.coalesce(f"old_{c}", zero)) / (1 if c == "leads" else 1 - damping)
                              for c in ("trust", "distrust", "leads")))
        scores = cut(now.join(old, "host", "left").select("host", *names, change.alias("change")))
        done += 1
        if rounds is None and (scores.agg(F.max("change")).first()[0] or 0) <= tolerance:
            break
    return scores.select("host", *((F.col(c) / (1 - damping)).alias(c) for c in ("trust", "distrust")), "leads")


def url_verdicts(pages: DataFrame, rules: dict[str, str], threshold: float = THRESHOLD, rounds: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of each page. rules: allow or block, by host/path."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn(
        "verdict", F.coalesce(*(F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()), F.lit(None).cast("string")))
    links = pages.select(
        host_of(F.col("url")).alias("source"),
        F.explode(F.regexp_extract_all(whole(F.col("html")), F.lit(LINK), F.lit(1))).alias("target"),
    ).withColumn("target", lower_ascii(F.col("target")))
    scores = host_scores(ruled.select("host", "verdict"), links, rounds=rounds)
    leads = F.col("leads") / (F.col("leads") + F.col("trust") + PRIOR)
    bad = (F.col("distrust") > F.col("trust")) & ((F.col("distrust") > threshold) | (leads > threshold))
    return ruled.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
