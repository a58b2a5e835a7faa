"""URL filters: pattern rules found by their rarest literal token (DataFrame functions only).

A rule is a regular expression over ``host + path`` together with literal tokens that any matching
url contains. Each rule is filed under the token that is rarest among the urls; a url's own tokens
fetch the rules filed under them and only those expressions run. Up to ``inline_limit`` rules are
filed in a literal map and the whole judgement is one projection without any shuffle; more rules
go through an equi-join on the token, pre-aggregated per url.

Defined results: a null or empty url, or one without ``://``, has empty host and path, no rule and the
default verdict; a url of any length is judged whole; of rules of one weight the greater name wins; repeated
rows are judged each on its own; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table


@dataclass(frozen=True)
class Rule:
    """``weight`` decides among the rules that match (larger wins, then the name)."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int
    site: bool = False


def site_rule(site: str, verdict: str) -> Rule:
    """``host/path``: fits the host and its subdomains where the path starts with the rule's."""
    host, _, rest = site.partition("/")
    escaped = "".join(f"\\{c}" if not c.isalnum() else c for c in f"{host}/{rest}")
    # a path's last word need not end where the rule does
    path = rest.split("/")[: None if rest.endswith("/") else -1]
    tokens = tuple(t for t in (*host.split("."), *path) if t and re.fullmatch(r"[a-z0-9]+", t)) or ("",)
    return Rule(site, verdict, f"^(?:[^/]*\\.)?{escaped}", tokens, 1_000_000 + len(site), True)


#: The site rules and the patterns that judge what no site rule fits.
SITE_RULES = (
    site_rule("net/", "block"),
    site_rule("example.net/en/", "allow"),
    site_rule("example.com/de/", "block"),
    site_rule("org/fr/", "allow"),
)
PATTERN_RULES = (
    Rule("casino-host", "block", r"^(?:[^/]*[.-])?casino[.-]", ("casino",), 30),
    Rule("adult-path", "block", r"/(?:[^?#]*/)?(?:xxx|porn)(?:/|\z)", ("xxx|porn",), 20),
    Rule("betting-host", "block", r"^(?:[^/]*[.-])?(?:betting|poker|slots)[.-]", ("betting|poker|slots",), 18),
    Rule("torrent-host", "block", r"^(?:[^/]*[.-])?(?:torrent|warez)[.-]", ("torrent|warez",), 16),
    Rule("short-link-host", "block", r"^(?:bit\.ly|goo\.gl|t\.co)/", ("bit|goo|t", "ly|gl|co"), 14),
    Rule("tracker-host", "block", r"^(?:ads|tracker)\.", ("ads|tracker",), 10),
    Rule("feed-path", "block", r"/(?:feed|rss|atom)(?:/|\.xml)?\z", ("feed|rss|atom",), 9),
    Rule("shop-path", "block", r"/(?:cart|checkout|basket)(?:/|\z)", ("cart|checkout|basket",), 8),
    Rule("archive-path", "block", r"/(?:tag|tags|author)/[^/]+/page/[0-9]+", ("page", "tag|tags|author"), 7),
    Rule("admin-path", "block", r"/(?:wp-admin|wp-login|xmlrpc)(?:/|\.php|\z)", ("admin|login|xmlrpc",), 6),
    Rule("login-page", "block", r"/login(?:\.html?|/|\z)", ("login",), 5),
    Rule("binary-file", "block", r"\.(?:exe|zip|iso|dmg|apk)\z", ("exe|zip|iso|dmg|apk",), 4),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_u, instr(_u, '://') + 3)"))
    rest = F.coalesce(F.regexp_extract(rest, r"(?s)^([^?#]*)", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return ascii_lower(host), rest.substr(F.char_length(host) + 1, F.char_length(rest))


def _alternatives(rule: Rule) -> list[list[str]]:
    return [t.split("|") for t in rule.tokens]


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.split(ascii_lower(url), r"[^a-z0-9\x{80}-\x{10FFFF}]+"))


def rarest_tokens(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[str]]:
    """For each rule the token group met in the fewest urls: the rules' words counted in one grouping."""
    words = sorted({w for r in rules for group in _alternatives(r) for w in group})
    found = urls.select(F.explode(_tokens(F.coalesce("url", F.lit("")))).alias("token"))
    known = urls.sparkSession.createDataFrame([(w,) for w in words], "token string")  # as many as the rules have words
    count = {r.token: r.n for r in found.join(F.broadcast(known), "token").groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {r.name: min(_alternatives(r), key=lambda g: (sum(count.get(w, 0) for w in g), -min(map(len, g)), g)) for r in rules}


def judge_urls(
    pages: DataFrame, rules: tuple[Rule, ...] = SITE_RULES + PATTERN_RULES, *, default: str = "allow", inline_limit: int = 512
) -> DataFrame:
    """Columns page_id, host, path, rule (a site rule's name or null), verdict, matched."""
    urls = pages.select("page_id", "url")
    filed: dict[str, list[Rule]] = {}
    rare = rarest_tokens(urls, rules) if rules else {}
    for r in rules:
        for w in rare[r.name]:
            filed.setdefault(w, []).append(r)
    host, path = split_url(F.col("_u"))
    parts = urls.withColumnRenamed("url", "_u").select("page_id", host.alias("host"), path.alias("path"))
    target = F.concat("host", "path")
    tokens = _tokens(target)
    if len(filed) > inline_limit:
        return _judge_by_join(parts, tokens, target, filed, default)

    def as_struct(r: Rule) -> Column:
        return F.struct(F.lit(r.weight).alias("weight"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"), F.lit(r.site).alias("site"))

    # filed under its token, a rule is looked at only by urls that hold it
    fetched = [F.when(F.array_contains(F.col("_t"), w), F.array(*map(as_struct, rs))) for w, rs in sorted(filed.items())]
    none = F.array().cast("array<struct<weight:int,name:string,verdict:string,pattern:string,site:boolean>>")
    candidates = F.flatten(F.array_compact(F.array(none, *fetched)))
    best = F.array_max(F.filter(candidates, lambda r: F.rlike(target, r["pattern"])))
    return (
        parts.withColumn("_t", tokens)
        .select("page_id", "host", "path", best.alias("_b"))
        .select(
            "page_id", "host", "path",
            F.when(F.col("_b.site"), F.col("_b.name")).alias("rule"),
            F.coalesce("_b.verdict", F.lit(default)).alias("verdict"),
            F.col("_b.name").alias("matched"),
        )
    )


def _judge_by_join(parts: DataFrame, tokens: Column, target: Column, filed: dict[str, list[Rule]], default: str) -> DataFrame:
    """Many rules: urls meet the rules filed under their tokens in a join; distinct urls once."""
    spark = parts.sparkSession
    rows = [(w, r.weight, r.name, r.verdict, r.pattern, r.site) for w, rs in filed.items() for r in rs]
    index = spark.createDataFrame(rows, "token string, weight int, name string, verdict string, pattern string, site boolean")
    urls = parts.select("host", "path").distinct()
    hits = (
        urls.withColumn("token", F.explode(tokens)).join(index, "token")
        .where(F.rlike(target, F.col("pattern")))
        .groupBy("host", "path").agg(F.max(F.struct("weight", "name", "verdict", "pattern", "site")).alias("_b"))
    )
    return parts.join(hits, ["host", "path"], "left").select(
        "page_id", "host", "path",
        F.when(F.col("_b.site"), F.col("_b.name")).alias("rule"),
        F.coalesce("_b.verdict", F.lit(default)).alias("verdict"),
        F.col("_b.name").alias("matched"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


ORACLE = r"""
WITH u AS (
  SELECT page_id, regexp_extract(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '^[^?#]*') AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM u
), r AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM h
), m AS (
  SELECT *, CASE WHEN rule IS NOT NULL THEN rule
    PATTERNS END AS matched FROM r
)
SELECT page_id, host, path, rule,
  CASE WHEN matched IN ('example.net/en/', 'org/fr/') OR matched IS NULL THEN 'allow' ELSE 'block' END AS verdict, matched
FROM m
""".replace("PATTERNS", "\n    ".join(f"WHEN regexp_matches(host || path, '{r.pattern}') THEN '{r.name}'" for r in sorted(PATTERN_RULES, key=lambda r: -r.weight)))
