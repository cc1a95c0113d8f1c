"""URL filters: pattern rules indexed by their rarest literal token.

A rule has a pattern (a regular expression over host and path) and the literal
tokens that any URL it matches must hold whole: runs of [a-z0-9]. It is filed
under the one of them that the fewest URLs hold, counted over the whole table.
The tokens of each distinct URL fetch the rules filed under them by an
equi-join, and only those run their expression. The longest rule of the
contract's kind decides; else a pattern of SPAM or PATHS blocks; else the URL is allowed.

Native. Rules that no token can file would have to be tried on every URL, so
they are refused. The index is broadcast up to BROADCAST_RULES rules and joined
by shuffle beyond. Each distinct URL is judged once; its verdict meets its pages
in a join of two plain scans, which Spark splits if one URL has very many pages.

Defined results: a null URL, or one without "://", has an empty host and path,
no rule and is allowed; a tie in length goes to the least rule string; repeated
rows each keep their row; an empty table gives no row; further columns stay,
but for those of the added names, which are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, written

#: The contract's rules: verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Words that name spam when they stand whole in a host.
SPAM = ("spam", "pills", "casino", "viagra", "porn", "xxx", "warez", "torrent", "malware", "phishing")
#: Paths that are no content: (token that must stand whole, pattern over host and path).
PATHS = [("wp", r"^[^/]*/wp-(?:login|admin)\b"), ("cgi", r"^[^/]*/cgi-bin/"), ("calendar", r"/calendar/[0-9]{4}/[0-9]{1,2}(?:/|$)"), ("exe", r"\.exe$")]
BROADCAST_RULES = 50_000

INDEX_SCHEMA = "rule string, verdict string, pattern string, size int, tokens array<string>"


def host_rule(verdict: str, host: str, path: str) -> tuple:
    """A rule for a host, its subdomains and a path's beginning. The path's
    last token may go on in the URL, so it isn't one that must stand whole
    unless something follows it."""
    tokens = re.findall("[a-z0-9]+", host) + re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path.lower())
    return host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", len(host + path), tokens


def spam_rule(word: str) -> tuple:
    """No rule of the contract's kind: its string is null, its size 0."""
    return None, "block", rf"^[^/]*(?<![a-z0-9]){word}(?![a-z0-9])[^/]*", 0, [word]


def path_rule(token: str, pattern: str) -> tuple:
    """A pattern over host and path that needs a token; no rule of the
    contract's kind."""
    return None, "block", pattern, 0, [token]


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_filters(pages: DataFrame, rules: list[tuple] | DataFrame | None = None, spam=SPAM, paths=PATHS) -> DataFrame:
    """pages with host, path, rule and verdict added; rules: (verdict, host,
    path), or a table of INDEX_SCHEMA for very many."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        listed = [host_rule(*r) for r in (RULES if rules is None else rules)] + [spam_rule(w) for w in spam] + [path_rule(*p) for p in paths]
        if bad := [r[0] for r in listed if not r[4]]:
            raise ValueError(f"rules without a literal token: {bad}")
        rules, few = spark.createDataFrame(listed, INDEX_SCHEMA), len(listed) <= BROADCAST_RULES
    else:
        few = rules.count() <= BROADCAST_RULES
    small = F.broadcast if few else lambda df: df
    urls = pages.where("url is not null").select("url").distinct().select("url", F.concat(host_of(F.col("url")), path_of(F.col("url"))).alias("place"))
    tokens = written(urls.select("url", "place", F.explode(F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("place")), F.lit("[a-z0-9]+"), 0))).alias("token")).where("token <> ''"), "tokens")
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    held = tokens.join(small(wanted), "token").groupBy("token").agg(F.count("*").alias("urls"))
    filed = rules.select("rule", "verdict", "pattern", "size", F.explode(F.array_distinct("tokens")).alias("token")).join(held, "token", "left")
    filed = filed.groupBy("rule", "verdict", "pattern", "size").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)), "token"))["token"].alias("token"))
    found = tokens.join(small(written(filed, "index")), "token").where(F.expr("regexp_like(place, pattern)"))
    best = found.groupBy("url").agg(F.min(F.struct((-F.col("size")).alias("rank"), "rule", "verdict")).alias("best"))
    best = written(best.select(F.col("url").alias("best_url"), "best"), "verdicts")
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    joined = pages.select(F.struct(*pages.columns).alias("row"), F.col("url").alias("best_url")).join(best, "best_url", "left")
    url = F.col("row.url")
    return joined.select(*(F.col("row")[c].alias(c) for c in own), host_of(url).alias("host"), path_of(url).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(h, p, v) AS (VALUES """ + ", ".join(f"('{h}', '{p}', '{v}')" for v, h, p in RULES) + r"""),
judged AS (
  SELECT page_id, host, path,
         (SELECT {'rule': h || p, 'verdict': v} FROM rules
          WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
          ORDER BY length(h || p) DESC, h || p LIMIT 1) AS best
  FROM parts)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN regexp_matches(host, '(^|[^a-z0-9])(""" + "|".join(SPAM) + r""")($|[^a-z0-9])') OR """ + " OR ".join(f"regexp_matches(host || path, '{p}')" for _, p in PATHS) + r"""
                              THEN 'block' ELSE 'allow' END) AS verdict
FROM judged
"""
