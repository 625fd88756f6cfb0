"""Allow and block rules for URLs by host suffix and path prefix.

Each distinct (host, path) is expanded into every host suffix (by labels) with every path prefix of a length that some rule
has. Expressions and rules are joined on the first eight hex digits of their SHA-256, whole digests confirm the hits, and
the longest rule wins. The URLs come back by their (host, path).

The host is what stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased (a port stays part of it);
the path goes on from there up to `?`, `#` or the end. A rule is `host/path`: it fits its host and all subdomains where
the URL's path starts with the rule's path.

Defined cases: a null URL or one without `://` has empty host and path, and no rule fits it; of rules equal in length the
contract's own come before the method's, then allow before block; repeated rules count once, with allow before block;
an empty rule table decides nothing. Unruled URLs are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .store import LOWER, columns_clear_of

PREFIX_DIGITS = 8
#: Hosts that the method itself blocks where no rule given decides (advertising, gambling, pills, adult and spam farms).
METHOD_BLOCKS = [
    f"{name}.example.{end}/"
    for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for end in ("com", "net", "org")
]


def host_of(url: Column) -> Column:
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, *LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def expressions(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Host suffixes x path prefixes, as `host` + `path` texts; nothing for an empty host."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    lengths = F.filter(F.array(*[F.lit(n) for n in path_lengths]).cast("array<int>"), lambda n: n <= F.length(path))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(lengths, lambda n: F.concat(s, F.substr(path, F.lit(1), n)))))
    return F.when(host != "", pairs).otherwise(F.array().cast("array<string>"))


def judge(pages: DataFrame, rules: DataFrame, url_column: str = "url") -> DataFrame:
    """The columns of pages, then host, path, rule, verdict (null without a rule).

    rules: (rule, verdict[, rank]), rule as `host/path`; a smaller rank wins before length counts. Clashing names get `_`.
    """
    ranked = rules if "rank" in rules.columns else rules.withColumn("rank", F.lit(0))
    split_rule = ranked.filter("rule is not null").select(
        "rule", "verdict", "rank",
        F.concat(F.translate(F.substring_index("rule", "/", 1), *LOWER), F.regexp_replace("rule", "^[^/]*", "")).alias("expression"),
    )
    keyed = split_rule.groupBy("expression").agg(
        F.min(F.struct("rank", "verdict", "rule")).alias("best")
    ).select("expression", "best.*").withColumn("digest", F.sha2("expression", 256))
    rule_path = F.regexp_extract("expression", "^[^/]*(/?.*)", 1)
    # one number per distinct length of a rule's path; no longer than the longest rule
    lengths = sorted(r[0] for r in keyed.select(F.length(rule_path)).distinct().collect())
    names = columns_clear_of(pages, "host", "path", "rule", "verdict")
    host, path = names["host"], names["path"]
    parsed = pages.withColumn(host, host_of(F.col(url_column))).withColumn(path, path_of(F.col(url_column)))
    urls = parsed.select(F.col(host).alias("url_host"), F.col(path).alias("url_path")).filter("url_host <> ''").distinct()
    expanded = urls.select(
        "url_host", "url_path", F.explode(expressions(F.col("url_host"), F.col("url_path"), lengths)).alias("url_expression")
    ).withColumn("url_digest", F.sha2("url_expression", 256))
    short = lambda c: F.substring(c, 1, PREFIX_DIGITS)
    hits = expanded.join(
        keyed.withColumn("prefix", short("digest")), (short("url_digest") == F.col("prefix")) & (F.col("url_digest") == F.col("digest"))
    )
    order = F.struct(F.col("rank"), -F.length("expression"), F.col("verdict"))
    best = hits.groupBy("url_host", "url_path").agg(F.min_by(F.struct("rule", "verdict"), order).alias("best"))
    return parsed.join(best, (F.col(host) == F.col("url_host")) & (F.col(path) == F.col("url_path")), "left").select(
        *[f"`{c}`" for c in pages.columns], host, path, F.col("best.rule").alias(names["rule"]), F.col("best.verdict").alias(names["verdict"])
    )
