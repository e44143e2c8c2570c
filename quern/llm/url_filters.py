"""URL filters: host-suffix and path-prefix expressions against a rule list.

Each distinct url is expanded into ``host suffix + path prefix`` expressions. An
equi-join on the first 32 bits of their SHA-256 digests finds the rules that may
fit; the full digests confirm them, and the longest fitting rule decides.

Only suffixes with as many labels, and prefixes with as many characters, as some
rule has are formed, so a url makes at most (label counts x path lengths) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.skew import common_keys, dealt_join
from quern.storage import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rule tables of at most this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_RULES = 100_000
#: Ways in which rows of one expression are dealt out where rules are joined by shuffle.
SALTS = 16


def url_host(url: Column) -> Column:
    """From the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; '' without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; '' without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def expressions(urls: DataFrame, labels: list[int], lengths: list[int]) -> DataFrame:
    """One row per url and expression: url, expr, digest, prefix."""
    parts = F.split("_host", r"\.")
    suffixes = F.array_compact(
        F.array(*(F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in labels))
    )
    prefixes = F.array_compact(
        F.array(*(F.when(F.length("_path") >= n, F.substring("_path", 1, n)) for n in lengths))
    )
    return (
        urls.select("url", url_host(F.col("url")).alias("_host"), url_path(F.col("url")).alias("_path"))
        .where("_host <> ''")
        .select("url", suffixes.alias("_suffixes"), prefixes.alias("_prefixes"))
        .select("url", F.explode("_suffixes").alias("_suffix"), "_prefixes")
        .select("url", "_suffix", F.explode("_prefixes").alias("_prefix"))
        .select("url", F.concat("_suffix", "_prefix").alias("expr"))
        .withColumn("digest", F.sha2("expr", 256))
        .withColumn("prefix", F.substring("digest", 1, 8))
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, default: str = "allow", broadcast_rules: int = BROADCAST_RULES
) -> DataFrame:
    """All columns of ``pages`` plus host, path, rule and verdict.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and
    all subdomains where the path starts with its path. The longest rule (host plus
    path) wins; of equally long ones that with the longer host, then block. Rows of
    ``rules`` with nulls fit nothing. Urls that no rule fits, null urls and urls
    without ``://`` get ``default`` and a null rule. Repeated rows stay; columns
    already called like a result are replaced. Rows of very common urls are dealt out
    when they meet their decision. No pages, or no rules, are no error.
    """
    scratch = Scratch(pages.sparkSession, "url-filters")
    rules = rules.select("host", "path", "verdict").dropna().distinct()
    table = rules.select(
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("host_chars"),
        "verdict",
        F.sha2(F.concat("host", "path"), 256).alias("rule_digest"),
    ).withColumn("rule_prefix", F.substring("rule_digest", 1, 8))
    shape = rules.agg(
        F.count("*").alias("n"),
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"),
        F.collect_set(F.length("path")).alias("lengths"),
    ).first()
    urls = scratch.save(pages.where("url is not null").groupBy("url").agg(F.count("*").alias("rows")), "urls")
    common = common_keys(urls, ["url"], "rows", pages.count())
    asked = expressions(urls, sorted(shape["labels"]), sorted(shape["lengths"]))
    near = F.col("prefix") == F.col("rule_prefix")
    if shape["n"] <= broadcast_rules:
        found = asked.join(F.broadcast(table), near)
    else:  # common suffixes are hot keys, so both sides are salted
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        found = asked.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")).join(
            table.withColumn("rule_salt", salts), near & (F.col("salt") == F.col("rule_salt"))
        )
    best = F.max(F.struct(F.length("rule").alias("chars"), "host_chars", "verdict", "rule"))  # block > allow
    decided = found.where("digest = rule_digest").groupBy("url").agg(best.alias("_best"))
    decided = decided.withColumnRenamed("url", "_url")
    kept = [c for c in pages.columns if c not in {"host", "path", "rule", "verdict"}]
    told = dealt_join(pages.select(*kept).where("url is not null"), decided, [("url", "_url")], common, kept, "left")
    told = told.unionByName(pages.select(*kept).where("url is null"), allowMissingColumns=True)
    return told.select(
        *kept,
        url_host(F.col("url")).alias("host"),
        url_path(F.col("url")).alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )
