"""URL rules indexed by their rarest literal token.

A rule is a regular expression with a verdict and a rank. Each rule is filed under the rarest (over all URLs of the
table) of the literal tokens that every URL it can match must have; a URL's tokens fetch the rules filed under them and
only those are run. Everything is joins, aggregates and built-in functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this many go out to every task; more are joined by their token with a shuffle.
BROADCAST_RULES = 10_000
#: The token that every URL has: rules without a literal token are filed there.
EVERY = ""


class Rule(NamedTuple):
    """`name` is reported; `regex` is run on `host + path`, `tokens` are literals of every match; the highest `rank` wins,
    then the name that sorts first."""

    name: str
    regex: str
    verdict: str
    rank: int
    tokens: Sequence[str]


def site_rule(site: str, verdict: str) -> Rule:
    """`host/path prefix`: fits the host and its subdomains if the path starts with the prefix. Longer rules rank higher."""
    host, _, path = site.partition("/")
    quoted = "".join(c if c.isalnum() or c in "/-" else "\\" + c for c in host + "/" + path)
    words = [w for w in host.split(".") if w]
    rest = ("/" + path).split("/")
    # A path token is literal only if the rule ends it with a slash
    return Rule(site, rf"^(?:[^/]*\.)?{quoted}", verdict, len(site), [*words, *(w for w in rest[1:-1] if w.isalnum() and w.islower())])


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Empty for null or no `://`."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end. Empty for null or no `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    """The distinct runs of a-z and 0-9 of host and path, and EVERY."""
    return F.array_union(F.array(F.lit(EVERY)), F.array_distinct(F.filter(F.split(F.concat_ws("/", host, path), "[^a-z0-9]+"), lambda t: t != "")))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", url_col: str = "url", into: str = "judged") -> DataFrame:
    """pages with a struct column `into` (host, path, rule, verdict), one row per row.

    rule is null and verdict `default` where no rule matches, also for a null URL or one without `://`. Equal URLs are
    judged once, whole, however long. Repeated rows stay. An existing column named like `into` is replaced, others may
    have any name; an empty table gives an empty result; no rules give `default` throughout.
    """
    spark = pages.sparkSession
    key, best_of = (next(f"_{name}{n}" for n in range(len(pages.columns) + 1) if f"_{name}{n}" not in pages.columns) for name in ("url_key", "best"))
    urls = pages.select(F.col(url_col).alias(key)).where(F.col(key).isNotNull()).distinct().select(key, host_of(F.col(key)).alias("h"), path_of(F.col(key)).alias("p"))
    words = urls.select(key, (F.concat("h", "p")).alias("site"), F.explode(tokens_of(F.col("h"), F.col("p"))).alias("token"))
    listed = [(r.name, r.regex, r.verdict, r.rank, list(r.tokens) or [EVERY]) for r in rules]
    table = spark.createDataFrame(listed, "name string, regex string, verdict string, rank int, tokens array<string>")
    literal = table.select("name", F.explode("tokens").alias("token")).select("token").distinct()
    if len(rules) <= BROADCAST_RULES:
        literal, table = F.broadcast(literal), F.broadcast(table)
    # how many URLs hold each literal of a rule; a literal that none holds is the rarest of all
    seen = words.join(literal, "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    filed = (
        table.select("*", F.explode("tokens").alias("token")).join(seen, "token", "left")
        .groupBy("name", "regex", "verdict", "rank").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("n"), "token")).alias("rarest"))
        .select("name", "regex", "verdict", "rank", F.col("rarest.token").alias("token"))
    )
    if len(rules) <= BROADCAST_RULES:
        filed = F.broadcast(filed)
    best = (
        words.join(filed, "token").where(F.expr("site rlike regex"))
        .groupBy(key).agg(F.min(F.struct((-F.col("rank")).alias("rank"), "name", "verdict")).alias("best"))
        .select(F.col(key), F.col("best").alias(best_of))
    )
    plain = pages.drop(into) if into in pages.columns else pages
    joined = plain.join(best, plain[url_col] == best[key], "left")
    found, url = F.col(best_of), F.col(f"`{url_col}`")
    out = F.struct(host_of(url).alias("host"), path_of(url).alias("path"), found["name"].alias("rule"), F.coalesce(found["verdict"], F.lit(default)).alias("verdict"))
    return joined.select(*[F.col(f"`{c}`") for c in plain.columns], out.alias(into))
