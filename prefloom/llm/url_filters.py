"""URL rules, each indexed by its rarest literal token; only the candidates a URL's tokens fetch run their pattern.

A rule is a host and path prefix, a regular expression, or both. Its literal tokens are the runs of
letters and digits that every URL it fits must have; the rarest of them among the URLs is its index
entry. Distinct URLs are cut into tokens, joined to the index, and only the fetched rules are checked.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.llm.text import unused

RULE_SCHEMA = "rule string, action string, host string, path string, pattern string, tokens array<string>"
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class UrlRule:
    """``name`` is reported; host "" fits every host; the pattern (Java syntax, lower case) searches the whole
    URL, A-Z lower-cased, and ``literals`` are tokens that each of its matches must contain whole."""

    name: str
    action: str
    host: str = ""
    path: str = ""
    pattern: str | None = None
    literals: tuple[str, ...] = ()

    def tokens(self) -> tuple[str, ...]:
        # The last run of a path prefix may go on in the URL, unless something closes it in the rule.
        closed = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", self.path.translate(_LOWER))
        return tuple(dict.fromkeys([*re.findall(r"[a-z0-9]+", self.host), *closed, *self.literals]))


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def host_rule(spec: str, action: str) -> UrlRule:
    """``example.net/en/``: the host and its subdomains, and paths that begin with what follows it."""
    host, _, path = spec.partition("/")
    return UrlRule(spec, action, host, f"/{path}")


HOST_RULES = (
    host_rule("net/", "block"),
    host_rule("example.net/en/", "allow"),
    host_rule("example.com/de/", "block"),
    host_rule("org/fr/", "allow"),
)
# What the method itself decides where no host rule fits: session copies, and pages that are not documents.
PATTERN_RULES = tuple(
    UrlRule(f"pattern:{token}", "block", pattern=pattern.format(token), literals=(token,))
    for pattern, tokens in (
        (r"[?&;]{}=[0-9a-z]{{8,}}", ("phpsessid", "jsessionid", "sessionid", "sid")),
        (r"/{}(?:[/?#.]|$)", ("login", "logout", "signup", "cart", "checkout")),
    )
    for token in tokens
)


def lowered(c: Column) -> Column:
    """A-Z only; other letters have no ASCII case."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for NULL and without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = lowered(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return host, path


def rule_index(urls: DataFrame, rules: tuple[UrlRule, ...]) -> DataFrame:
    """Rules with ``token``: their rarest literal among the tokens of ``urls`` (ties: the first by name).

    Tokens are counted only where a rule has them. Rules without any literal get the empty token, which
    every URL has.
    """
    spark = urls.sparkSession
    rows = [(r.name, r.action, r.host, r.path, r.pattern, list(r.tokens())) for r in rules]
    table = spark.createDataFrame(rows, RULE_SCHEMA)
    if len(rules) <= BROADCAST_RULES:
        table = F.broadcast(table)
    literals = table.select(F.explode("tokens").alias("token")).distinct()
    seen = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    counts = literals.join(seen, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))
    entries = table.select("rule", F.explode("tokens").alias("token")).join(counts, "token")
    rarest = entries.groupBy("rule").agg(F.min(F.struct("n", "token")).alias("least"))
    return table.join(rarest, "rule", "left").select(
        "rule", "action", "host", "path", "pattern", F.coalesce("least.token", F.lit("")).alias("token")
    )


def filter_urls(
    df: DataFrame,
    host_rules: tuple[UrlRule, ...] = HOST_RULES,
    pattern_rules: tuple[UrlRule, ...] = PATTERN_RULES,
    url_column: str = "url",
    default: str = "allow",
) -> DataFrame:
    """``df`` with host, path, rule, verdict and patterns.

    The longest host rule that fits wins (by the length of host and path; ties by name) and is reported
    as ``rule``. Where none fits, ``rule`` is NULL and the verdict is "block" if any pattern rule that
    blocks fits and none that allows does, else ``default``; ``patterns`` names those that fit. A NULL URL
    has empty host and path and gets the default. The verdict depends on the URL alone, so repeated rows
    get equal ones. Columns of ``df`` named like an added one are replaced; all others stay, whatever their names.
    """
    # One row per distinct URL: repeated URLs are merged before the shuffle, and a very frequent one is
    # split again by adaptive execution when the verdicts are joined back.
    host, path = host_and_path(F.col("_url"))
    urls = df.select(F.col(url_column).cast("string").alias("_url")).where(F.col("_url").isNotNull()).distinct()
    urls = urls.select("_url", host.alias("_host"), path.alias("_path"), lowered(F.col("_url")).alias("_low"))
    urls = urls.withColumn("tokens", F.array_distinct(F.split("_low", "[^a-z0-9]+")))
    urls = urls.withColumn("tokens", F.array_union("tokens", F.array(F.lit(""))))
    index = rule_index(urls, (*host_rules, *pattern_rules))
    if len(host_rules) + len(pattern_rules) <= BROADCAST_RULES:
        index = F.broadcast(index)
    fetched = urls.withColumn("token", F.explode("tokens")).join(index, "token")
    below = (F.col("host") == "") | (F.col("_host") == F.col("host")) | F.expr("endswith(_host, concat('.', host))")
    searched = F.col("pattern").isNull() | F.expr("_low rlike pattern")
    fits = fetched.where(below & F.expr("startswith(_path, path)") & searched)
    own = F.col("pattern").isNull()
    length = F.length("host") + F.length("path")
    verdicts = fits.groupBy("_url").agg(
        F.max(F.when(own, F.struct(length.alias("length"), "rule", "action"))).alias("best"),
        F.array_sort(F.collect_set(F.when(~own, F.col("rule")))).alias("patterns"),
        F.min(F.when(~own, F.col("action"))).alias("by_pattern"),  # allow sorts before block
    )
    host, path = host_and_path(F.col(url_column))
    added = ("host", "path", "rule", "verdict", "patterns")
    others = [F.col(f"`{c}`") for c in df.columns if c.lower() not in added]
    key, parts, url, found = unused((*df.columns, *added), "key", "parts", "url", "found")
    parsed = df.select(
        *others, F.col(url_column).cast("string").alias(key), F.struct(host.alias("host"), path.alias("path")).alias(parts)
    )
    verdicts = verdicts.select(F.col("_url").alias(url), F.struct("best", "by_pattern", "patterns").alias(found))
    return parsed.join(verdicts, F.col(key) == F.col(url), "left").select(
        *others,
        F.col(f"{parts}.host").alias("host"),
        F.col(f"{parts}.path").alias("path"),
        F.col(f"{found}.best.rule").alias("rule"),
        F.coalesce(f"{found}.best.action", f"{found}.by_pattern", F.lit(default)).alias("verdict"),
        F.coalesce(f"{found}.patterns", F.array().cast("array<string>")).alias("patterns"),
    )
