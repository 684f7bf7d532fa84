"""URL rules found by their rarest literal token.

A rule is a regular expression over host and path, with literal tokens that
every match must contain as whole tokens.  Among its tokens the one that is
rarest in the URLs at hand is the rule's only entry in the index.  The tokens
of a URL fetch candidate rules from the index, and only those run their
expression.  Equal (host, path) pairs are judged once.

Only column functions are used.  The rules are a list in the driver; their
index is broadcast only when its count is small.

Defined results: a null URL, or one without ``://``, has an empty host and
path, and is matched by no rule; repeated pages give repeated rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from foldmark.llm.order import small

TOKEN_GAP = r"[^\p{L}\p{N}]+"


@dataclass(frozen=True)
class UrlRule:
    """``listed`` rules decide by the longest name; patterns decide the rest."""
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    listed: bool = True


def quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def site_rule(name: str, verdict: str) -> UrlRule:
    """``host/path``: the host, its subdomains, and paths that start like it.

    The last token of the path may be cut short by the rule, so it is indexed
    only if a separator follows it.
    """
    host, slash, path = name.partition("/")
    whole = re.findall(r"[^\W_]+", host.lower())
    whole += re.findall(r"[^\W_]+(?=[\W_])", (slash + path).lower())
    return UrlRule(name, verdict, r"\A(?:[^/]*\.)?" + quoted(host.lower() + slash + path),
                   tuple(dict.fromkeys(whole)))


def host_word(word: str, verdict: str = "block") -> UrlRule:
    """A word between dots or hyphens of the host."""
    return UrlRule(word, verdict, r"\A(?:[^/]*[.-])?" + quoted(word) + r"(?:[.-]|/|\z)",
                   (word,), listed=False)


SITE_RULES = (
    site_rule("org/", "allow"), site_rule("example.org/es/", "block"),
    site_rule("example.org/en/1", "block"), site_rule("com/fr/", "allow"),
    site_rule("com/de/", "block"),
)
UNWANTED = tuple(host_word(w) for w in (
    "ads", "adult", "bets", "bet", "casino", "poker", "porn", "xxx", "pills", "pharma",
    "spam", "track", "tracker", "warez"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only), and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, path


def rule_table(df: DataFrame, rules: tuple[UrlRule, ...]) -> DataFrame:
    rows = [F.struct(F.lit(i).alias("rule_no"), F.lit(r.name).alias("rule"),
                     F.lit(r.verdict).alias("rule_verdict"), F.lit(r.regex).alias("regex"),
                     F.lit(r.listed).alias("listed"), F.lit(t).alias("token"))
            for i, r in enumerate(rules) for t in r.tokens]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def judged(pages: DataFrame, rules: tuple[UrlRule, ...] = SITE_RULES + UNWANTED,
           key: str = "page_id", url: str = "url", otherwise: str = "allow") -> DataFrame:
    """Key, host, path, the longest listed rule that fits, and the verdict.

    Where no listed rule fits, a fitting pattern gives the verdict, block
    before allow; where none fits either, ``otherwise`` does.
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = pages.select(F.col(f"`{key}`").alias("_key"), host.alias("_host"), path.alias("_path"))
    sites = rows.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("_n"))
    tokens = F.array_distinct(F.split(F.lower(F.concat_ws("/", "_host", "_path")), TOKEN_GAP))
    named = rule_table(pages, rules)
    wanted = small(named.select("token").distinct())
    # counts of rule tokens only; the URL tokens combine before the shuffle
    seen = (sites.select("_n", F.explode(tokens).alias("token")).join(wanted, "token", "left_semi")
            .groupBy("token").agg(F.sum("_n").alias("seen")))
    rarest = (named.join(seen, "token", "left")
              .groupBy("rule_no", "rule", "rule_verdict", "regex", "listed")
              .agg(F.min_by("token", F.struct(F.coalesce("seen", F.lit(0)), "token"))
                   .alias("token")))
    whole = F.concat("_host", "_path")
    fits = (sites.select("_host", "_path", F.explode(tokens).alias("token"))
            .join(small(rarest), "token").filter(F.rlike(whole, F.col("regex")))
            .groupBy("_host", "_path")
            .agg(F.max(F.when(F.col("listed"), F.struct(F.length("rule"), "rule", "rule_verdict")))
                 .alias("_listed"),
                 F.max(F.when(~F.col("listed"), F.col("rule_verdict"))).alias("_pattern")))
    return (rows.join(fits, ["_host", "_path"], "left")
            .select(F.col("_key").alias(key), F.col("_host").alias("host"),
                    F.col("_path").alias("path"), F.col("_listed.rule").alias("rule"),
                    F.coalesce("_listed.rule_verdict", "_pattern", F.lit(otherwise))
                    .alias("verdict")))
