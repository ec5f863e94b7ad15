"""URL filters: pattern rules fetched by their rarest literal token."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import ascii_lower, fresh, whole

#: Up to so many index rows go to every task; a longer list of rules is joined by a shuffle.
BROADCAST_RULES = 10_000
#: Words that mark a host as spam, in the absence of a host rule.
SPAM_WORDS = ["spam", "pills", "casino", "viagra", "porn", "xxx", "warez", "torrent", "escort", "poker"]


@dataclass(frozen=True)
class Rule:
    """A Java ``pattern`` over host and path. ``tokens``: lower-case runs of ``[a-z0-9]`` that stand
    whole in whatever it matches. Of the fitting rules the one with most ``weight`` wins."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int


def quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host and its subdomains, where the path starts with ``path``."""
    words = re.findall("[a-z0-9]+", host.lower())
    words += [w for w in re.findall("([a-z0-9]+)(?=[^a-z0-9])", path.lower())]
    return Rule(host + path, verdict, f"^(?:[^/]*\\.)?{quoted(host)}{quoted(path)}", tuple(dict.fromkeys(words)), len(host + path))


def word_rule(word: str) -> Rule:
    """Blocks hosts with ``word`` as a label or as a part of one set off by hyphens."""
    return Rule("", "block", f"^(?:[^/]*[.-])?{quoted(word)}(?:[.-]|/|$)", (word,), 0)


RULES = [
    host_rule("allow", "com", "/"),
    host_rule("block", "example.com", "/en/"),
    host_rule("allow", "www.example.com", "/en/"),
    host_rule("block", "net", "/es/"),
    host_rule("block", "net", "/fr/"),
]
METHOD_RULES = [word_rule(w) for w in SPAM_WORDS]


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(whole(url), "(?s)^.*?://([^/?#]*)([^?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(whole(url), "(?s)^.*?://([^/?#]*)([^?#]*)", 2)


def judge(pages: DataFrame, rules: list[Rule] = RULES, others: list[Rule] = METHOD_RULES, url: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` (replacing columns of such names).

    Each rule is filed under the one of its tokens that the urls hold least often; a url's tokens
    fetch the rules to try, and only those run their regular expression. A rule without a token is
    tried on every url. Urls are judged once each, however often they stand in ``pages``.
    Of ``rules`` the heaviest fitting one decides; ties go to the greater name. Else a fitting one of
    ``others`` decides, else the verdict is allow. Null urls and urls without ``://`` have an empty
    host and path and fit no host rule. No rules: all allow. Rows are kept as they are, repeats too.
    """
    spark = pages.sparkSession
    every = [(i, r.name, r.verdict, r.pattern, r.weight, i < len(rules), list(r.tokens) or [""]) for i, r in enumerate([*rules, *others])]
    listed = spark.createDataFrame(every, "id int, name string, verdict string, pattern string, weight int, first boolean, tokens array<string>")
    urls = pages.select(whole(url).alias("url")).distinct()
    parts = urls.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    # the empty token is every url's: rules without a literal are filed there
    words = F.array_union(F.split(F.lower(F.concat_ws("/", "host", "path")), "[^a-z0-9]+"), F.array(F.lit("")))
    held = parts.select("url", F.concat("host", "path").alias("target"), F.explode(words).alias("token"))
    small = sum(len(r[-1]) for r in every) <= BROADCAST_RULES
    near = F.broadcast if small else (lambda df: df)
    wanted = listed.select("id", F.explode("tokens").alias("token"))
    often = held.join(near(wanted.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = wanted.join(often, "token", "left").groupBy("id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    index = listed.drop("tokens").join(rarest, "id")
    tried = held.join(near(index), "token").where(F.expr("regexp_like(target, pattern)"))
    best = tried.groupBy("url").agg(F.max(F.struct("first", "weight", "name", "verdict")).alias("best"))
    key = fresh("url_key", pages)
    kept = [pages[c] for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    # a hot url may hold a third of the rows: the join's left side, which Spark can split
    out = pages.withColumn(key, whole(url)).join(best.select(F.col("url").alias(key), F.col("best").alias(key + "_best")), key, "left")
    first = F.col(key + "_best")["first"]
    return out.select(
        *[F.col(c) for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")],
        host(F.col(key)).alias("host"),
        path(F.col(key)).alias("path"),
        F.when(first, F.col(key + "_best")["name"]).alias("rule"),
        F.coalesce(F.col(key + "_best")["verdict"], F.lit("allow")).alias("verdict"),
    )


ORACLE = f"""
WITH p AS (
    SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's')) AS host,
           regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
    FROM pages),
r AS (
    SELECT *, CASE
        WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
    FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(host, '(^|[.-])({"|".join(SPAM_WORDS)})([.-]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
