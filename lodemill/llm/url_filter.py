"""Operator 6: URL filters by an index of pattern rules under their rarest literal token.

Every rule names literal tokens that any URL it fits must hold.  Counts of those tokens over all URLs tell which is
the rarest; the rule stands in the index under that one alone.  The tokens of a URL fetch its candidate rules, and
only those run their regular expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemill.llm.common import ascii_lower

#: Above this many rules the index is a table that is joined, not a literal in the plan.
INLINE_RULES = 200


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path; ``tokens`` are literals in lower case that it implies, each a whole token.

    ``rank``: 1 for listed rules, 0 for the method's own patterns, which only speak where no listed rule fits.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int = 1


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/])", r"\\\1", text)


def _tokens(text: str) -> list[str]:
    return [t for t in re.split(r"[^a-z0-9]+", text.lower()) if t]


def host_path_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``; its last token may be cut, so isn't a literal."""
    whole = path[: len(path) - len(re.search(r"[A-Za-z0-9]*$", path)[0])]
    return Rule(host + path, verdict, f"^(?:[^/]*\\.)?{_quoted(host)}{_quoted(path)}", tuple(_tokens(host) + _tokens(whole)))


def host_word_rule(word: str) -> Rule:
    """Blocks hosts with ``word`` between dots or hyphens."""
    return Rule(word, "block", f"^(?:[^/]*[.\\-])?{_quoted(word)}(?:[.\\-/]|$)", (word,), 0)


#: The rules of the registered query.
LISTED = (
    host_path_rule("allow", "org", "/"),
    host_path_rule("block", "example.org", "/es/"),
    host_path_rule("block", "example.org", "/en/1"),
    host_path_rule("allow", "com", "/fr/"),
    host_path_rule("block", "com", "/de/"),
)
#: Words of hosts that the method itself blocks.
OWN = tuple(map(host_word_rule, ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "warez", "xxx")))


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(subject: Column) -> Column:
    return F.array_distinct(F.split(ascii_lower(subject), "[^a-z0-9]+"))


def rarest_token_index(subjects: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[int]]:
    """Rule numbers by token, '' for rules without one.  Counts cover all rows; only tokens that rules name are counted."""
    words = sorted({t for r in rules for t in r.tokens})
    counts = {}
    if words:
        seen = subjects.select(F.explode(F.array_intersect(url_tokens(F.col("subject")), F.array(*map(F.lit, words)))).alias("t"))
        counts = {r.t: r["count"] for r in seen.groupBy("t").count().collect()}  # one row for each word of the rules at most
    index: dict[str, list[int]] = {}
    for k, r in enumerate(rules):
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(k)
    return index


def _best(hits: Column) -> Column:
    return F.array_max(F.transform(hits, lambda r: F.struct(r["rank"], F.length(r["name"]).alias("n"), r["name"], r["verdict"])))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = LISTED + OWN, inline: int = INLINE_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages(page_id, url)``.

    Null and empty URLs and URLs without ``://`` have an empty host and path, no rule and verdict ``allow``.  The
    listed rule with the longest name wins, of equal ones the greatest name; ``rule`` is null if only the method's own
    patterns, or nothing, fits.  Every row gives a row; other columns are not read.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("subject", F.concat("host", "path"))
    index = rarest_token_index(rows, rules)
    spark = pages.sparkSession
    if len(rules) <= inline:
        found = rows.withColumn("best", _inline(F.col("subject"), rules, index))
    else:
        table = spark.createDataFrame([(t, *map(str, (rules[k].name, rules[k].verdict, rules[k].pattern)), rules[k].rank) for t, ks in index.items() for k in ks], "t string, name string, verdict string, pattern string, rank int")
        subjects = rows.select("subject").distinct()
        tokens = subjects.select("subject", F.explode(F.array_union(url_tokens(F.col("subject")), F.array(F.lit("")))).alias("t"))
        hits = tokens.join(table, "t").where(F.expr("rlike(subject, pattern)"))
        best = hits.groupBy("subject").agg(F.max(F.struct("rank", F.length("name").alias("n"), "name", "verdict")).alias("best"))
        found = rows.join(best, "subject", "left")
    listed = F.col("best.rank") == 1
    return found.select("page_id", "host", "path", F.when(listed, F.col("best.name")).alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def _inline(subject: Column, rules: tuple[Rule, ...], index: dict[str, list[int]]) -> Column:
    whole = F.array(*[F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"), F.lit(r.rank).alias("rank")) for r in rules])
    table = F.create_map(*[x for t, ks in index.items() for x in (F.lit(t), F.array(*map(F.lit, ks)))])
    tokens = F.array_union(url_tokens(subject), F.array(F.lit("")))
    fetched = F.flatten(F.filter(F.transform(tokens, lambda t: F.try_element_at(table, t)), lambda x: x.isNotNull()))
    candidates = F.transform(F.array_distinct(fetched), lambda k: F.get(whole, k))
    return _best(F.filter(candidates, lambda r: F.rlike(subject, r["pattern"])))


def oracle() -> str:
    """DuckDB SQL of ``filter_urls`` with the default rules: every rule on every row."""
    values = ", ".join(f"('{r.name}', '{r.verdict}', '{r.pattern}', {r.rank})" for r in LISTED + OWN)
    return f"""
    WITH r(name, verdict, pattern, rank) AS (VALUES {values}),
    u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
    SELECT page_id, host, path,
           (SELECT max_by(name, length(name)) FROM r WHERE rank = 1 AND regexp_matches(host || path, pattern)) AS rule,
           coalesce((SELECT max_by(verdict, length(name)) FROM r WHERE rank = 1 AND regexp_matches(host || path, pattern)),
                    CASE WHEN EXISTS (SELECT 1 FROM r WHERE rank = 0 AND regexp_matches(host || path, pattern)) THEN 'block' ELSE 'allow' END) AS verdict
    FROM u"""
