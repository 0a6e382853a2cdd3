"""robots.txt: the rule table of a user agent, declared sitemaps, verdicts, and the finished file."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = "len int, allow boolean, pattern string, regex string"


def rule_regex(pattern: str) -> str:
    """Java regex of a robots pattern: a prefix, * for anything, $ at the end for the end."""
    end = pattern.endswith("$")
    body = ".*".join(re.sub(r"([\\.\[\](){}^$|?+*])", r"\\\1", part) for part in (pattern[:-1] if end else pattern).split("*"))
    return f"^{body}{'$' if end else ''}"


def parse_robots(text: str) -> tuple[list[tuple[int, bool, str, str]], float | None]:
    """Rules and crawl delay of the groups for every agent; group state follows the line order."""
    rules, delay, ours, open_group = [], None, False, False
    for line in text.splitlines():
        key, colon, value = line.partition("#")[0].strip().partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            ours = (ours and open_group) or value == "*"
            open_group = True
        elif key in ("allow", "disallow", "crawl-delay"):
            open_group = False
            if ours and key == "crawl-delay":
                try:
                    delay = float(value.replace(",", "."))
                except ValueError:
                    pass
            elif ours and value:
                rules.append((len(value), key == "allow", value, rule_regex(value)))
    return rules, delay


def robots_rules(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse_robots(text)[0], RULES)


def declared_sitemaps(lines: DataFrame, column: str = "value") -> DataFrame:
    """Sitemap URLs that a robots.txt, read with spark.read.text, declares."""
    url = F.regexp_extract(column, r"(?i)^\s*sitemap:\s*(\S+)", 1)
    return lines.select(url.alias("url")).where("url <> ''")


def forbids_everything(rules: DataFrame) -> Column:
    return F.coalesce(F.bool_or((~F.col("allow")) & (F.col("pattern") == "/")), F.lit(False))


def robots_verdict(urls: DataFrame, rules: list[tuple[int, bool, str, str]], path: str = "path") -> DataFrame:
    """`urls` with `denied`: the longest matching pattern decides, ties allow.

    The rules of one file are few and known to the driver, so they become one
    expression over the path; no join is needed.
    """
    longest = {True: F.lit(-1), False: F.lit(-1)}
    for n, allow, _, regex in rules:
        longest[allow] = F.greatest(longest[allow], F.when(F.col(path).rlike(regex), n).otherwise(-1))
    return urls.withColumn("denied", longest[False] > longest[True])


def excluded(path: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(p)
    return out


def finished_robots(text: str | None, sitemap_url: str, staging: bool = False, has_sitemap: bool = True) -> str:
    """robots.txt of the mirror: staging forbids all; Sitemap lines are replaced by ours, or dropped without one."""
    if staging:
        return "User-agent: *\nDisallow: /\n"
    kept = [x for x in (text or "User-agent: *\nDisallow:\n").splitlines() if not re.match(r"\s*sitemap:", x, re.I)]
    return "\n".join([*kept, *([f"Sitemap: {sitemap_url}"] if has_sitemap else [])]).rstrip() + "\n"
