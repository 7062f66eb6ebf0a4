"""Landed pages: embedded JSON, page heads, sitemaps, robots rules. Cards and details have modules of their own.

Pages arrive as a column of text; each parser is an expression or a partition-wise function, so a crawl of any size is
read by many tasks. Fetching is not a Spark job and is not done here.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def embedded_json(html: Column, script_id: str, paths: list[str]) -> Column:
    """The first of several JSON paths that the script element's content has."""
    body = F.regexp_extract(html, rf'(?s)<script[^>]*id="{script_id}"[^>]*>(.*?)</script>', 1)
    return F.coalesce(*[F.get_json_object(body, p) for p in paths])


def detail(html: Column) -> dict[str, Column]:
    """Attributes of a detail page, by pattern."""
    first = lambda pattern: F.nullif(F.trim(F.regexp_extract(html, pattern, 1)), F.lit(""))
    return {
        "title": first(r"(?is)<title>(.*?)</title>"),
        "heading": first(r"(?is)<h1[^>]*>(.*?)</h1>"),
        "language": first(r'(?i)<html[^>]*lang="([a-z-]+)"'),
        "paragraphs": F.size(F.regexp_extract_all(html, F.lit("(<p>)"), F.lit(1))),
        "first_paragraph": first(r"(?is)<p>(?:<b>)?(.*?)(?:<br>|</p>)"),
    }


def sitemap(xml: Column, most: int = 30) -> Column:
    """Array of (loc, images) of a sitemap, entities decoded, at most ``most`` images for each address."""
    plain = lambda c: F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    entries = F.regexp_extract_all(xml, F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))
    return F.transform(
        entries,
        lambda e: F.struct(
            plain(F.trim(F.regexp_extract(e, r"(?s)<loc>(.*?)</loc>", 1))).alias("loc"),
            F.slice(F.transform(F.regexp_extract_all(e, F.lit(r"(?s)<image:loc>(.*?)</image:loc>"), F.lit(1)), lambda u: plain(F.trim(u))), 1, most).alias("images"),
        ),
    )


def robots_allowed(path: Column, allow: list[str], disallow: list[str]) -> Column:
    """The longest matching rule decides; ties allow. ``*`` stands for any text, a closing ``$`` for the end."""

    def length(rules: list[str]) -> Column:
        hits = [F.when(path.rlike(rule_pattern(r)), len(r)).otherwise(-1) for r in rules if r]
        return F.greatest(*hits, F.lit(-1)) if hits else F.lit(-1)

    yes, no = length(allow), length(disallow)
    return (no == -1) | (yes >= no)


def rule_pattern(rule: str) -> str:
    ends = rule.endswith("$")
    body = ".*".join(re.escape(x) for x in (rule[:-1] if ends else rule).split("*"))
    return "^" + body + ("$" if ends else "")


def outcome(status: Column, cards: Column, streak: Column, most_empty: int = 3) -> Column:
    """What a fetched page says about the walk."""
    return F.when(status == 404, "end").when(status >= 400, "failed").when((cards == 0) & (streak + 1 >= most_empty), "end").when(cards == 0, "empty").otherwise("ok")
