"""Web pages and what their sites allow: page text and meta tags, robots rules, restriction states.

Markup is taken apart by native expressions; only character references are decoded in Python.
Defined cases: a null page or robots file is empty; a title without words is null; of meta tags
with one name the last counts; without a rule that matches a path may be read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressmark.functions.text import decoded_references

# Fixed values of HTML: elements whose content is no text of the page, and those that begin a line.
_SILENT = "script|style|noscript|template|svg|title"
_LINE = "p|br|div|li|h[1-4]|tr|section"


def _without_comments(html: Column) -> Column:
    return F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?(?:-->|\z)", "")


def page_title(html: Column) -> Column:
    """The words of the title element, references as they are written; null without any."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(_without_comments(html), r"(?is)<title\b[^>]*>(.*?)</title", 1), r"\s+", " ")), F.lit(""))


def page_text(html: Column) -> Column:
    """The text with a line for each block, references as they are written."""
    spoken = F.regexp_replace(_without_comments(html), rf"(?is)<({_SILENT})\b[^>]*>.*?(?:</\1\s*>|\z)", "")
    return F.regexp_replace(F.regexp_replace(spoken, rf"(?i)<(?:{_LINE})\b[^>]*>", "\n"), r"</?[A-Za-z!?][^>]*>", "")


def meta_tags(html: Column) -> Column:
    """The content of meta tags by name in lower case."""
    tags = F.regexp_extract_all(_without_comments(html), F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    value = lambda tag, key: F.coalesce(F.nullif(F.regexp_extract(tag, rf"(?is)\b{key}\s*=\s*\"([^\"]*)\"", 1), F.lit("")), F.nullif(F.regexp_extract(tag, rf"(?is)\b{key}\s*=\s*'([^']*)'", 1), F.lit("")), F.nullif(F.regexp_extract(tag, rf"(?is)\b{key}\s*=\s*([^\s\"'>]+)", 1), F.lit("")))
    pairs = F.filter(F.transform(tags, lambda t: F.struct(F.lower(value(t, "name")).alias("k"), value(t, "content").alias("v"))), lambda p: p["k"].isNotNull() & p["v"].isNotNull())
    last = lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(F.transform(F.array(pairs), last)[0])


def pages(rows: DataFrame, key: str, html: str) -> DataFrame:
    """key, title, text, meta of every page."""
    h = F.col(html)
    read = rows.select(key, decoded_references(page_title(h)).alias("title"), decoded_references(page_text(h)).alias("text"), meta_tags(h).alias("meta"))
    spaced = F.regexp_replace(F.regexp_replace("text", r"[ \t\r\f\x0B]+", " "), r"\n\s*\n", "\n\n")
    return read.withColumn("text", F.regexp_replace(F.regexp_replace(spaced, r"\n\s*\n", "\n\n"), r"\A\s+|\s+\z", ""))


def meta_tag(html: Column, name: str) -> Column:
    """The content of a meta tag, natively; null where there is none."""
    found = F.regexp_extract(html, rf"(?i)<meta\s+name=[\"']{re.escape(name)}[\"']\s+content=[\"']([^\"']*)[\"']", 1)
    return F.nullif(found, F.lit(""))


def publication_date(meta: Column, text: Column) -> Column:
    """A page's own date: the first of the usual meta tags, else "Date modified" in its text."""
    # The tags in the order in which they are trusted.
    names = ("dcterms.modified", "dcterms.issued", "dcterms.created", "dc.date.modified", "dc.date.created", "date")
    tags = [F.nullif(F.regexp_extract(F.coalesce(F.try_element_at(meta, F.lit(n)), F.lit("")), r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")) for n in names]
    said = F.nullif(F.regexp_extract(text, r"(?i)date modified\s*:?\s*(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    return F.coalesce(*tags, said).cast("date")


def robots_rules(rows: DataFrame, key: str, robots: str) -> DataFrame:
    """key, grp, agent, path, allow: every rule of a robots file for every agent of its group, one row each.

    A group begins at an agent line that follows no other agent line; path is null for an agent without rules.
    """
    line = F.trim(F.regexp_replace("line", "#.*", ""))
    spread = rows.select(key, F.posexplode(F.split(F.coalesce(robots, F.lit("")), r"\r\n|\r|\n")).alias("at", "line")).select(key, "at", line.alias("line")).filter(F.col("line").contains(":"))
    said = spread.select(key, "at", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("name"), F.trim(F.regexp_replace("line", r"^[^:]*:", "")).alias("value"))
    order = Window.partitionBy(key).orderBy("at")  # the lines of one file
    names = F.col("name") == "user-agent"
    grouped = said.withColumn("begins", names & ~F.coalesce(F.lag("name").over(order) == "user-agent", F.lit(False))).withColumn("grp", F.sum(F.col("begins").cast("int")).over(order))
    agents = grouped.filter(names).select(key, "grp", F.lower("value").alias("agent")).distinct()
    rules = grouped.filter(F.col("name").isin("allow", "disallow") & (F.col("value") != "")).select(key, "grp", F.col("value").alias("path"), (F.col("name") == "allow").alias("allow"))
    return agents.join(rules, [key, "grp"], "left")


def allowed(rows: DataFrame, key: str, robots: str, path: str, agent: str) -> DataFrame:
    """key, allowed: whether a file lets the agent read a path. Its own first group, else that of *; the longest matching rule decides, allowing among equals.

    Each key is one file with one path.
    """
    rules = robots_rules(rows, key, robots)
    mine = lambda name: F.min(F.when(F.col("agent") == name, F.col("grp")))
    chosen = rules.groupBy(key).agg(F.coalesce(mine(agent.lower()), mine("*")).alias("grp"))
    own = rules.join(chosen, [key, "grp"]).filter("path is not null").select(key, F.col("path").alias("rule"), "allow").distinct()
    pattern = F.concat(F.lit(r"^\Q"), F.replace(F.replace(F.col("rule"), F.lit("*"), F.lit(r"\E.*\Q")), F.lit("$"), F.lit(r"\E$\Q")), F.lit(r"\E"))
    hits = own.join(rows.select(key, F.col(path).alias("asked")), key).filter(F.rlike("asked", pattern))
    best = hits.groupBy(key).agg(F.max(F.struct(F.char_length("rule").alias("n"), "allow")).alias("m"))
    return rows.select(key).join(best, key, "left").select(key, F.coalesce("m.allow", F.lit(True)).alias("allowed"))


def restricts(found: Column, robots_known: Column, policy_known: Column) -> Column:
    """True where any signal restricts, null where none does but a source is unknown, else false."""
    return F.when(found, F.lit(True)).when(~robots_known | ~policy_known, F.lit(None).cast("boolean")).otherwise(F.lit(False))
