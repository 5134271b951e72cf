"""Years, decades, periods and lanes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The window of the collections and the order of the lanes.
FIRST, LAST = 1960, 2009
LANES = ["pre-1960", "1960s", "1970s", "1980s", "1990s", "2000s", "post-2009", "undated"]


def decade(year: Column) -> Column:
    return F.concat((F.floor(year / 10) * 10).cast("int").cast("string"), F.lit("s"))


def period_of(year: Column, dated: Column, first: int = FIRST, last: int = LAST) -> Column:
    """undated, pre-first, post-last, or the decade."""
    return F.when((F.coalesce(dated, F.lit(0)) == 0) | year.isNull(), "undated").when(year < first, f"pre-{first}").when(year > last, f"post-{last}").otherwise(decade(year))


def period_predicate(period: str, year: Column, dated: Column, first: int = FIRST, last: int = LAST) -> Column:
    """The filter of one period; a period of another form is an error."""
    on = F.coalesce(dated, F.lit(0)) == 1
    if period == "undated":
        return ~on
    if period == f"pre-{first}":
        return on & (year < first)
    if period == f"post-{last}":
        return on & (year > last)
    if len(period) == 5 and period[:3].isdigit() and period.endswith("0s"):
        return on & year.between(int(period[:4]), int(period[:4]) + 9)
    raise ValueError(f"no such period: {period}")


def lane_order(lane: Column, lanes: list[str] = LANES) -> Column:
    """The place of a lane in the fixed order; unknown ones last."""
    out = F.lit(len(lanes))
    for k, name in reversed(list(enumerate(lanes))):
        out = F.when(lane == name, k).otherwise(out)
    return out


def quality_bucket(q: Column) -> Column:
    """high from 0.66, medium from 0.33, else low; unknown counts as high."""
    q = F.coalesce(q, F.lit(1.0))
    return F.when(q >= 0.66, "high").when(q >= 0.33, "medium").otherwise("low")


def ocr_band(q: Column) -> Column:
    """The export bands: high from 0.9, medium from 0.75, else low; unknown stays unknown."""
    return F.when(q.isNull(), "unknown").when(q >= 0.9, "high").when(q >= 0.75, "medium").otherwise("low")


def map_band(n: Column) -> Column:
    """well from 300, some from 50, sparse above 0, else null."""
    return F.when(n >= 300, "well").when(n >= 50, "some").when(n > 0, "sparse")


def zones(leaf: Column, leaves: Column) -> tuple[Column, Column]:
    """Whether a leaf is in the front zone and in the back zone of an item."""
    front = leaf < F.greatest(F.lit(3), F.ceil(leaves * 0.06))
    return front, leaf > leaves - 1 - F.greatest(F.lit(2), F.ceil(leaves * 0.05))


def parse_date(raw: Column) -> Column:
    """struct(date_norm, year, decade, dated, method): exact, range, partial or unknown; no year is guessed."""
    s = F.trim(F.coalesce(raw, F.lit("")))
    found = F.transform(F.regexp_extract_all(s, F.lit(r"\d{4}"), F.lit(0)), lambda y: y.cast("int"))
    ranged = s.rlike(r"\d{4}\s*[-/]\s*\d{4}")
    year = F.when(ranged, F.array_min(found)).otherwise(F.get(found, 0))
    partial = s.rlike(r"^\d{1,3}[-?]{1,3}$")
    good = (s != "") & ~partial & F.coalesce(year.between(1850, 2025), F.lit(False))
    return F.struct(
        F.when(s == "", None).when(good, year.cast("string")).otherwise(s).alias("date_norm"),
        F.when(good, year).alias("year"),
        F.when(good, decade(year)).alias("decade"),
        good.cast("int").alias("dated"),
        F.when(partial, "partial").when(good & ranged, "range").when(good, "exact").otherwise("unknown").alias("method"),
    )


def title_year(title: Column) -> Column:
    """A year the title states: a fiscal year's first, then "year ending", then the only distinct year."""
    t = F.coalesce(title, F.lit(""))
    y = r"(1[89]\d\d|20[0-2]\d)"
    part = lambda pattern: F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")).cast("int")
    kept = lambda c: F.when(c.between(1850, 2025), c)
    fiscal = kept(part(rf"\b{y}-\d\d\b"))
    ending = kept(part(rf"(?i)year end\w*[^0-9]{{0,40}}{y}"))
    lone = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(t, F.lit(rf"\b{y}\b"), F.lit(1)), lambda v: v.cast("int")), lambda v: v.between(1850, 2025)))
    return F.coalesce(fiscal, ending, F.when(F.size(lone) == 1, F.get(lone, 0)))


def fiscal_close(start: Column, end: Column) -> Column:
    """The closing year of a fiscal year written 1987-88 or 1987-1988; null if it is not one year on."""
    short = F.floor(start / 100) * 100 + end
    close = F.when(end >= 100, end).when(short < start, short + 100).otherwise(short).cast("int")
    return F.when((close - start > 0) & (close - start <= 1), close)
