"""What a question asks of dates and places, and the bonuses that a hit gets for it."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECENCY_SPAN = 20
_Y = r"(1[89]\d\d|20\d\d|2100)"


def fold(text: str) -> str:
    """Lower case without accents; all but letters and digits of ASCII become single spaces."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()
    return " ".join(re.sub(r"[^a-z0-9]+", " ", plain).split())


@dataclass(frozen=True)
class Constraints:
    years: tuple[tuple[int, int], ...] = ()
    as_of: int | None = None
    places: tuple[str, ...] = ()
    words: frozenset = field(default_factory=frozenset)


def read(question: str, places: tuple[str, ...] = ()) -> Constraints:
    """Ranges, spans, as-of years, decades and lone years; what one pattern has read the later ones pass over."""
    text = fold(question)
    left, ranges, as_of = text, [], None

    def take(pattern: str) -> list[tuple[str, ...]]:
        nonlocal left
        found = [m.groups() for m in re.finditer(pattern, left)]
        left = re.sub(pattern, lambda m: "_" * len(m[0]), left)
        return found

    for pattern in (rf"\b(?:between|from) {_Y} (?:and|to|until|through) {_Y}\b", rf"\b{_Y} (?:to )?{_Y}\b"):
        ranges += [tuple(sorted((int(a), int(b)))) for a, b in take(pattern)]
    for (y,) in take(rf"\b(?:as of|by|up to|until|before) {_Y}\b"):
        as_of = int(y) if as_of is None else min(as_of, int(y))
    ranges += [(int(y), int(y) + 9) for (y,) in take(r"\b(1[89]\d0|20\d0)s\b")]
    ranges += [(int(y), int(y)) for (y,) in take(rf"\b{_Y}\b")]
    return Constraints(tuple(ranges), as_of, tuple(p for p in places if f" {fold(p)} " in f" {text} "), frozenset(text.split()))


def constraints_of(rows: DataFrame, column: str, places: tuple[str, ...]) -> DataFrame:
    """The constraints of a batch of questions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [read(q or "", places) for q in b.column(column).to_pylist()]
            kinds = (pa.list_(pa.list_(pa.int32())), pa.int32(), pa.list_(pa.string()))
            values = ([[list(r) for r in c.years] for c in found], [c.as_of for c in found], [list(c.places) for c in found])
            yield pa.record_batch([b.column(column), *(pa.array(v, k) for v, k in zip(values, kinds))], [column, "years", "as_of", "places"])

    return rows.select(column).mapInArrow(run, f"{column} string, years array<array<int>>, as_of int, places array<string>")


def bonus(c: Constraints, weights: dict[str, float]) -> Column:
    """The sum of the bonuses of a hit (year, jurisdiction, issuer_words where issuer is weighed)."""
    year = F.col("year")
    out = F.lit(0.0)
    if weights.get("year") and c.years:
        ranges = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in c.years])
        out = out + F.when(F.exists(ranges, lambda r: year.between(r["a"], r["b"])), weights["year"]).otherwise(0.0)
    if weights.get("place") and c.places:
        out = out + F.when(F.col("jurisdiction").isin(*c.places), weights["place"]).otherwise(0.0)
    if weights.get("issuer"):
        words = F.col("issuer_words")
        inside = (F.size(words) > 0) & (F.size(F.array_except(words, F.array(*map(F.lit, sorted(c.words))))) == 0)
        out = out + F.when(inside, weights["issuer"]).otherwise(0.0)
    if weights.get("recency") and c.as_of is not None:
        out = out + F.when(year <= c.as_of, weights["recency"] * F.greatest(F.lit(0.0), 1 - (c.as_of - year) / RECENCY_SPAN)).otherwise(0.0)
    return out
