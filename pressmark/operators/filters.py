"""Filter compiler: a record of wishes becomes one predicate that Spark pushes to the scan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmark.functions.periods import period_predicate


@dataclass(frozen=True)
class Filters:
    """What a question asks of items; None and () ask nothing. Bounds on years drop undated items."""

    period: str | None = None
    jurisdiction: str | None = None
    issuer: str | None = None
    doc_types: tuple[str, ...] = ()
    year_from: int | None = None
    year_to: int | None = None
    as_of: int | None = None
    min_ocr: float | None = None

    def canonical(self) -> "Filters":
        """Trimmed, with the quality at four places."""
        trim = lambda s: s.strip() or None if isinstance(s, str) else s
        return Filters(trim(self.period), trim(self.jurisdiction), trim(self.issuer), tuple(sorted({d.strip() for d in self.doc_types})), self.year_from, self.year_to, self.as_of, None if self.min_ocr is None else round(self.min_ocr, 4))


def where(f: Filters) -> Column:
    """The conjunction of all wishes of f."""
    f = f.canonical()
    year, dated = F.col("year"), F.col("dated")
    last = min((y for y in (f.year_to, f.as_of) if y is not None), default=None)
    wishes: list[Column] = []
    if f.period:
        wishes.append(period_predicate(f.period, year, dated))
    if f.jurisdiction:
        wishes.append(F.col("jurisdiction") == f.jurisdiction)
    if f.issuer:
        wishes.append(F.col("issuer") == f.issuer)
    if f.doc_types:
        wishes.append(F.col("doc_type").isin(*f.doc_types))
    if f.year_from is not None:
        wishes.append((dated == 1) & (year >= f.year_from))
    if last is not None:
        wishes.append((dated == 1) & (year <= last))
    if f.min_ocr is not None:
        wishes.append(F.coalesce(F.col("ocr_quality"), F.lit(1.0)) >= f.min_ocr)
    return reduce(lambda a, b: a & b, wishes, F.lit(True))


def family(c: Column, name: str, families: dict[str, tuple[str, ...]]) -> Column:
    """A family's name stands for its members, any other value for itself."""
    return c.isin(*families.get(name, (name,)))


def without(rows: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the excluded; rows without a key stay."""
    return rows.join(excluded.select(key).distinct(), key, "left_anti")


def split(rows: DataFrame, policies: DataFrame, key: str, policy: str) -> tuple[DataFrame, DataFrame]:
    """Rows that no policy covers, and the others once for each policy that covers them."""
    return without(rows, policies, key), rows.join(policies.select(key, policy).distinct(), key)


def canonical_year(c: Column, first: int, last: int) -> Column:
    """A year from four digits, within bounds; else null."""
    y = F.when(F.trim(c).rlike(r"^\d{4}$"), F.trim(c).try_cast("int"))
    return F.when(y.between(first, last), y)


def number_heavy(text: str, years: int, share: float) -> Column:
    """Texts with so many years, or with digits making up more than a share of their characters."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = F.size(F.regexp_extract_all(t, F.lit(r"\b(1[89]\d\d|20\d\d)\b"), F.lit(1)))
    return (found >= years) | (F.char_length(F.regexp_replace(t, "[^0-9]", "")) > share * F.greatest(F.char_length(t), F.lit(1)))
