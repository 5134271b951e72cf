"""What a page shows of front and back matter, by one scan of it in Arrow batches.

A page is lowered once and looked at for the few letters and line ends without which a pattern cannot match; only
then is the pattern itself searched for. Most pages show none of them. Letters count as in Python's ``re``: digits, white space and
word borders are Unicode's. A page with other letters than ASCII is searched by every pattern, for some of them are upper or lower
case of ASCII letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What headings and lines of front and back matter look like.
SIGNALS = {
    "toc": r"(?i)\b(table of )?contents\b|\blist of (tables|figures|appendices|illustrations)\b",
    "transmittal": r"(?i)letter of transmittal|i have the honou?r to (present|submit|transmit)|respectfully submitted",
    "index_head": r"(?im)^\s*(subject |general |alphabetical )?index\s*$",
    "ref_head": r"(?im)^\s*(references|bibliography|works cited|literature cited|sources consulted|selected bibliography)\s*$",
}
COUNTS = {
    "numbered": r"(?m)^\s*\(?\d{1,3}[.)]\s+\S",
    "cites": r"\b(1[89]\d\d|20\d\d)\b[^\n]{0,60}?(?:\b\d{1,4}\s*(?:\(\d+\))?\s*:\s*\d{1,4}\s*-\s*\d{1,4}\b|\bpp?\.\s*\d{1,4}\s*-\s*\d{1,4}\b)",
    "index_lines": r"(?m)^[A-Za-z][^\n]{2,60},\s*\d{1,4}(,\s*\d{1,4})*\s*$",
    "leaders": r"(?m)^(?=[^\n]*[A-Za-z])[^\n]*[ \t]\d{1,4}[ \t]*$|^[^\n]*\.{3,}[ \t]*\d{1,4}[ \t]*$",
    "page_only": r"(?im)^\s*([ivxlc]{1,6}|\d{1,4})\s*$",
}
AUTHOR = r"(?m)(?:^|\n|[.;]\s+)[A-Z][a-z'\-]{2,},?\s+(?:(?:[A-Z]\.){1,3},?|[A-Z]{1,3}[.,])(?:\s|$)"
YEAR = r"\b(1[89]\d\d|20\d\d)\b"
YEAR_WITHIN = 160  # characters after an author's initials and the white space that follows them

_PATTERNS = {k: re.compile(p) for k, p in (SIGNALS | COUNTS).items()}
_AUTHOR, _YEAR = re.compile(AUTHOR), re.compile(YEAR)
#: What a text in lower case must hold for a pattern to match it, where it is all ASCII.
_NEEDS = {
    "toc": ("contents", "list of "), "transmittal": ("transmittal", "i have the hono", "respectfully"), "index_head": ("index",),
    "ref_head": ("references", "bibliography", "cited", "consulted"),
}
_ENDS = re.compile(r"[0-9ivxlcIVXLC]\s*(?:\n|\Z)")
_DIGIT_ENDS = re.compile(r"[0-9]\s*(?:\n|\Z)")
_STARTS = re.compile(r"(?:\A|\n)\s*\(?[0-9]{1,3}[.)]")
_INITIAL = re.compile(r"\s[A-Z]{1,3}[.,]")
_RANGE = re.compile(r"[0-9]\s*-\s*[0-9]")
_FIELDS = ("n_lines", "chars", *SIGNALS, *COUNTS, "authors")


def author_entries(text: str) -> int:
    """Author openings with a year in the ``YEAR_WITHIN`` characters after them."""
    return sum(_YEAR.search(text, m.end(), m.end() + YEAR_WITHIN) is not None for m in _AUTHOR.finditer(text))


def scan(text: str) -> tuple:
    """n_lines (not blank), chars, the four signals, the five counts, authors."""
    plain = text.isascii()
    low = text.lower() if plain else text
    seen = {k: (not plain or any(n in low for n in _NEEDS[k])) and _PATTERNS[k].search(text) is not None for k in SIGNALS}
    # lines that end in a digit, or in a letter of a roman number; lines that begin with a number
    may = {
        "numbered": not plain or _STARTS.search(text) is not None,
        "cites": not plain or _RANGE.search(text) is not None,
        "page_only": not plain or _ENDS.search(text) is not None,
    }
    may["index_lines"] = may["leaders"] = not plain or may["page_only"] and _DIGIT_ENDS.search(text) is not None
    counts = (sum(1 for _ in _PATTERNS[k].finditer(text)) if may[k] else 0 for k in COUNTS)
    authors = author_entries(text) if not plain or _INITIAL.search(text) is not None else 0
    return (sum(1 for line in text.splitlines() if line and not line.isspace()), len(text), *seen.values(), *counts, authors)


def _scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([scan(t) for t in texts], columns=list(_FIELDS))


def _authors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([author_entries(t) for t in texts], dtype="int32")


def page_signals(text: Column) -> Column:
    """``scan`` of a text (null: empty) as a struct."""
    ddl = ", ".join(f"{k} {'boolean' if k in SIGNALS else 'int'}" for k in _FIELDS)
    return F.pandas_udf(_scanned, ddl)(F.coalesce(text, F.lit("")))


def authors(text: Column) -> Column:
    """``author_entries`` of a text (null: none)."""
    return F.pandas_udf(_authors, "int")(F.coalesce(text, F.lit("")))
