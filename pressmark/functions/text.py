"""Column functions on texts: tokens, terms, stems, folding, years and numbers.

Everything here is a native expression; a null text is treated as empty unless stated.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The frozen stop list in its three groups (function words, words of asking, words for who acts).
STOP_FUNCTION = """a an the and or but if so than as not no of to in on at by for from with about into over under
between through during before after i me my we our you your he him his she her it its they them their this that these
those is are was were be been being do does did have has had will would shall should can could may might must what
which who whom whose when where why how""".split()
STOP_ASKING = """describe explain discuss compare conclude conclusion conclusions recommend recommendation
recommendations report reported state stated say said address addressed identify shift shifted change changed evolve
evolved differ differed""".split()
STOP_ACTORS = "authorities authority officials government governments department departments ministry agency agencies".split()
STOPWORDS = STOP_FUNCTION + STOP_ASKING + STOP_ACTORS

TOKEN = r"[\p{L}\p{N}]+"
YEAR = r"\b(1[89]\d\d|20\d\d)\b"
PREFIX = 5


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


@F.pandas_udf(T.StringType())
def decoded_references(texts: pd.Series) -> pd.Series:
    """Character references of HTML as the characters they stand for; there are over two thousand names, so not natively."""
    return texts.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def composed_characters(texts: pd.Series) -> pd.Series:
    """Texts in Unicode's composed form (NFC), which Spark has no function for."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def normalised_question(c: Column | str) -> Column:
    """A question in composed characters, control characters and white space as single spaces."""
    return F.trim(F.regexp_replace(composed_characters(_text(c)), r"[\x00-\x20\x7F]+", " "))


@F.pandas_udf(T.StringType())
def without_marks(texts: pd.Series) -> pd.Series:
    """Texts without combining marks, after Unicode's compatibility decomposition (NFKD)."""
    return texts.map(lambda t: "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)), na_action="ignore")


def folded(c: Column | str) -> Column:
    """Lower case without accents; all but letters and digits of ASCII become single spaces."""
    return F.trim(F.regexp_replace(F.lower(without_marks(_text(c))), "[^a-z0-9]+", " "))


def year_spans(c: Column | str) -> Column:
    """array<struct(start, end)> of every year that stands by itself, as offsets in characters."""
    parts = F.split(_text(c), r"(?<![0-9A-Za-z_])(?:1[89]\d\d|20\d\d)(?![0-9A-Za-z_])", -1)  # what stands between years
    end = lambda ps, i: F.aggregate(F.slice(ps, 1, i), F.lit(0), lambda s, p: s + F.char_length(p) + 4)
    spans = lambda ps: F.transform(F.slice(ps, 1, F.size(ps) - 1), lambda p, i: F.struct((end(ps, i + 1) - 4).alias("start"), end(ps, i + 1).alias("end")))
    return F.transform(F.array(parts), spans)[0]


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(_text(c)), F.lit(TOKEN), F.lit(0))


def terms(c: Column | str) -> Column:
    """Tokens without stop words."""
    return F.filter(tokens(c), lambda t: ~t.isin(STOPWORDS))


def query_terms(c: Column | str) -> Column:
    """The distinct terms of a question; its tokens where all are stop words."""
    kept = F.array_distinct(terms(c))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array_distinct(tokens(c)))


def salient_terms(c: Column | str) -> Column:
    """Distinct terms of three letters or more, or four digits, in order."""
    return F.array_distinct(F.filter(terms(c), lambda t: (F.char_length(t) >= 3) | t.rlike("^[0-9]{4}$")))


def assist_terms(c: Column | str, stop: list[str]) -> Column:
    """Distinct tokens of four letters or more without digits and without the given words."""
    return F.array_distinct(F.filter(tokens(c), lambda t: (F.char_length(t) >= 4) & ~t.rlike(r"\p{N}") & ~t.isin(stop)))


def key_terms(c: Column | str, count: int = 3) -> Column:
    """The longest distinct terms, ties by word."""
    ranked = F.array_sort(F.transform(F.array_distinct(terms(c)), lambda t: F.struct((-F.char_length(t)).alias("n"), t.alias("t"))))
    return F.transform(F.slice(ranked, 1, count), lambda s: s["t"])


def stem(t: Column) -> Column:
    """One closing s off a word of more than three letters."""
    return F.when((F.char_length(t) > 3) & t.endswith("s"), F.substring(t, 1, F.char_length(t) - 1)).otherwise(t)


def squash(c: Column | str) -> Column:
    """Tokens joined by single spaces."""
    return F.array_join(tokens(c), " ")


def on_page(quote: Column | str, page: Column | str) -> Column:
    """Whether the quote's tokens stand on the page one after another."""
    q = squash(quote)
    return (q != "") & F.concat(F.lit(" "), squash(page), F.lit(" ")).contains(F.concat(F.lit(" "), q, F.lit(" ")))


def snippet(c: Column | str, size: int = 300) -> Column:
    """The first ``size`` characters with white space made single spaces."""
    return F.substring(F.trim(F.regexp_replace(_text(c), r"\s+", " ")), 1, size)


def years(c: Column | str) -> Column:
    """Every year from 1800 to 2099 that stands by itself, as integers in order."""
    return F.transform(F.regexp_extract_all(_text(c), F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))


def later_years(c: Column | str, year: Column) -> Column:
    """The distinct years in a text more than one after the given one, ascending."""
    return F.array_sort(F.array_distinct(F.filter(years(c), lambda y: y > year + 1)))


def numbers(c: Column | str) -> Column:
    """Distinct numbers of two digits or more, without separators."""
    found = F.regexp_extract_all(_text(c), F.lit(r"\d[\d,]*\d"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: F.regexp_replace(n, ",", "")))


def french_like(c: Column | str) -> Column:
    """Accented letters together with two or more common French words."""
    french = ["le", "la", "les", "des", "du", "et", "est", "dans", "pour", "une", "que", "qui", "sur", "avec"]
    return _text(c).rlike("[éèêàçùôîâ]") & (F.size(F.filter(tokens(c), lambda t: t.isin(french))) >= 2)


def contact_details(c: Column | str) -> Column:
    """Whether an e-mail address or a telephone number stands in the text."""
    return _text(c).rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}") | _text(c).rlike(r"\d{3}[-. ]\d{3}[-. ]\d{4}")


def clean_question(c: Column | str, limit: int = 500) -> Column:
    """Control characters and runs of white space become one space; at most ``limit`` characters."""
    return F.substring(F.trim(F.regexp_replace(_text(c), r"[\x00-\x20\x7F]+", " ")), 1, limit)


def smart_title(c: Column | str, small: tuple[str, ...] = ("of", "the", "and", "for", "in", "on", "de", "du", "des", "et", "la", "le")) -> Column:
    """Words in title case, small words after the first in lower case."""
    return F.array_join(
        F.transform(F.split(_text(c), " "), lambda w, i: F.when((i > 0) & F.lower(w).isin(*small), F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20))))), " "
    )


def fnv1a(c: Column | str) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-8 bytes."""
    pairs = F.filter(F.split(F.hex(F.encode(_text(c), "UTF-8")), "(?<=\\G..)"), lambda x: x != "")
    return F.aggregate(pairs, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(F.conv(x, 16, 10).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def windows(n: Column, width: int = 300, overlap: int = 40) -> Column:
    """Starts of windows of ``width`` tokens with an overlap; the last is the first that reaches the end."""
    step = max(1, width - overlap)
    last = F.greatest(F.lit(0), F.ceil((n - width) / F.lit(float(step)))) * step
    return F.when(n > 0, F.sequence(F.lit(0), last.cast("int"), F.lit(step))).otherwise(F.array().cast("array<int>"))
