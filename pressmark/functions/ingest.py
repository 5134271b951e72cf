"""Reading scanned texts: pages, quality, sections, derived dates, issuers, rights. Native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressmark.functions import periods
from pressmark.functions.sections import page_signals
from pressmark.functions.text import smart_title, squash

# Words that prose in English or French is sure to have (quality reads their share).
COMMON_WORDS = """the and of to in a is for on with as by that this was were are be an or at from which report health
public canada ontario alberta government department ministry hospital medical care disease board commission committee
services annual provincial federal ottawa toronto edmonton statistics welfare national year de la le les et des du une
un pour sur au aux dans par est sante publique rapport ministere gouvernement quebec publie""".split()

_WORD = r"[A-Za-zÀ-ſ][A-Za-zÀ-ſ'\-]{1,}"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def pages(c: Column | str) -> Column:
    """The pages of a text: its form-feed separated parts, in order."""
    return F.split(_text(c), "\f", -1)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def ocr_quality(c: Column | str) -> Column:
    """From 0 to 1 by surface: letters and digits, word-like tokens, common words, noisy lines, token length.

    The five weights are fixed values: 0.15, 0.25, 0.40, 0.10, 0.10. A blank text is 0.
    """
    t = _text(c)
    letters = lambda x: F.char_length(F.regexp_replace(x, r"[^\p{L}\p{N}]+", ""))
    solid = lambda x: F.char_length(F.regexp_replace(x, r"\s+", ""))
    lines = F.transform(F.filter(F.split(t, r"\r\n|\r|\n"), lambda x: F.trim(x) != ""), lambda x: F.struct(letters(x).alias("a"), solid(x).alias("n")))
    read = F.struct(lines.alias("lines"), F.regexp_extract_all(t, F.lit(_WORD), F.lit(0)).alias("words"), F.regexp_count(t, F.lit(r"\S+")).alias("tokens"))

    def score(r: Column) -> Column:
        total = lambda f: F.aggregate(r["lines"], F.lit(0), lambda s, x: s + x[f])
        n_lines, n_words = F.size(r["lines"]), F.size(r["words"])
        noisy = F.size(F.filter(r["lines"], lambda x: x["a"] < 0.5 * x["n"]))
        common = F.size(F.filter(r["words"], lambda w: F.lower(w).isin(COMMON_WORDS)))
        mean = _share(total("n"), r["tokens"])
        length = F.when(mean.between(2.5, 12.0), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(mean - 6) / 10))
        s = 0.15 * _share(total("a"), total("n")) + 0.25 * _share(n_words, r["tokens"]) + 0.40 * F.least(F.lit(1.0), 3 * _share(common, n_words)) + 0.10 * (1 - F.when(n_lines > 0, noisy / n_lines).otherwise(1.0)) + 0.10 * length
        return F.when(r["tokens"] == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)), 4))

    return F.transform(F.array(read), score)[0]  # the text is taken apart once


def signals(c: Column | str) -> Column:
    """What a page shows of front and back matter, as a struct."""
    return page_signals(_text(c))


def section(leaf: Column, leaves: Column, s: Column) -> Column:
    """struct(section, rule): front, body or back of a page by its signals; the first rule that holds decides."""
    front, back = periods.zones(leaf, leaves)
    lines = F.greatest(s["n_lines"], F.lit(1))
    alone = s["page_only"] / lines >= 0.3
    rules = [
        ("back", "references_heading", s["ref_head"] & ((s["cites"] >= 1) | (s["authors"] >= 2) | (s["numbered"] >= 3))),
        ("back", "index", s["index_head"] | (s["index_lines"] >= 8)),
        ("back", "reference_list", (s["cites"] >= 3) | ((s["cites"] >= 2) & (s["authors"] >= 2)) | (s["authors"] >= 5)),
        ("back", "back_zone_list", back & ((s["numbered"] >= 5) | (s["index_lines"] >= 4) | alone)),
        ("front", "cover", front & (leaf < 2)),
        ("front", "transmittal", front & s["transmittal"]),
        ("front", "contents", front & (s["toc"] | ((s["n_lines"] >= 3) & (s["leaders"] / lines >= 0.3)))),
        ("front", "title_page", front & (s["chars"] < 400) & (s["n_lines"] <= 12)),
        ("front", "front_zone_list", front & alone),
    ]
    out = F.struct(F.lit("body").alias("section"), F.lit("default").alias("rule"))
    for where, name, holds in reversed(rules):
        out = F.when(holds, F.struct(F.lit(where).alias("section"), F.lit(name).alias("rule"))).otherwise(out)
    return out


# How a page states its date, the more telling first, with what it is worth.
_Y = r"(1[89]\d\d|20[0-2]\d)"
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|janvier|fevrier|mars|avril|mai|juin|juillet|aout|septembre|octobre|novembre|decembre"
DATE_RULES = (
    ("copyright", rf"(?i)(?:\(c\)|copyright|droit d.auteur)[^0-9]{{0,40}}{_Y}"),
    ("imprint", rf"(?i)(?:printed in canada|imprim\w* au canada|published|publi\w+|cat(?:alogue|\.)\s*no\.?|isbn)[^\n]{{0,60}}?{_Y}"),
    ("dated_line", rf"(?i)\b(?:{MONTHS})\s+(?:\d{{1,2}},?\s+)?{_Y}"),
)


def derived_year(c: Column | str, title: Column | str) -> Column:
    """struct(year, method): the latest year of the first rule that finds one, then the title's latest, then the most common (the later of equals)."""
    t = _text(c)
    found = lambda text, pattern: F.array_max(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda y: y.cast("int")))
    bare = F.transform(F.regexp_extract_all(t, F.lit(rf"\b{_Y}\b"), F.lit(1)), lambda y: y.cast("int"))
    mode = F.array_max(F.transform(F.array_distinct(bare), lambda y: F.struct(F.size(F.filter(bare, lambda x: x == y)).alias("n"), y.alias("y"))))["y"]
    steps = [(name, found(t, p)) for name, p in DATE_RULES] + [("title", found(_text(title), rf"\b{_Y}\b")), ("year_mode", mode)]
    method = F.lit(None).cast("string")
    for name, y in reversed(steps):
        method = F.when(y.isNotNull(), name).otherwise(method)
    return F.struct(F.coalesce(*[y for _, y in steps]).alias("year"), method.alias("method"))


def decoded(raw: Column) -> Column:
    """A JSON list written into a text, joined with ``; ``; any other text as it is."""
    parsed = F.from_json(raw, "array<string>")
    return F.when(raw.isNull(), "").when(raw.rlike(r"^\[.*\]$") & parsed.isNotNull(), F.array_join(parsed, "; ")).otherwise(raw)


def clean_issuer(c: Column | str) -> Column:
    """The name of a body without what catalogues add to it."""
    first = F.get(F.split(_text(c), ";"), 0)
    own = F.get(F.split(first, " = "), 0)
    own = F.when(own.contains(" : "), F.regexp_replace(own, r"^.*? : ", "")).otherwise(own)
    s = F.regexp_replace(F.regexp_replace(own, r"[\[\]]", ""), r"(?i),?\s*issuing body\.?$", "")
    s = F.trim(F.regexp_replace(F.trim(F.regexp_replace(s, r"\s+", " ")), r"^[,.]+|[,.]+$", ""))
    upper, letters = F.regexp_count(s, F.lit(r"\p{Lu}")), F.regexp_count(s, F.lit(r"\p{L}"))
    return F.when((letters > 0) & (upper > 0.8 * letters), smart_title(s)).otherwise(s)


def anaphoric(s: Column) -> Column:
    """Whether a publisher only points back ("The Department", "the author")."""
    return F.trim(s).rlike(r"(?i)^(the|le|la|l')\s*(department|ministry|commission|board|committee|author|institute|council|service|auteur|ministere)\.?$")


def normal_issuer(creator: Column, publisher: Column, aliases: list[tuple[str, str]]) -> Column:
    """struct(value, method): the creator's name if it names a body, else the publisher's, by the longest alias it holds."""
    from pressmark.operators.matching import first_rule, longest_first

    names = [F.nullif(clean_issuer(decoded(c)), F.lit("")) for c in (creator, publisher)]
    name = F.coalesce(*[F.when(~anaphoric(n), n) for n in names])
    alias = first_rule(name, longest_first(aliases))
    method = F.when(name.isNull(), "unknown").when(alias.isNotNull(), "alias").otherwise("unmapped")
    return F.struct(F.coalesce(alias, name, F.lit("unknown")).alias("value"), method.alias("method"))


def jurisdiction(creator: Column, publisher: Column, collection: Column, title: Column) -> Column:
    """struct(value, method) of places already read from each: creator and publisher must not differ; then collection, then title."""
    clash = (creator != publisher) & creator.isNotNull() & publisher.isNotNull()
    value = F.when(clash, "unknown").otherwise(F.coalesce(creator, publisher, collection, title, F.lit("unknown")))
    method = F.when(clash, "unknown").when(creator.isNotNull(), "creator").when(publisher.isNotNull(), "publisher").when(collection.isNotNull(), "collection").when(title.isNotNull(), "title").otherwise("unknown")
    return F.struct(value.alias("value"), method.alias("method"))


def doc_type(title: Column, creator: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(value, method): the first rule that the title or else the creator holds."""
    t, c = F.lower(_text(title)), F.lower(_text(creator))
    out = F.struct(F.lit("other").alias("value"), F.lit("default").alias("method"))
    for pattern, value in reversed(rules):
        by = lambda m, v=value: F.struct(F.lit(v).alias("value"), F.lit(m).alias("method"))
        out = F.when(t.contains(pattern), by("title")).when(c.contains(pattern), by("creator")).otherwise(out)
    return F.when((t == "") & (c == ""), F.struct(F.lit("unknown").alias("value"), F.lit("unknown").alias("method"))).otherwise(out)


def rights(kind: Column, year: Column, exact: Column, this_year: int, crown: tuple[str, ...] = ("federal", "provincial", "territorial")) -> Column:
    """Public domain after 50 full years for Crown issuers with an exact date; else in copyright or unknown."""
    known = kind.isin(*crown) & year.isNotNull() & F.coalesce(exact, F.lit(False))
    return F.when(~F.coalesce(known, F.lit(False)), "UNKNOWN").when(year <= this_year - 51, "PD_CA_CROWN").otherwise("CROWN_IN_COPYRIGHT")


def cell_state(catalogue: Column, indexed: Column) -> Column:
    return F.when(indexed > 0, "recorded").when(catalogue.isNull(), "unknown").when(catalogue > 0, "not_indexed").otherwise("quiet_examined")


def dial_state(year: Column, items: Column, first: int, last: int) -> Column:
    return F.when(~year.between(first, last), "not_indexed").when(items > 0, "recorded").otherwise("quiet")


def compared_text(stored: Column, given: Column) -> Column:
    """exact where both have the same words; ascii_folded where only accents and signs differ; else differs."""
    accents, plain = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
    ascii_of = lambda c: squash(F.regexp_replace(F.translate(F.lower(_text(c)), accents, plain), r"[^\x00-\x7F]", ""))
    return F.when(squash(stored) == squash(given), "exact").when(ascii_of(stored) == ascii_of(given), "ascii_folded").otherwise("differs")


def verdict(exists: Column, matches: Column, link: Column, retrieved: Column) -> Column:
    """Of a sentence's citations (an aggregate): fail, unrecorded or pass."""
    sound = F.bool_and(exists & matches & link)
    return F.when(F.count("*") == 0, "fail").when(~sound, "fail").when(F.bool_or(~retrieved), "fail").when(F.bool_or(retrieved.isNull()), "unrecorded").otherwise("pass")


def quotes_on_page(sentence: Column | str, page: Column | str) -> Column:
    """array<struct(text, on_page)> of the quoted spans of three words or more."""
    spans = F.regexp_extract_all(_text(sentence), F.lit('["“]([^"“”]{3,400})["”]'), F.lit(1))
    long = F.filter(spans, lambda s: F.size(F.split(squash(s), " ")) >= 3)
    return F.transform(long, lambda s: F.struct(s.alias("text"), squash(page).contains(squash(s)).alias("on_page")))


def overclaims(c: Column | str) -> Column:
    """Phrases of change or disagreement in sentences without a negation."""
    sentences = F.split(_text(c), r"(?<=[.!?])\s+")
    claims = r"(?i)\b(shift|shifted|shifts|evolved|evolution|replaced|became|went from|led to|changed|changes|disagreed?|disagrees|contradicts?)\b"
    free = F.filter(sentences, lambda s: ~s.rlike(r"(?i)\b(not|cannot|can't|never|no|neither|nor)\b"))
    return F.flatten(F.transform(free, lambda s: F.regexp_extract_all(s, F.lit(claims), F.lit(0))))


def content_key(*columns: str) -> Column:
    """A digest of columns by name in sorted order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def page_link(base: str, item: Column, leaf: Column) -> Column:
    return F.format_string(f"{base}/%s/page/n%d", item, leaf)
