"""Care topics and crisis resources, cached answers, evidence states, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def without_accents(c: Column) -> Column:
    """Latin letters without their accents, for matching only."""
    return F.translate(F.coalesce(c, F.lit("")), ACCENTED, PLAIN)


def topics(text: Column, signals: dict[str, list[str]]) -> Column:
    """The topics, in the table's order, of which any pattern is in the text. signals: topic -> patterns, a rule table."""
    hay = without_accents(text)
    return F.array_compact(F.array(*[F.when(hay.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), topic) for topic, patterns in signals.items()]))


def basis_topics(text: Column, cited: Column, signals: dict[str, list[str]], cited_only: tuple[str, ...]) -> Column:
    """Topics of a row of an answer's basis; some count only where the row is cited."""
    return F.filter(topics(text, signals), lambda t: cited | ~t.isin(*cited_only))


def detected(rows: DataFrame, text: str, cited: str, signals: dict[str, list[str]], cited_only: tuple[str, ...], user_text: Column, upgrade: dict[str, tuple[str, str]], demotes: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row: the topics of an answer's basis and of what the visitor reads.

    upgrade: topic -> (pattern of context, topic in its place); demotes: a topic that the visitor's
    text is about -> topics that then do not count unless that text names them too. A context is
    looked for in each row and in the visitor's text by itself, so no row's text leaves its task.
    """
    context = lambda c, pattern: without_accents(c).rlike(f"(?i){pattern}")
    per = rows.select(basis_topics(F.col(text), F.col(cited), signals, cited_only).alias("b"), *[context(F.col(text), p).alias(f"fits_{i}") for i, (p, _) in enumerate(upgrade.values())])
    found = per.agg(F.array_distinct(F.flatten(F.collect_set("b"))).alias("t"), *[F.coalesce(F.bool_or(f"fits_{i}"), F.lit(False)).alias(f"fits_{i}") for i in range(len(upgrade))])  # as many lists as the signals allow
    own = topics(user_text, signals)
    every = F.array_union("t", own)
    for topic, dropped in demotes.items():
        every = F.when(F.array_contains(own, topic), F.filter(every, lambda x: ~x.isin(*dropped) | F.array_contains(own, x))).otherwise(every)
    for i, (topic, (pattern, better)) in enumerate(upgrade.items()):
        fits = F.col(f"fits_{i}") | context(user_text, pattern)
        every = F.transform(every, lambda x: F.when((x == topic) & fits, better).otherwise(x))
    return found.select(F.array_sort(every).alias("topics"))


def resources(topics_in_order: DataFrame, mapping: DataFrame) -> DataFrame:
    """resource, position: by topic, then by the topic's own order, each at its first place. topics: (pos, topic); mapping: (topic, ord, resource)."""
    return topics_in_order.join(mapping, "topic").groupBy("resource").agg(F.min(F.struct("pos", "ord")).alias("at")).orderBy("at").select("resource", "at.pos", "at.ord")


def term_flags(text: Column, terms: list[str]) -> Column:
    """The given terms that stand in the text as words, hyphens and spaces alike."""
    hay = F.lower(without_accents(text))
    pattern = lambda t: r"(^|[^\p{L}\p{N}_])" + r"[\s-]+".join(t.lower().split()) + r"($|[^\p{L}\p{N}_])"
    return F.array_compact(F.array(*[F.when(hay.rlike(pattern(t)), t) for t in terms]))


def withheld(salient: Column, uncovered: Column) -> Column:
    """struct(n, places): a question's words left out of a stored answer."""
    return F.struct(F.size(salient).alias("n"), F.filter(F.transform(uncovered, lambda t: (F.array_position(salient, t) - 1).cast("int")), lambda p: p >= 0).alias("places"))


def restored(kept: Column, salient: Column) -> Column:
    """The uncovered words back from their places; null where the question has another number of words."""
    return F.when(kept["n"] == F.size(salient), F.transform(F.filter(kept["places"], lambda p: p < F.size(salient)), lambda p: F.get(salient, p)))


def coverage_state(period: Column, place: Column, first: int, last: int, places: list[str]) -> Column:
    """Whether a refusal is because the holdings do not reach, or because they hold nothing."""
    start = F.when(period.rlike(r"^\d{4}s$"), F.substring(period, 1, 4).cast("int"))
    outside = (start + 9 < first) | (start > last)
    beyond = (period == "post-2009") & F.lit(last <= 2009) | (period == "pre-1960") & F.lit(first >= 1960)
    elsewhere = place.isNotNull() & ~place.isin(*places)
    return F.when(F.coalesce(outside, F.lit(False)) | F.coalesce(beyond, F.lit(False)) | elsewhere, "not_indexed").otherwise("absent_from_examined_holdings")


def proposed(quality: Column, text: Column, terms: Column, wanted: Column, place: Column) -> Column:
    """struct(relevance, why) proposed for a candidate; the first reason against it decides."""
    found = F.array_sort(F.filter(terms, lambda t: F.lower(F.coalesce(text, F.lit(""))).contains(t)))
    no = lambda why: F.struct(F.lit(0).alias("relevance"), F.lit(why).alias("why"))
    return F.when(F.coalesce(quality, F.lit(0.0)) < 0.33, no("low quality")).when(wanted.isNotNull() & place.isNotNull() & (wanted != place), no("other place")).when(
        F.size(found) >= 2, F.struct(F.lit(1).alias("relevance"), F.concat(F.lit("mentions "), F.array_join(F.slice(found, 1, 4), ", ")).alias("why"))
    ).otherwise(no("not clear"))


def warm(ts: Column, windows: list[tuple[tuple[int, ...], int, int]]) -> Column:
    """Whether a time falls in a window (days of the week from 0 for Sunday, first minute, last minute)."""
    day, minute = F.dayofweek(ts) - 1, F.hour(ts) * 60 + F.minute(ts)
    out = F.lit(False)
    for days, first, last in windows:
        out = out | (day.isin(*days) & (minute >= first) & (minute < last))
    return out


def audit_status(panel_meets: Column, queue_labelled: Column, silver_meets: Column) -> Column:
    return F.when(~queue_labelled, "AGREEMENT-WITH-REFERENCE-ONLY").when(panel_meets & F.coalesce(silver_meets, F.lit(False)), "AI-AUDITED").otherwise("NOT-AI-AUDITED")


def highlighted(text: Column, terms: Column, prefix: int = 5) -> Column:
    """array<struct(word, hit)>: words of a text that equal a term, its plural or share its first letters."""
    stem = lambda t: F.when((F.char_length(t) > 3) & t.endswith("s"), F.substring(t, 1, F.char_length(t) - 1)).otherwise(t)
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    bare = lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    same = lambda w, t: (stem(bare(w)) == stem(t)) | ((F.char_length(stem(t)) >= prefix) & bare(w).startswith(F.substring(stem(t), 1, prefix)))
    return F.transform(words, lambda w: F.struct(w.alias("word"), F.exists(terms, lambda t: same(w, t)).alias("hit")))


def ascending_evidence(hits: DataFrame, snippet: Column) -> DataFrame:
    """A trail of evidence by year, undated last."""
    return hits.withColumn("snippet", snippet).orderBy(F.asc_nulls_last("year"), "passage_id")
