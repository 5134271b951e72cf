"""Review of pages, rounds, drafted items and labels; registers of policies; cached answers.

Checks give the reasons as an array of texts, empty where all is well; nothing is dropped by a check.
Defined cases: a null text holds no quote; a missing page is unresolved; a vote that is missing is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressmark.functions.ingest import overclaims, page_link
from pressmark.functions.text import on_page, salient_terms, squash, tokens


def reasons(**broken: Column) -> Column:
    """The names of the conditions that hold, in the order given (underscores in names are kept)."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in broken.items()]))


# -- pages


def year_line(text: Column, year: Column, context: int = 60) -> Column:
    """The stretch around the first place where the year stands by itself, cut at word edges; null where it does not."""
    t = F.coalesce(text, F.lit(""))
    at = F.regexp_instr(t, F.concat(F.lit(r"(?<![0-9A-Za-z_])"), year.cast("string"), F.lit(r"(?![0-9A-Za-z_])")))
    start, end = F.greatest(F.lit(0), at - 1 - context), F.least(F.char_length(t), at + 3 + context)
    piece = F.substring(t, start + 1, end - start)
    inside = lambda i: ~F.substring(t, i, F.lit(1)).rlike(r"^\s$")
    piece = F.when((start > 0) & inside(F.greatest(start, F.lit(1))), F.regexp_replace(piece, r"^\S+", "")).otherwise(piece)
    piece = F.when((end < F.char_length(t)) & inside(end + 1), F.regexp_replace(piece, r"\S+\z", "")).otherwise(piece)
    return F.when(at > 0, F.trim(F.regexp_replace(piece, r"\s+", " ")))


def cut_around(text: Column, keep: Column, most: int) -> Column:
    """A text of more than ``most`` characters cut to about so many at line breaks, around a kept quote (its start where it is missing)."""
    t = F.coalesce(text, F.lit(""))
    at = F.greatest(F.lit(0), F.position(F.lower(F.coalesce(keep, F.lit(""))), F.lower(t)) - 1)
    end = F.least(F.char_length(t), F.greatest(F.lit(0), at - most // 3) + most)
    start = F.greatest(F.lit(0), end - most)
    head = F.substring(t, F.lit(1), start + 1)
    begin = F.char_length(head) - F.char_length(F.substring_index(head, "\n", -1))
    stop = end + F.char_length(F.substring_index(F.substring(t, end + 1, F.char_length(t)), "\n", 1))
    return F.when(F.char_length(t) <= most, t).otherwise(F.substring(t, begin + 1, stop - begin))


def page_records(pages: DataFrame, items: DataFrame, dates: DataFrame, base: str) -> DataFrame:
    """Pages with their item's title, the date read for them and whether it agrees with an exact catalogue date, a link and a digest of their words.

    pages: item_id, leaf, text; items: item_id, title, year, date_method; dates: item_id, leaf, year, method.
    """
    read = dates.select("item_id", "leaf", F.col("year").alias("read_year"), F.col("method").alias("read_method"))
    rows = pages.join(items, "item_id").join(read, ["item_id", "leaf"], "left")
    agrees = F.coalesce((F.col("date_method") == "exact") & (F.col("read_year") == F.col("year")), F.lit(False))
    return rows.select(
        F.concat(F.col("item_id").cast("string"), F.lit("#"), F.col("leaf").cast("string")).alias("ref"), "title", "year", "read_method", agrees.alias("date_verified"), F.sha2(squash("text"), 256).alias("text_sha256"), page_link(base, F.col("item_id"), F.col("leaf")).alias("details_url")
    )


def question_pool(hits: DataFrame, per_decade: int) -> DataFrame:
    """The pages that a question may use: verified, dated and without care topics, each once, the best of each decade by rank, oldest first.

    hits: ref, decade, rank, year, verified, care (boolean).
    """
    fit = hits.filter(F.col("verified") & ~F.col("care") & F.col("year").isNotNull())
    once = fit.groupBy("ref").agg(F.min(F.struct("decade", "rank", "year")).alias("m")).select("ref", "m.decade", "m.rank", "m.year")
    best = once.withColumn("k", F.row_number().over(Window.partitionBy("decade").orderBy("rank", "ref"))).filter(F.col("k") <= per_decade)
    return best.select("ref", "decade", "rank", "year")


# -- rounds


def fingerprint(rounds: DataFrame, *leave_out: str) -> Column:
    """A digest of a round's fields without those of its review, by name in sorted order."""
    kept = sorted(c for c in rounds.columns if c not in leave_out)
    return F.sha2(F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}), 256)


def round_reasons(rounds: DataFrame, pages: DataFrame, quotes: DataFrame, corpus: DataFrame, items: DataFrame) -> DataFrame:
    """round, reasons: why a round may not go on, sorted; none where it may.

    rounds: round, mode, play_year; pages: round, ref, item_id, leaf, text, text_sha256, cat_year, read_year,
    read_line; quotes: round, quote, ref, text; corpus: item_id, leaf, text; items: item_id, year, date_method.
    """
    full = pages.join(corpus.withColumnRenamed("text", "full"), ["item_id", "leaf"], "left").join(items, "item_id", "left")
    gone = F.col("full").isNull()
    changed = ~gone & ((F.sha2(squash("full"), 256) != F.coalesce("text_sha256", F.lit(""))) | ~on_page("text", "full"))
    dated = (F.col("date_method") == "exact") & (F.col("year") == F.col("cat_year")) & (F.col("cat_year") == F.col("read_year")) & on_page("read_line", "full")
    said = reasons(page_unresolved=gone, page_text_changed=changed, date_unverified=~gone & ~F.coalesce(dated, F.lit(False)))
    of_pages = full.select("round", F.explode(F.transform(said, lambda r: F.concat(r, F.lit(":"), F.col("ref")))).alias("reason"))
    met = quotes.withColumnRenamed("text", "quoted").join(full.select("round", "ref", "text", "full"), ["round", "ref"]).filter("full is not null")
    of_quotes = met.filter(~(on_page("quoted", "full") & on_page("quoted", "text"))).select("round", F.concat(F.lit("quote_not_on_page:"), F.col("quote").cast("string")).alias("reason"))
    first = pages.groupBy("round").agg(F.min_by("cat_year", "ref").alias("first_year"))
    of_round = rounds.join(first, "round", "left").filter((F.col("mode") == "when_was_this") & ~F.col("play_year").eqNullSafe(F.col("first_year"))).select("round", F.lit("answer_year_unverified").alias("reason"))
    every = of_pages.unionByName(of_quotes).unionByName(of_round).groupBy("round").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))  # of one round
    return rounds.select("round").join(every, "round", "left").select("round", F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def release_problems(rounds: DataFrame, pages: DataFrame, quotes: DataFrame, base: str, publishable: tuple[str, ...]) -> DataFrame:
    """round, problem: what keeps a set of rounds from being released, one row each.

    rounds: round, status; pages: round, ref, item_id, leaf, text, details_url, cat_year, read_year, read_line; quotes: round, quote, ref, text.
    """
    status = rounds.filter(~F.coalesce(F.col("status").isin(*publishable), F.lit(False))).select("round", F.concat(F.lit("status "), F.coalesce("status", F.lit("none")), F.lit(" is not publishable")).alias("problem"))
    linked = F.col("details_url") == page_link(base, F.col("item_id"), F.col("leaf"))
    dated = (F.col("cat_year") == F.col("read_year")) & F.col("read_line").contains(F.col("cat_year").cast("string"))
    wrong = lambda c: ~F.coalesce(c, F.lit(False))
    said = F.array_compact(F.array(F.when(wrong(linked), "no link to its own page"), F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "no page text"), F.when(wrong(dated), "date is not verified")))
    of_pages = pages.select("round", F.explode(F.transform(said, lambda r: F.concat(F.col("ref"), F.lit(": "), r))).alias("problem"))
    met = quotes.withColumnRenamed("text", "quoted").join(pages.select("round", "ref", "text"), ["round", "ref"], "left")
    lost = F.when(F.col("text").isNull(), "names a page the round does not carry").when(~on_page("quoted", "text"), "is not in the page text")
    of_quotes = met.select("round", F.concat(F.lit("quote "), F.col("quote").cast("string"), F.lit(" "), lost).alias("problem")).filter("problem is not null")
    return status.unionByName(of_pages).unionByName(of_quotes)


def story_problems(stories: DataFrame, notes: DataFrame, comparable: tuple[str, ...]) -> DataFrame:
    """story, problem: what a story claims beyond what its pair supports, and replaced questions without a note.

    stories: story, caption, question, outcome, answer_question; notes: question, story.
    """
    beyond = ~F.coalesce(F.col("outcome").isin(*comparable), F.lit(False))
    said_in = lambda field: F.transform(overclaims(field), lambda p: F.concat(F.lit(f"{field} says "), p))
    claims = F.when(beyond, F.concat(said_in("caption"), said_in("question"))).otherwise(F.array().cast("array<string>"))
    said = stories.select("story", F.explode(claims).alias("problem"))
    replaced = stories.filter("answer_question is not null and answer_question <> question")
    no_answer_note = replaced.join(notes.select(F.col("question").alias("answer_question")).filter("answer_question is not null").distinct(), "answer_question", "left_anti").select("story", F.lit("answers a different question with no note on that answer").alias("problem"))
    no_story_note = replaced.join(notes.select("story").filter("story is not null").distinct(), "story", "left_anti").select("story", F.lit("question was replaced with no note on the story").alias("problem"))
    return said.unionByName(no_answer_note).unionByName(no_story_note)


# -- drafted items, votes and labels


def audit_items(sentences: DataFrame) -> DataFrame:
    """One item for each sentence and one for each answer: kind, item, q, sentence_no, text, answer_text. sentences: q, sentence_no, text."""
    parts = sentences.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("sentence_no", F.coalesce("text", F.lit("")).alias("text")))).alias("s"))  # an answer's sentences
    whole = parts.select("q", "s", F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("answer_text"))
    each = whole.select("q", "answer_text", F.explode("s").alias("x")).select(F.lit("sentence").alias("kind"), F.concat_ws(":", F.col("q").cast("string"), F.col("x.sentence_no").cast("string")).alias("item"), "q", F.col("x.sentence_no").alias("sentence_no"), F.col("x.text").alias("text"), "answer_text")
    answers = whole.select(F.lit("answer").alias("kind"), F.concat(F.col("q").cast("string"), F.lit(":answer")).alias("item"), "q", F.lit(None).cast(sentences.schema["sentence_no"].dataType).alias("sentence_no"), F.lit(None).cast("string").alias("text"), "answer_text")
    return each.unionByName(answers)


def review_share(agreed: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """A share of the agreed passes, rounded up, one at least, by a hash of a seed and the key: a resumed run reviews the same."""
    ids = agreed.select(key).distinct()
    most = ids.agg(F.ceil(F.count("*") * share - 1e-9).alias("most"))
    order = F.sha2(F.concat(F.lit(f"review:{seed}:"), F.col(key).cast("string")), 256)
    placed = ids.withColumn("r", F.row_number().over(Window.orderBy(order, key)))  # the items of one audit, which people review
    return placed.crossJoin(F.broadcast(most)).filter((F.col("r") <= F.greatest("most", F.lit(1))) & (F.lit(share) > 0)).select(key)


def binary(label: Column) -> Column:
    """pass or not_pass; an unknown label stays unknown."""
    return F.when(label.isNull(), None).when(label == "pass", "pass").otherwise("not_pass")


def flagged(silver: Column, queued: Column, final: Column) -> Column:
    """Whether a drafted item needs a person: a reference did not pass it, the panel left it open, or the panel's last word is no pass. silver, final: arrays of labels."""
    bad = lambda labels, known: F.coalesce(F.exists(labels, lambda v: known(v)), F.lit(False))
    return bad(silver, lambda v: ~v.eqNullSafe("pass")) | F.coalesce(queued, F.lit(False)) | bad(final, lambda v: v.isNotNull() & (v != "pass"))


def pair_finals(a: Column, b: Column, escalation: Column) -> tuple[Column, Column]:
    """(final, escalated) of two votes: what they agree on; else the third vote if it is one of theirs. escalation: null where nobody is asked."""
    agree = F.coalesce(a == b, F.lit(False))
    third = F.when(F.coalesce(escalation == a, F.lit(False)) | F.coalesce(escalation == b, F.lit(False)), escalation)
    return F.when(agree, a).otherwise(third), ~agree


def contributions(ok: Column, refused: Column, should_refuse: Column, sources: Column, first_ten: Column, state: Column, expected: Column) -> Column:
    """Each metric of one item as a pair (num, den), so that a rate is a ratio of sums. sources, first_ten: arrays of pages."""
    pair = lambda num, den: F.struct(F.when(den, num.cast("int")).otherwise(0).alias("num"), den.cast("int").alias("den"))
    ok, refused, should = (F.coalesce(c, F.lit(False)) for c in (ok, refused, should_refuse))
    return F.struct(
        pair(F.arrays_overlap(sources, first_ten), ok & (F.size(sources) > 0) & ~should).alias("recall_at_10"), pair(refused, ok & should).alias("refusal_rate"), pair(refused, ok & ~should).alias("false_refusal_rate"), pair(F.coalesce(state == expected, F.lit(False)), ok).alias("state_accuracy"),
    )


def applied_labels(decisions: DataFrame, worksheet: DataFrame, candidates: int) -> DataFrame:
    """q, passage_id, relevance for every candidate, or an error that names the first question that is not sound: all or nothing.

    decisions: q, verdict (a or x), relevant (array of ranks); worksheet: q, rank, passage_id.
    """
    per = worksheet.groupBy("q").agg(F.count("*").alias("n"), F.collect_set("rank").alias("ranks"))  # a question's candidates
    wrong = F.when(F.col("n").isNull(), "missing from the worksheet").when(F.col("n") != candidates, "another number of candidates").when(~F.coalesce(F.col("verdict").isin("a", "x"), F.lit(False)), "no verdict").when(F.size(F.array_except("relevant", "ranks")) > 0, "a rank without a record")
    faults = decisions.join(per, "q", "left").select("q", wrong.alias("fault")).filter("fault is not null")
    first = faults.agg(F.min(F.concat_ws(": ", F.col("q").cast("string"), "fault")).alias("fault"))
    sound = first.select(F.when(F.col("fault").isNotNull(), F.raise_error("fault")).otherwise(F.lit(True)).alias("sound"))
    rows = worksheet.join(decisions, "q").crossJoin(F.broadcast(sound)).filter("sound")  # one row
    return rows.select("q", "passage_id", F.array_contains("relevant", F.col("rank")).cast("int").alias("relevance"), (F.col("verdict") == "a").cast("int").alias("answerable"))


def scope_hints(text: Column, asked_place: Column, words: dict[str, str], end_year: int, early: int = 1930) -> tuple[Column, Column]:
    """(place, problem) of a question: the place asked for, else the first word that names one; a period that lies outside."""
    place = F.lit(None).cast("string")
    for word, value in reversed(words.items()):
        place = F.when(F.lower(text).contains(word), value).otherwise(place)
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\b(1[89]\d\d|20\d\d)\b"), F.lit(1)), lambda y: y.cast("int"))
    said = F.size(years) > 0
    problem = F.when(said & F.forall(years, lambda y: y > end_year), "period after the window").when(said & F.forall(years, lambda y: y < early), "very early period")
    return F.coalesce(asked_place, place), problem


def worksheet(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows to label: for each question a summary and its candidates by rank with a proposal. questions: q, text; hits: q, passage_id, rank, text."""
    asked = questions.select("q", salient_terms("text").alias("terms"))  # once a question, not once a hit
    rows = hits.join(asked, "q").withColumn("found", F.size(F.array_intersect("terms", tokens("text"))))
    candidates = rows.select(F.lit("candidate").alias("kind"), "q", "rank", "passage_id", (F.col("found") >= 2).cast("int").alias("proposed"))
    any_of = candidates.groupBy("q").agg(F.max("proposed").alias("best"))
    none = lambda kind: F.lit(None).cast(kind)
    summary = questions.join(any_of, "q", "left").select(F.lit("summary").alias("kind"), "q", none(candidates.schema["rank"].dataType).alias("rank"), none(candidates.schema["passage_id"].dataType).alias("passage_id"), F.coalesce("best", F.lit(0)).alias("proposed"))
    return summary.unionByName(candidates)


def upserted_questions(have: DataFrame, records: DataFrame, kinds: tuple[str, ...], replace: bool) -> DataFrame:
    """q, text, qtype after records are added or, with ``replace``, take the place of those with their id; an unknown type is an error."""
    known = F.col("qtype").isNull() | F.col("qtype").isin(*kinds)
    sound = records.withColumn("qtype", F.when(known, F.col("qtype")).otherwise(F.raise_error(F.concat(F.lit("no such type: "), "qtype"))))
    base, more = (have.join(sound.select("q"), "q", "left_anti"), sound) if replace else (have, sound.join(have.select("q"), "q", "left_anti"))
    return base.select("q", "text", "qtype").unionByName(more.select("q", "text", "qtype"))


# -- trap questions


def other_decade(year: Column, key: Column, first: int, last: int, seed: str, away: int = 30) -> Column:
    """A decade of the window at least so many years from the year's, chosen by a hash of the key; null where there is none."""
    own = F.floor(year / 10) * 10
    fit = F.filter(F.array(*[F.lit(d) for d in range(first // 10 * 10, last + 1, 10)]), lambda d: F.abs(d - own) >= away)
    return F.when(F.size(fit) > 0, F.concat(F.get(fit, _pick(key, F.size(fit), seed)).cast("string"), F.lit("s")))


def other_place(place: Column, key: Column, allowed: tuple[str, ...], seed: str) -> Column:
    """Another place of those allowed, chosen by a hash of the key."""
    fit = F.filter(F.array(*map(F.lit, allowed)), lambda p: p != place)
    return F.when(F.size(fit) > 0, F.get(fit, _pick(key, F.size(fit), seed)))


def _pick(key: Column, n: Column, seed: str) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), key.cast("string")), 256), 1, 12), 16, 10).cast("long")
    return F.pmod(h, F.greatest(n, F.lit(1))).cast("int")


def trap_question(kind: str, topic: Column, place: Column, when: Column | None = None) -> Column:
    """The words of a trap built from a topic: what a place published about it (in a decade, from a year)."""
    clean = F.regexp_replace(topic, r"[ .?]+$", "")
    period = {"wrong_period": lambda: F.concat(F.lit(" from the "), when), "wrong_year": lambda: F.concat(F.lit(" from "), when), "wrong_place": lambda: F.lit("")}[kind]()
    return F.concat(F.lit("What did "), place, F.lit(" government publications"), period, F.lit(" report about "), clean, F.lit("?"))


def question_sound(question: Column) -> Column:
    """From 15 to 300 characters, ending in a question mark, and not about "this page"."""
    q = F.coalesce(question, F.lit(""))
    return F.char_length(q).between(15, 300) & F.trim(q).endswith("?") & ~q.rlike(r"(?i)\b(this|the) (page|document|passage|text|scan)\b")


def quote_found(quote: Column, text: Column) -> Column:
    """Whether a quote of two words or more stands in a text, by its words."""
    q = squash(quote)
    return (F.size(F.split(q, " ")) >= 2) & squash(text).contains(q)


# -- citations


def corpus_citations(cites: DataFrame, passages: DataFrame, base: str) -> DataFrame:
    """Each citation with exists, item_matches, leaf_matches, text_class, link_ok, retrieved. cites: cite, passage_id, item_id, leaf, text, link, retrieved (tri-state)."""
    from pressmark.functions.ingest import compared_text

    known = passages.select("passage_id", F.col("item_id").alias("own_item"), F.col("leaf").alias("own_leaf"), F.col("text").alias("own_text"))
    rows = cites.join(known, "passage_id", "left")
    there = F.col("own_item").isNotNull()
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return rows.select(
        "cite", there.alias("exists"), same("item_id", "own_item").alias("item_matches"), same("leaf", "own_leaf").alias("leaf_matches"), F.when(there, compared_text(F.col("own_text"), F.col("text"))).otherwise("missing").alias("text_class"),
        F.coalesce(F.col("link") == page_link(base, F.col("own_item"), F.col("own_leaf")), F.lit(False)).alias("link_ok"), "retrieved",
    )


def supplied_citations(cites: DataFrame, rows: DataFrame, base: str) -> DataFrame:
    """Each cited passage checked against supplied rows alone: exists, in_evidence, resolves, link. cites: answer, passage_id, in_evidence; rows: answer, passage_id, item_id, leaf."""
    known = rows.select("answer", "passage_id", "item_id", "leaf", F.lit(True).alias("there"))
    met = cites.join(known, ["answer", "passage_id"], "left")
    resolves = F.col("item_id").isNotNull() & F.col("leaf").isNotNull()
    return met.select("answer", "passage_id", F.coalesce("there", F.lit(False)).alias("exists"), "in_evidence", resolves.alias("resolves"), F.when(resolves, page_link(base, F.col("item_id"), F.col("leaf"))).alias("link"))


# -- registers and caches


def policy_problems(policies: DataFrame, fixtures: bool, uses: tuple[str, ...]) -> DataFrame:
    """policy_id, problems of a register: no id, uses that are not known, an id twice, and fixtures where none may be (or others where only they may).

    policies: policy_id, restrict (array), fixture.
    """
    twice = F.count("*").over(Window.partitionBy("policy_id")) > 1
    said = reasons(no_id=F.col("policy_id").isNull(), unknown_use=F.size(F.array_except("restrict", F.array(*map(F.lit, uses)))) > 0, duplicate=F.col("policy_id").isNotNull() & F.col("twice"), fixture=F.coalesce("fixture", F.lit(False)) & F.lit(not fixtures), no_fixture=~F.coalesce("fixture", F.lit(False)) & F.lit(fixtures))
    return policies.withColumn("twice", twice).select("policy_id", said.alias("problems"))


def appended(path: str, rows: DataFrame) -> None:
    """Adds rows to a trail that is only ever added to: nothing here rewrites what is there."""
    rows.write.mode("append").parquet(path)


def unaltered(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: whether every row of a trail as it was is still there, and how many are new."""
    lost = before.exceptAll(after).agg(F.count("*").alias("lost"))
    n = before.agg(F.count("*").alias("old")).crossJoin(after.agg(F.count("*").alias("all_rows")))
    return lost.crossJoin(n).select((F.col("lost") == 0).alias("kept"), (F.col("all_rows") - F.col("old") + F.col("lost")).alias("added"))  # one row each


def capped_expiry(created: Column, asked: Column, days: int, now: Column) -> Column:
    """The earlier of what was asked and creation plus retention; an unreadable creation counts as now, an unreadable wish as the latest."""
    latest = F.coalesce(F.try_to_timestamp(created), now) + F.expr(f"INTERVAL {days} DAYS")
    return F.least(F.try_to_timestamp(asked), latest)


def row_problems(key: Column, curated: Column, question: Column, expires: Column) -> Column:
    """What keeps a cache row from being written."""
    plain = ~F.coalesce(curated, F.lit(False))
    return reasons(key_is_no_digest=~F.coalesce(key.rlike("^[0-9a-f]{64}$"), F.lit(False)), question_kept=plain & question.isNotNull(), no_expiry=plain & expires.isNull())


def context_key(data: dict[str, Column], settings: dict[str, Column]) -> Column:
    """A digest of all that decides an answer but its question: digests of data (64 hexadecimal digits, else an error) and settings by name."""
    checked = [F.when(F.lower(c).rlike("^[0-9a-f]{64}$"), F.lower(c)).otherwise(F.raise_error(F.lit(f"{k} is no digest"))).alias(k) for k, c in sorted(data.items())]
    return F.sha2(F.to_json(F.struct(F.struct(*checked).alias("data"), F.struct(*[settings[k].alias(k) for k in sorted(settings)]).alias("settings"))), 256)


def router_filters(place: Column, period: Column, year_from: Column, year_to: Column, as_of: Column) -> Column:
    """struct(place, first_year, last_year) that a router needs of a question's filters: bounds of years go before a decade."""
    decade = F.when(period.rlike(r"^\d{4}s$"), F.substring(period, 1, 4).cast("int"))
    leading = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*(-?\d+)", 1), F.lit("")).cast("int")
    return F.struct(F.nullif(place, F.lit("")).alias("place"), F.coalesce(leading(year_from), decade).alias("first_year"), F.coalesce(leading(F.coalesce(year_to, as_of)), decade + 9).alias("last_year"))
