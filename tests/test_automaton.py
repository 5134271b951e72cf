"""Ten thousand rules in one pass against one rule at a time."""

import random

from pyspark.sql import functions as F

from pressmark.operators import automaton, matching


def many(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 5)))
    rules = [(word() + (" " + word() if r.random() < 0.3 else ""), f"v{r.randrange(n // 3)}") for _ in range(n)]
    texts = [None, "", "ABC dé", *[" ".join(word() for _ in range(r.randrange(1, 60))) for _ in range(60)]]
    return rules, texts


def columns(spark, texts, *cs):
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    return [tuple(r)[1:] for r in sorted(made.select("i", *cs).collect())]


def test_ten_thousand_rules(spark):
    rules, texts = many(1, 10_000)
    sure = frozenset(p for p, _ in rules[::700])
    got = columns(spark, texts, automaton.first(F.col("t"), rules), automaton.agreeing(F.col("t"), rules, sure), automaton.every(F.col("t"), rules))
    for text, (one, all_, every) in zip(texts, got):
        hits = [(p, v) for p, v in rules if p in (text or "").lower()]
        assert tuple(one) == ((hits[0][1], hits[0][0]) if hits else (None, None))
        tagged = [h for h in hits if h[0] in sure]
        if not hits:
            want = (None, None)
        elif tagged:
            want = (tagged[0][1], tagged[0][0])
        else:
            want = (hits[0][1], hits[0][0]) if len({v for _, v in hits}) == 1 else (None, "ambiguous")
        assert tuple(all_) == want
        assert every == list(dict.fromkeys(v for _, v in hits))


def test_few_rules_as_the_native_columns(spark):
    rules, texts = many(2, 12)
    got = columns(spark, texts, automaton.first(F.col("t"), rules)["value"], matching.first_rule(F.col("t"), rules), automaton.agreeing(F.col("t"), rules)["value"], matching.only_value(F.col("t"), rules))
    assert all(a == b and c == d for a, b, c, d in got)
    assert columns(spark, ["x", None], automaton.first(F.col("t"), [])["value"], automaton.first(F.col("t"), [("", "any")])["value"]) == [(None, "any"), (None, "any")]


def test_terms_are_whole_words(spark):
    terms = ["of the", "Café", "e-mail", "x", ""]
    texts = ["a list of the things", "of - the", "off the", "CAFE, open", "cafes", "an e-mail", "an e mail", "of\n the x", None]
    assert [r[0] for r in columns(spark, texts, automaton.terms(F.col("t"), terms))] == [["of the"], ["of the"], [], ["Café"], [], ["e-mail"], [], ["of the", "x"], []]


def test_terms_by_place_as_by_their_own_patterns(spark, monkeypatch):
    """Gaps, hyphens within and around terms, equal joined forms, letters outside the first plane; no pattern is searched for a term without a hyphen."""
    r = random.Random(3)
    piece = lambda: r.choice(["a", "b", "ab", "é", "_", "1", " ", " ", "-", "- ", "\n", ".", "\U0001d7d8", "\x85"])
    wanted = ["a b", "a-b", "b", "ab a", "-a", "a-", "-", "é", "e", "a \U0001d7d8", "", " ", "_a", "a b", "b  a"]
    texts = ["".join(piece() for _ in range(r.randrange(1, 25))) for _ in range(3000)]
    plain = [" ".join(w.translate(automaton._PLAIN).lower().split()) for w in wanted]
    own = lambda t: [w for w, p in zip(wanted, plain) if p and automaton._as_words(p).search(t.translate(automaton._PLAIN).lower())]
    got = columns(spark, texts, automaton.terms(F.col("t"), wanted))
    assert [g[0] for g in got] == [own(t) for t in texts]
    made = automaton.Words(("a b", "b"))
    monkeypatch.setattr(automaton, "_as_words", None)
    assert made.found("b a-b ab") == [0, 1]


def test_a_filter_on_terms_looks_for_them_once(spark):
    made = spark.createDataFrame([("of the",), ("of",)], "t string").select(automaton.terms(F.col("t"), ["of the"]).alias("x")).filter(F.size("x") > 0)
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1 and made.count() == 1
