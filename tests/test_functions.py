"""Functions against plain Python, and every query without SQL."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pressmark.functions import ingest as I
from pressmark.functions import periods as P
from pressmark.functions import text as T
from pressmark.operators import evaluation, filters, matching, metadata, packing

FOLDER = "/root/testdata/sf0.001"


def one(spark, column, *values, schema="t string"):
    rows = spark.createDataFrame([tuple(v) if isinstance(v, (tuple, list)) else (v,) for v in values], schema)
    return [r[0] for r in rows.select(column).collect()]


def fnv(s):
    h = 2166136261
    for b in s.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h


def test_text(spark):
    words = ["", "a", "santé", "Hôpital 12", "the of"]
    assert one(spark, T.fnv1a("t"), *words) == [fnv(w) for w in words]
    assert one(spark, T.tokens("t"), "Santé, l'Hôpital 12!", None) == [["santé", "l", "hôpital", "12"], []]
    assert one(spark, T.query_terms("t"), "What is the", "the bed beds bed") == [["what", "is", "the"], ["bed", "beds"]]
    assert one(spark, T.windows(F.col("n")), 0, 1, 300, 301, 560, 561, 821, schema="n int") == [[], [0], [0], [0, 260], [0, 260], [0, 260, 520], [0, 260, 520, 780]]
    assert one(spark, T.key_terms("t", 2), "the longest words lengths") == [["lengths", "longest"]]
    assert one(spark, T.numbers("t"), "in 1,234 of 7 and 56, 56") == [["1234", "56"]]


def test_periods(spark):
    raw = ["1986-01-01", "1969/1970", "197-", "c1999", "", None, "9999", "no"]
    assert [(r["year"], r["method"]) for r in one(spark, P.parse_date(F.col("t")), *raw)] == [(1986, "exact"), (1969, "range"), (None, "partial"), (1999, "exact"), (None, "unknown"), (None, "unknown"), (None, "unknown"), (None, "unknown")]
    assert one(spark, P.title_year(F.col("t")), "1987-88 report", "for the year ending December 1990 and 1991", "1990 to 1991", "in 1975", None) == [1987, 1990, None, 1975, None]
    assert one(spark, P.period_of(F.col("y"), F.col("d")), (1959, 1), (1960, 1), (2009, 1), (2010, 1), (1990, 0), (None, 1), schema="y int, d int") == ["pre-1960", "1960s", "2000s", "post-2009", "undated", "undated"]
    with pytest.raises(ValueError):
        P.period_predicate("1965", F.col("y"), F.col("d"))


def test_quality_and_sections(spark):
    good = "The annual report of the department of health to the board of the province was tabled in the year for the public.\n" * 4
    q = one(spark, I.ocr_quality("t"), good, "~~ ## 1! ,, ;; .. ^^", "", None)
    assert q[0] > 0.9 and q[1] < 0.3 and q[2] == q[3] == 0.0
    texts = ["LETTER OF TRANSMITTAL", "References\n1. Smith J 1999\n2. B\n3. C", "plain " * 200, "Index\n", "x"]
    rows = spark.createDataFrame([(i + (0 if i == 4 else 2), 100, t) for i, t in enumerate(texts)], "leaf int, n int, t string")
    got = [tuple(r[0]) for r in rows.select(I.section(F.col("leaf"), F.col("n"), I.signals("t"))).collect()]
    assert got == [("front", "transmittal"), ("back", "references_heading"), ("body", "default"), ("back", "index"), ("front", "title_page")]


def test_issuers(spark):
    assert one(spark, I.clean_issuer("t"), "OTTAWA : HEALTH AND WELFARE [CANADA], issuing body.", "Body = Corps; Other", None, "Statistics  Canada.") == ["Health and Welfare Canada", "Body", "", "Statistics Canada"]
    n = one(spark, I.normal_issuer(F.col("a"), F.col("b"), [("health", "Short"), ("health and welfare", "Long")]), ("The Department", "Health and Welfare Canada"), (None, None), ('["Acme", "B"]', "x"), schema="a string, b string")
    assert [tuple(x) for x in n] == [("Long", "alias"), ("unknown", "unknown"), ("Acme", "unmapped")]
    assert [tuple(x) for x in one(spark, I.derived_year("t", F.lit("Vol 1950")), "(c) 1987, 1991 Ottawa", "March 3, 1990 and May 1988", "none", schema="t string")] == [(1987, "copyright"), (1990, "dated_line"), (1950, "title")]


def test_gates(spark):
    assert one(spark, I.compared_text(F.col("a"), F.col("b")), ("Santé!", "santé"), ("santé", "sante"), ("a", "b"), (None, ""), schema="a string, b string") == ["exact", "ascii_folded", "differs", "exact"]
    assert one(spark, I.overclaims("t"), "It changed. It never changed. Nothing here.", None) == [["changed"], []]
    q = one(spark, I.quotes_on_page(F.col("a"), F.col("b")), ('He said "the three words" and "two words"', "with the THREE words in it"), schema="a string, b string")
    assert [(x["text"], x["on_page"]) for x in q[0]] == [("the three words", True)]


def test_constraints():
    read = lambda q: (lambda c: (c.years, c.as_of))(metadata.read(q))
    assert read("between 1980 and 1974, then 1999") == (((1974, 1980), (1999, 1999)), None)
    assert read("as of 1990 in the 1960s") == (((1960, 1969),), 1990)
    assert read("1974-1979") == (((1974, 1979),), None)
    assert metadata.read("In Nova Scotia", ("nova scotia", "scot")).places == ("nova scotia",)


def test_filters_and_rules(spark):
    f = filters.Filters(jurisdiction="  a ", min_ocr=0.123456).canonical()
    assert (f.jurisdiction, f.min_ocr) == ("a", 0.1235)
    rows = spark.createDataFrame([("a", None), ("b", "x"), (None, "y")], "k string, v string")
    assert {r.v for r in filters.without(rows, rows.filter("k = 'b'"), "k").collect()} == {None, "y"}
    assert one(spark, matching.only_value(F.col("t"), [("a", "1"), ("b", "1"), ("c", "2")]), "ab", "ac", "z", None) == ["1", None, None, None]


def test_orphans_fail_loud(spark):
    child, parent = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception):
        matching.resolved(child, parent, "k", "v").collect()
    assert [r.v for r in matching.resolved(child.filter("k = 1"), parent, "k", "v").collect()] == ["x"]


def test_undefined_measures(spark):
    ranking = spark.createDataFrame([("q", "d", 1), ("p", "d", 1)], "q string, doc string, rank int")
    gold = spark.createDataFrame([("q", "d")], "q string, doc string")
    assert {(r.q, r.recall) for r in evaluation.recall(ranking, gold, 5).collect()} == {("q", 1.0), ("p", None)}
    none = spark.createDataFrame([], "a int, b int")
    assert evaluation.kappa(none, "a", "b").first().kappa is None
    same = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert evaluation.kappa(same, "a", "b").first().kappa is None
    said = spark.createDataFrame([(166, 178), (0, 0)], "k long, n long").select(evaluation.rate_text(F.col("k"), F.col("n")).alias("s")).collect()
    assert [r.s for r in said] == ["93.3% (166/178, 95% CI 88.6-96.1%)", "n/a"]


def test_shard_plan(spark):
    docs = spark.createDataFrame([("a", "p", 1990, 6.0), ("b", "p", 1991, 6.0), ("c", "p", None, 1.0), ("d", "q", 1990, 1.0), ("e", "p", 1990, 3.0)], "item_id string, place string, year int, size double")
    got = {r.item_id: r.shard for r in packing.plan_shards(docs, 10.0, 5.0).collect()}
    assert got == {"a": "p-1990", "e": "p-1990", "b": "p-1991", "c": "p-undated", "d": "other-1990"}


@pytest.mark.parametrize("name", sorted(k for k in entry.queries() if k not in entry.oracle_sql() and not k.startswith(("op", "pipeline"))))
def test_rows_only(spark, name):
    rows = entry.queries()[name](spark, FOLDER)
    assert len(set(rows.columns)) == len(rows.columns) and rows.count() >= 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
