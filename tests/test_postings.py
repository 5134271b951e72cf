"""Postings and frequencies are counted where a text lies; rows of one key count together."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pressmark.operators import retrieval as S

ONE = [(1, "en", "b a b"), (2, "en", ""), (3, "fr", None), (4, "fr", "A é 7 a"), (5, None, "a")]
MANY = [*ONE, (1, "fr", "b c"), (None, "en", "a b"), (6, "en", "z")]


def made(spark, rows):
    return spark.createDataFrame(rows, "k int, g string, t string")


@pytest.mark.parametrize("rows", [ONE, MANY, [(None, "en", "a b a"), *ONE]])
def test_postings_and_frequencies(spark, rows):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    tf = Counter((k, w) for k, _, t in rows for w in words(t))
    df = made(spark, rows)
    assert {(r.k, r.term): r.tf for r in S.postings(df, "k", "t").collect()} == dict(tf)
    want = Counter((g, w) for k, g, _ in rows if k is not None for w in {w for i, w in tf if i == k})
    assert {(r.g, r.term): r.df for r in S.frequencies_by(df, "k", "t", "g").collect()} == dict(want)


def test_nothing_but_counts_is_shuffled(spark):
    df = made(spark, ONE)
    assert "Exchange" not in S.postings(df, "k", "t")._jdf.queryExecution().executedPlan().toString()
    for rows in (S.frequencies_by(df, "k", "t", "g"), entry.queries()["ag15_shard_statistics"](spark, "/root/testdata/sf0.001")):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "partial_count" in plan
    assert "keys=[doc_id" in (plan := entry.queries()["sc35_lexicon_rate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()) and not re.search(r"keys=\[doc_id#\d+L?, w#", plan)


def test_an_index_is_shuffled_once(spark, tmp_path, monkeypatch):
    plans = []
    true = S.DataFrame.repartition
    monkeypatch.setattr(S.DataFrame, "repartition", lambda self, *a: plans.append(self._jdf.queryExecution().executedPlan().toString()) or true(self, *a))
    S.write_index(made(spark, ONE), "k", "t", f"{tmp_path}/i", 4)
    assert len(plans) == 1 and "Exchange" not in plans[0]
    read = spark.read.parquet(f"{tmp_path}/i/postings")
    assert sorted((r.term, r.k, r.tf, r.dl) for r in read.collect()) == [("7", 4, 1, 4), ("a", 1, 1, 3), ("a", 4, 2, 4), ("a", 5, 1, 1), ("b", 1, 2, 3), ("é", 4, 1, 4)]
    assert read.filter(F.col("term") == "a").count() == 3
