"""Plans that must hold at any scale: filters and columns reach the scan, nothing is paired without a key."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pressmark.operators import matching, ranking
from pressmark.tables import Tables

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    t = Tables(spark, FOLDER)
    p = plan(t.items.filter("jurisdiction = 'NATION_3'").select("item_id"))
    assert "EqualTo(n_name,NATION_3)" in p and "o_totalprice" not in p and "c_acctbal" not in p


def test_caps_are_pushed_below_the_shuffle(spark):
    t = Tables(spark, FOLDER)
    assert "WindowGroupLimit" in plan(ranking.capped(t.leaves, ["item_id"], [F.desc("quality"), F.col("leaf")], 2))
    assert "TakeOrderedAndProject" in plan(ranking.top(t.part, [F.desc("p_size"), F.col("p_partkey")], 5))


def test_rare_joins_have_keys(spark):
    hits = spark.createDataFrame([("p", "a", "x", 1990)], "phrase string, item_id string, issuer string, year int")
    for d in (matching.phrase_pairs(hits, 20, 2), matching.near_words(spark.createDataFrame([("a",)], "w string"), spark.createDataFrame([("b",)], "w string"))):
        assert "NestedLoop" not in plan(d) and "Cartesian" not in plan(d)


@pytest.mark.parametrize("name", sorted(k for k in entry.queries() if not k.startswith(("op", "pipeline"))))
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan(entry.queries()[name](spark, FOLDER))


@pytest.mark.parametrize("name", ["wn9_sequential_packing", "mx5_build_order", "mx13_plan_summary", "sc9_sc10_sections"])
def test_orders_need_no_single_task(spark, name):
    """Places, bins and digests go over sorted ranges: nothing is brought into one partition."""
    assert "SinglePartition" not in plan(entry.queries()[name](spark, FOLDER))
