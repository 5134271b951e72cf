"""Tasks of joins by an item's key: their number goes with the rows, so that the memory of one does not."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pressmark import tables
from pressmark.operators import answers
from pressmark.plans import files
from pressmark.session import setting

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["sc48_page_dated", "sc29_year_check", "mx94_label_worksheet"])
def test_rows_are_dealt_once_over_as_many_tasks_as_they_need(spark, monkeypatch, name):
    monkeypatch.setattr(tables, "TASK_ROWS", 500, raising=False)
    tasks = -(-spark.read.parquet(f"{FOLDER}/lineitem.parquet").count() // 500)
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"Exchange hashpartitioning\([^()]*, (\d+)\), (\w+)", plan)) == {(str(tasks), "REPARTITION_BY_NUM")} and "ENSURE_REQUIREMENTS" not in plan


def test_a_year_is_looked_for_without_pairs_of_pages(spark):
    r = random.Random(5)
    pages = [(i, leaf, " ".join(str(r.randrange(1990, 1996)) for _ in range(r.randrange(3)))) for i in range(8) for leaf in [None, *range(-1, 12), 3, 3]] + [(7, 1, None)]
    rows = [(i, r.choice([None, *range(-2, 14)]), r.choice([None, *range(1989, 1997)])) for i in range(9) for _ in range(40)]
    made = answers.page_dated(spark.createDataFrame(rows, "item_id int, leaf int, year int"), spark.createDataFrame(pages, "item_id int, leaf int, text string"))

    def want(i, leaf, year):
        found = [p for k, p, text in pages if k == i and p is not None and leaf is not None and str(year) in (text or "")]
        front = [p for p in found if p < 6]
        at = leaf if leaf in found else min(front, default=None)
        return i, leaf, year if at is not None else None, "not_found" if at is None else "read_from_page" if at == leaf else "read_from_front_matter", at

    asked = [x for x in rows if x[1] is not None]
    got = [tuple(x) for x in made.filter(F.col("leaf").isNotNull()).collect()]
    assert sorted(got, key=str) == sorted((want(*x) for x in asked), key=str)
    assert "item_id" in made.columns and made.count() == len(rows)


def test_page_files_in_xml_do_not_grow_with_the_input(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(files, "XML_TEXTS", 20_000, raising=False)
    monkeypatch.setattr(files, "scratch", lambda _, name: f"{tmp_path}/{name}")
    assert files._xml(tables.Tables(spark, FOLDER)).count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    sizes = [f.stat().st_size for f in (tmp_path / "xml").glob("part-*")]
    assert max(sizes) < 8 * 20_000 + 20 * max(len(r.text or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()) and max(sizes) < sum(sizes) / 8
