"""Steps that must not grow with a square, in one task or in the driver."""

import functools
import itertools

from pyspark.sql import functions as F

import __spark_entry__ as entry
from pressmark.operators import evaluation, matching
from pressmark.operators.sketches import ExactCube
from pressmark.plans import streams
from pressmark.tables import Tables

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_draws_of_a_bootstrap_are_dealt_and_never_broadcast(spark):
    """Resamples x units rows look to Spark like as many as there are units; numbers of units need no single task."""
    df = spark.range(50).select("id", F.col("id").alias("a"), (F.col("id") % 3 + 1).alias("b"))
    p = plan(evaluation.bootstrap(df, "id", "a", "b", 20, "x"))
    assert "ShuffledHashJoin" in p and "Window" not in p


def test_pairs_of_phrases_are_dealt_over_many_tasks(spark):
    hits = spark.createDataFrame([("p", f"i{k:02d}", "xy"[k % 2], 1960 + k) for k in range(50)], "phrase string, item_id string, issuer string, year int")
    df = matching.phrase_pairs(hits, 20, 2)
    p = plan(df)
    assert "BroadcastHashJoin" not in p and "REPARTITION_BY_NUM" in p
    want = {(("change"), f"i{a:02d}", f"i{b:02d}") for a in range(50) for b in range(a, 50) if b - a >= 20 and (b - a) % 2 == 0} | {("compare", f"i{a:02d}", f"i{a + 1:02d}") for a in range(49)}
    assert {(r.kind, r.item_id_a, r.item_id_b) for r in df.collect()} == want


def test_pairs_of_one_phrase_are_the_work_of_many_tasks(spark, monkeypatch):
    """Hits of one phrase, issuer and few years in blocks of three: no key is one task's, and every pair comes once; nulls pair with nothing."""
    monkeypatch.setattr(matching, "BLOCK", 3, raising=False)
    monkeypatch.setattr(matching, "STRIPE", 2, raising=False)
    rows = [("p", f"i{k * 37 % 101}", "x", 1960 + k % 2 * 20) for k in range(90)] + [("q", f"i{k}", "xy"[k % 2], 1980 + k % 3) for k in range(40)]
    rows += [("q", "i7", "x", 1981), ("q", "i7", "y", 1982), (None, "i1", "x", 1960), ("q", None, "x", 1980), ("q", "i1", None, 1980), ("q", "i2", "y", None)]
    df = matching.phrase_pairs(spark.createDataFrame(rows, "phrase string, item_id string, issuer string, year int"), 20, 2)
    whole = [r for r in rows if None not in r]
    pairs = [(a, b) for a, b in itertools.product(whole, whole) if a[0] == b[0] and a[1] < b[1]]
    want = [("change", a[0], a[1], b[1], a[3], b[3]) for a, b in pairs if a[2] == b[2] and abs(a[3] - b[3]) >= 20]
    want += [("compare", a[0], a[1], b[1], a[3], b[3]) for a, b in pairs if a[2] != b[2] and abs(a[3] - b[3]) <= 2]
    assert sorted(map(tuple, df.collect())) == sorted(want)
    tasks = df.withColumn("task", F.spark_partition_id()).groupBy("kind").agg(F.countDistinct("task").alias("n"))
    assert min(r.n for r in tasks.collect()) > 3


def test_cells_of_many_values_are_counted_exactly(spark):
    """More values than a sketch of 2 ** 16 holds; stored cells brought up to date, nulls, negative numbers."""
    cube = ExactCube(("place",), "item")
    df = spark.range(-1000, 399_000).select(F.when(F.col("id") % 3 > 0, "a").alias("place"), F.when(F.col("id") % 7 > 0, F.col("id") * 7 % 150_001).alias("item"), "id")
    first, later = df.filter("id % 2 = 0"), df.filter("id % 2 <> 0")
    stored = cube.cells(first)
    touched = cube.updated(stored, later)
    other = [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in ("place", "bucket")]
    replaced = stored.alias("s").join(touched.select("place", "bucket").alias("t"), other[0] & other[1], "left_anti").unionByName(touched)
    want = sorted((str(r.place), r.n, r["items"]) for r in df.groupBy("place").agg(F.count("*").alias("n"), F.countDistinct("item").alias("items")).collect())
    assert max(w[2] for w in want) > 1 << 16
    for cells in (cube.cells(df), stored.unionByName(cube.cells(later)), replaced):
        assert sorted((str(r.place), r.n, r["items"]) for r in cube.counted(cells, ["place"], "items").collect()) == want


def test_a_mean_on_the_border_goes_by_the_order_of_the_file(spark, tmp_path):
    """Qualities with a mean of 0.3 give doubles on both sides of it, by their order; how a file is split must not decide."""
    orders = {q: k for k, q in enumerate(itertools.islice(itertools.permutations((3, 12, 35, 70)), 24))}
    rows = [(k, q, i) for i in range(4) for q, k in ((qs[i], k) for qs, k in orders.items())]
    made = spark.createDataFrame([(k, q, 0, i + 1, 1.0) for k, q, i in rows], "l_orderkey long, q long, l_suppkey long, l_linenumber int, l_quantity double")
    # 29 * 7 = 203 = 1 modulo 101, so a part of 29 q has quality q / 100
    made.select("l_orderkey", (F.col("q") * 29).alias("l_partkey"), "l_suppkey", "l_linenumber", "l_quantity").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = sorted(f"it-{k}" for qs, k in orders.items() if functools.reduce(lambda s, x: s + x / 100, qs, 0.0) / len(qs) < 0.3)
    assert 0 < len(want) < 24
    got = entry.queries()["ag32_having"](spark, str(tmp_path))
    assert "row_index" in plan(got)
    assert sorted(r.item_id for r in got.collect()) == want


def test_a_stream_is_split_at_one_moment(spark, monkeypatch):
    """The middle is found once: an approximate percentile differs between runs, and rows between two middles come twice or never."""
    monkeypatch.setattr(streams.F, "percentile_approx", lambda c, p: F.floor(F.max(c) * (0.3 + 0.4 * F.rand())).cast("long"))
    t = Tables(spark, FOLDER)
    rows = spark.range(400).select("id", F.timestamp_seconds(F.col("id")).alias("ts"))
    assert sorted(r.id for r in streams._fed(t, rows, lambda s: s, 1).collect()) == list(range(400))


def test_partners_of_two_numbers_make_no_pairs_and_are_not_broadcast(spark):
    """A thousand pages that share the same two numbers and no third: each finds the first of another item."""
    df = spark.range(1000).select(F.format_string("p%04d", "id").alias("page_id"), F.format_string("i%d", F.col("id") % 500).alias("item_id"), F.lit("a").alias("jurisdiction"), F.lit(1990).alias("year"), F.array(F.lit("1"), F.lit("2"), F.concat(F.lit("x"), F.col("id").cast("string"))).alias("numbers"))
    got = {r.page_id: (r.page_id_b, r.shared) for r in matching.partners(df, 3, 2).collect()}
    assert got == {f"p{k:04d}": ("p0001" if k % 500 == 0 else "p0000", 2) for k in range(1000)}
    assert "BroadcastHashJoin" not in plan(matching.partners(df, 3, 2))
