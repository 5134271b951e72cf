"""Stored cells rolled up against exact counts and ranks."""

import random

import numpy as np
from pyspark.sql import functions as F

from pressmark.operators import sketches
from pressmark.operators.sketches import Cube
from pressmark.sources.snapshots import Snapshots

CUBE = Cube(("place", "decade"), ("item",), ("size",))


def rows(spark, seed, n, items):
    r = random.Random(seed)
    made = [(r.choice(["a", "b", None]), r.choice([1960, 1970]), f"i{r.randrange(items)}" if r.random() > 0.05 else None, r.lognormvariate(0, 1) if r.random() > 0.1 else None) for _ in range(n)]
    return made, spark.createDataFrame(made, "place string, decade int, item string, size double").repartition(4)


def ranks(values, v):
    values = np.sort(values)
    return np.searchsorted(values, v, "left") / len(values), np.searchsorted(values, v, "right") / len(values)


def test_small_cells_are_exact(spark):
    made, df = rows(spark, 1, 3000, 900)
    cells = CUBE.cells(df)
    got = {r.place: r.items for r in CUBE.rolled(cells, ["place"]).select("place", sketches.distinct("d_item").alias("items")).collect()}
    assert got == {p: len({m[2] for m in made if m[0] == p and m[2]}) for p in ("a", "b", None)}
    whole = CUBE.rolled(cells, []).select("n", sketches.distinct("d_item").alias("items"), sketches.quantile("q_size", 0.0).alias("least"), sketches.quantile("q_size", 1.0).alias("most")).first()
    sizes = [m[3] for m in made if m[3] is not None]
    assert (whole.n, whole["items"], whole.least, whole.most) == (3000, len({m[2] for m in made if m[2]}), min(sizes), max(sizes))


def test_large_cells_are_within_their_error(spark):
    spread = F.pow((F.col("id") * 48271 % 200_003) / 200_003.0, 3)
    df = spark.range(200_000).select(F.lit("a").alias("place"), (F.col("id") % 5).cast("int").alias("decade"), (F.col("id") * 7 % 60_000).cast("string").alias("item"), spread.alias("size"))
    one = CUBE.rolled(CUBE.cells(df), ["place"]).select(sketches.distinct("d_item").alias("items"), *[sketches.quantile("q_size", q).alias(f"q{int(q * 100)}") for q in (0.5, 0.95)], sketches.share_up_to("q_size", 0.125).alias("half")).first()
    assert abs(one["items"] - 60_000) < 0.05 * 60_000
    sizes = np.array([r.size for r in df.select("size").collect()])
    for q in (0.5, 0.95):
        low, high = ranks(sizes, one[f"q{int(q * 100)}"])
        assert low - 0.03 <= q <= high + 0.03
    assert abs(one.half - 0.5) < 0.03


def test_set_operations_and_empty_cells(spark):
    df = spark.createDataFrame([("a", f"i{k}", None) for k in range(50)] + [("b", f"i{k}", None) for k in range(30, 90)], "place string, item string, size double")
    cube = Cube(("place",), ("item",), ("size",))
    a, b = (cube.cells(df.filter(F.col("place") == p)).select(F.col("d_item").alias(p)) for p in "ab")
    both = a.crossJoin(b).select(sketches.in_both("a", "b").alias("x"), sketches.only_first("a", "b").alias("y")).first()
    assert (both.x, both.y) == (20, 30)
    assert {r[0] for r in cube.cells(df).select(sketches.quantile("q_size", 0.5)).collect()} == {None}


def test_a_stored_cube_is_brought_up_to_date(spark, tmp_path):
    first, df = rows(spark, 2, 500, 100)
    later, more = rows(spark, 3, 60, 300)
    more = more.filter("place = 'a'")
    cells = CUBE.cells(df)
    table = Snapshots.create(spark, str(tmp_path / "cube"), cells.schema, ["place", "decade"], 4)
    table.append(cells)
    touched = CUBE.updated(table.read(), more)
    assert {r.place for r in touched.collect()} == {"a"}
    table.replace(touched)
    both = df.unionByName(more)
    told = lambda c: sorted(str(tuple(r)) for r in c.select("place", "decade", "n", sketches.distinct("d_item"), sketches.quantile("q_size", 0.0), sketches.quantile("q_size", 1.0)).collect())
    assert told(table.read()) == told(CUBE.cells(both))
    assert told(table.read(1)) == told(cells)


def test_grouping_sets(spark):
    made, df = rows(spark, 4, 400, 50)
    got = CUBE.tabulated(CUBE.cells(df), [["place", "decade"], ["decade"], []]).select("level", "place", "decade", "n").collect()
    assert sum(r.n for r in got if r.level == 0) == sum(r.n for r in got if r.level == 1) == [r.n for r in got if r.level == 2][0] == len(made)
