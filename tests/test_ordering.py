"""Places, digests and bins over ranges against the plain fold."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pressmark.operators import ordering, packing


def fold(rows, target):
    """(segment, item) -> number of its bin, by the running total that starts anew."""
    out, number, seg, filled = {}, -1, object(), 0
    for s, i, z in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        z = max(0, round((z or 0) * 1_000_000))
        if s != seg or filled + z > round(target * 1_000_000):
            number, seg, filled = number + 1, s, 0
        out[s, i] = number
        filled += z
    return out


def binned(spark, rows, target):
    made = spark.createDataFrame(rows, "place string, item long, size double").repartition(3)
    got = {(r.place, r.item): r.bin for r in ordering.bins(made, "place", ["item"], "size", target).collect()}
    order = {b: k for k, b in enumerate(sorted(set(got.values())))}
    return {k: order[b] for k, b in got.items()}


@pytest.fixture
def ranges(spark):
    """More ranges than the four of the session, none of them joined."""
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("seed", range(6))
def test_bins_are_the_folds(spark, ranges, seed):
    rng = random.Random(seed)
    target = [10.0, 3.5, 200.0, 1.0, 1e6, 7.0][seed]
    size = lambda: rng.choice([0.0, 0.0, None, rng.random(), rng.random() * 5, 12.0, -1.0])
    rows = [(p, i, size()) for p, n in (("a", 700), ("b", 3), (None, 40), ("c", 250), ("d", 1)) for i in range(n)]
    assert binned(spark, rows, target) == fold(rows, target)


def test_bins_of_nothing_and_of_zeros(spark, ranges):
    assert binned(spark, [], 5.0) == {}
    rows = [("a", i, 0.0) for i in range(100)]
    assert set(binned(spark, rows, 5.0).values()) == {0}
    rows = [("a", i, 9.0 if i % 2 else 0.0) for i in range(100)]
    assert binned(spark, rows, 5.0) == fold(rows, 5.0)


def test_places(spark, ranges):
    rng = random.Random(2)
    rows = [(rng.choice("abc") if k % 9 else None, rng.randrange(50), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, k long")
    got = {r.k: r.place for r in ordering.numbered(df, [F.desc("v"), "k"]).collect()}
    assert got == {k: i for i, (_, _, k) in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])))}
    got = {r.k: r.at for r in ordering.numbered(df, ["g", "v", "k"], "at", by="g").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        want |= {k: i for i, (_, _, k) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])))}
    assert got == want
    assert ordering.numbered(df.limit(0), ["k"]).collect() == []


def test_digests_of_lists(spark, ranges):
    rows = [(f"g{k % 3}" if k % 7 else None, f"é{k * 37 % 1000}") for k in range(1000)] + [("g0", None), ("g0", "é0")]
    df = spark.createDataFrame(rows, "g string, v string")
    got = {r.g: (r.n, r.digest) for r in ordering.list_digests(df, "g", "v", "\n", piece=17).collect()}
    for g in {r[0] for r in rows}:
        own = sorted(v for h, v in rows if h == g and v is not None)
        assert got[g] == (len(own), hashlib.sha256("\n".join(own).encode()).hexdigest())


def test_shards_by_the_plan_of_one_place_at_a_time(spark, ranges):
    """Names, years and split years against a plain walk over every place."""
    rng = random.Random(4)
    docs = [(f"i{k:04d}", rng.choice(["p", "q", "tiny", None]) if k % 50 else "tiny2", rng.choice([None, *range(1990, 1996)]), rng.choice([1.0, 2.5, 0.0, 30.0])) for k in range(600)]
    docs = [d for d in docs if d[1] != "tiny" or rng.random() < 0.02]
    target, least = 25.0, 100.0
    totals = {}
    for _, p, _, z in docs:
        totals[p or "unknown"] = totals.get(p or "unknown", 0) + z
    place = lambda p: "other" if totals[p or "unknown"] < least else p or "unknown"
    want, seen = {}, {}
    for where in sorted({place(d[1]) for d in docs}):
        own = [d for d in docs if place(d[1]) == where]
        shards = []
        for group in (sorted((d for d in own if d[2] is not None), key=lambda d: (d[2], d[0])), sorted((d for d in own if d[2] is None), key=lambda d: d[0])):
            current, start = None, len(shards)
            for i, _, y, z in group:
                if current is None or sum(x[2] for x in current) + z > target:
                    current = []
                    shards.append(current)
                current.append((i, y, z))
            dated = shards[start:] if group and group[0][2] is not None else []
            for a, b in zip(dated, dated[1:]):
                if a[-1][1] == b[0][1]:
                    want |= {("split", x[0]): True for x in [*a, *b]}
        for s in shards:
            base = f"{where}-undated" if s[0][1] is None else f"{where}-{s[0][1]}-{s[-1][1]}"
            seen[base] = seen.get(base, 0) + 1
            want |= {x[0]: base if seen[base] == 1 else f"{base}-{seen[base]}" for x in s}
    rows = packing.plan_shards(spark.createDataFrame(docs, "item_id string, place string, year int, size double"), target, least).collect()
    assert len(rows) == len(docs) and len({r.shard_id for r in rows}) > 40
    assert {r.item_id: r.shard_id for r in rows} == {k: v for k, v in want.items() if isinstance(k, str)}
    assert {r.item_id for r in rows if r.split_year} == {k[1] for k in want if not isinstance(k, str)}
