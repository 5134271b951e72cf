"""Streams with state: restarts give the results of one run, and state that says nothing any more goes."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pressmark.streaming import flows, stateful

SCHEMA = "event_id long, user string, ts timestamp, kind string, usd double"
START = datetime(2024, 1, 1, 22, tzinfo=timezone.utc)


@pytest.fixture(autouse=True)
def one_partition(spark):
    """Each partition of state has workers of its own, which take seconds to start."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def feed(spark, path, rows):
    spark.createDataFrame([(k, u, START + timedelta(seconds=s), kind, usd) for k, u, s, kind, usd in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def runs(spark, tmp_path, parts, build):
    """The rows that a stream gives when it is stopped and started again after every part, and the last progress."""
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for part in parts:
        feed(spark, src, part)
        progress = stateful.drain(build(flows.folder_stream(spark, src, SCHEMA)), out, ck)
    return spark.read.parquet(out).collect(), progress


def bucket(rows, rate, burst):
    state, out = {}, {}
    for k, u, s, *_ in sorted(rows, key=lambda r: (r[2], r[0])):
        tokens, last = state.get(u, (burst, None))
        tokens = burst if last is None else min(burst, tokens + (s - last) * rate)
        out[k] = tokens >= 1
        state[u] = (tokens - out[k], s)
    return out


def test_a_token_bucket_goes_on_after_a_restart_and_forgets_full_buckets(spark, tmp_path):
    rows = [(k, "ab"[k % 2], k * 7 % 40, "x", 0.0) for k in range(30)]
    later = [(100 + k, "a", 45 + k, "x", 0.0) for k in range(5)] + [(200, "c", 5000, "x", 0.0)]
    got, _ = runs(spark, tmp_path, [rows, later, [(300, "a", 9000, "x", 0.0)]], lambda s: stateful.token_bucket(s, "user", "ts", "event_id", 0.1, 3.0))
    assert {r.event_id: r.allowed for r in got} == bucket([*rows, *later, (300, "a", 9000, "x", 0.0)], 0.1, 3.0)


def test_state_of_idle_keys_is_dropped(spark, tmp_path):
    rows = [(k, f"u{k}", k % 10, "x", 0.0) for k in range(40)]
    _, progress = runs(spark, tmp_path, [rows, [(100, "z", 4000, "x", 0.0)], [(101, "z", 8000, "x", 0.0)]], lambda s: stateful.token_bucket(s, "user", "ts", "event_id", 0.1, 3.0))
    assert progress["stateOperators"][0]["numRowsTotal"] <= 4  # z's value and timers; u0 to u39 are gone


def test_a_daily_budget_starts_anew_with_the_day(spark, tmp_path):
    hours = lambda *hs: [(int(h * 100), "a", h * 3600, "x", 0.0) for h in hs]
    got, _ = runs(spark, tmp_path, [hours(0, 0.5, 1), hours(1.5, 2.5), hours(3, 30)], lambda s: stateful.daily_budget(s, "user", "ts", "event_id", 2))
    assert sorted((r.event_id, r.used, r.within) for r in got) == [(0, 1, True), (50, 2, True), (100, 3, False), (150, 4, False), (250, 1, True), (300, 2, True), (3000, 1, True)]


def test_a_ledger(spark, tmp_path):
    entry = lambda k, kind, usd, user="r1": (k, user, k, kind, usd)
    first = [entry(1, "reserve", 5.0), entry(2, "spend", 1.5), entry(3, "reserve", 2.0), entry(4, "reserve", 9.0, "r2")]
    second = [entry(5, "release", None), entry(6, "spend", 2.5), entry(7, "reserve", 4.0), entry(500, "spend", 1.0, "r3")]
    build = lambda s: stateful.ledger(s.withColumn("name", F.lit("call")), "user", "ts", "event_id", "name", "kind", "usd", 60.0)
    got, _ = runs(spark, tmp_path, [first, second], build)
    rows = sorted((r.user, r.n, r.spent, r.reserved) for r in got)
    assert ("r1", 3, 1.5, 2.0) in rows and ("r1", 6, 4.0, 4.0) in rows and ("r2", 1, 0.0, 9.0) in rows
    last = stateful.last_of(spark.createDataFrame(got), "user", "n").collect()  # what nobody released has ended
    assert sorted((r.user, r.spent, r.reserved, r.n) for r in last) == [("r1", 4.0, 0.0, 7), ("r2", 0.0, 0.0, 2), ("r3", 1.0, 0.0, 1)]
