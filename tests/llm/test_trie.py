"""The trie against a dictionary of prefixes in plain Python, and the merge against sorted()."""

import hashlib
import random
import re
import zlib

import pytest

from pressmark.llm import turn_trie as t

COLUMNS = "conv_id long, turn int, role string, text string, extra string, depth string"


def plain(rows):
    """Every node as the query gives it, one conversation and one prefix at a time."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c > 0 else -1)
        q = turns.get(base, [])[:h] + mine[h:]
        for d in range(len(q) + 1):
            nodes.setdefault(tuple(q[:d]), []).append((c, len(q) == d))
    kids = {p: sum(len(o) == len(p) + 1 and o[: len(p)] == p for o in nodes) for p in nodes}
    out = []
    for p, m in nodes.items():
        under = [o for o in nodes if o[: len(p)] == p]
        saved = sum((len(nodes[o]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", o[-1][1])) for o in under if o)
        ends = ",".join(map(str, sorted(c for c, last in m if last)))
        least = min(c for c, _ in m)
        out.append((least, len(p), min(c for c, _ in nodes[p[:-1]]) if p else None, len(m), kids[p], sum(kids[o] == 0 for o in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def found(df):
    return sorted(str(tuple(r)) for r in df.collect())


def talk(seed, n):
    """Few different turns, so that conversations share prefixes of all lengths and many are copies."""
    r = random.Random(seed)
    rows = []
    for c in range(n):
        same = r.random() < 0.4
        for k in range(0 if r.random() < 0.1 else 3 if same else r.randrange(1, 8)):
            rows.append((c, k, "user" if k % 2 == 0 else "assistant", "the same words" if same else r.choice(["a", "b c", "d  e\tf", ""]), None, "x"))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,run,block", [(1, 8 << 20, 64 << 10), (2, 400, 100), (3, 1500, 1), (4, 1, 1)])
def test_against_plain_python(spark, seed, run, block):
    rows = talk(seed, 160)
    made = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert found(t.nodes(t.rebuilt(made), run, block)) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "lost", None, None), (3, None, None, None, None, None), (3, 1, "user", "x y", None, None), (3, 1, "user", "x y", None, None), (20, 0, "user", None, None, None),
        (21, 0, None, "", None, None), (-7, 0, "user", "hi", None, None), (-40, 0, "user", "hi", None, None), (45, 0, "a", "b", None, None), (46, 0, "ab", "", None, None),
        *[(60, k, "user", "w " * (k % 3), None, None) for k in range(3000)], *[(61, k, "user", "w " * (k % 3), None, None) for k in range(2900)], (62, 0, "user", "long " * 50000, None, None),
    ]
    got = found(t.nodes(t.rebuilt(spark.createDataFrame(rows, COLUMNS)), 4000, 500))
    short = [r for r in rows if r[0] not in (60, 61)]
    assert len(got) > 2900
    assert found(t.nodes(t.rebuilt(spark.createDataFrame(short, COLUMNS)), 100, 50)) == plain(short)


def test_no_conversations(spark):
    assert found(t.nodes(t.rebuilt(spark.createDataFrame([], COLUMNS)))) == []


def test_copies_spread_over_ranges(spark):
    """A third and more of all conversations are one: the list of its ids goes on from range to range."""
    rows = [(c, 0, "user", "hello there", None, None) for c in range(1, 4000, 20)] + talk(9, 60)
    rows = [(c * 20 if k < 200 else c, *rest) for k, (c, *rest) in enumerate(rows)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = found(t.nodes(t.rebuilt(spark.createDataFrame(rows, COLUMNS)), 600, 100))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain(rows)


def test_merge_is_a_sort():
    rng = random.Random(5)
    seqs = [(b"".join(rng.choice([b"a", b"b"]) * 16 for _ in range(rng.randrange(6))), k) for k in range(400)]
    blocks = []
    for i in range(0, 400, 50):
        run = sorted(seqs[i : i + 50])
        for j in range(0, 50, 7):
            own, before, parts = run[j : j + 7], b"", ([], [], [], b"", b"")
            for s, c in own:
                h = t.shared_turns(before, s)
                parts[0].append(c), parts[1].append(h), parts[2].append(len(s) // 16)
                parts = (*parts[:3], parts[3] + s[16 * h :], parts[4] + b"\1" * 8 * (len(s) // 16 - h))
                before = s
            blocks.append((own[0], parts))
    blocks.sort(key=lambda b: b[0])
    got = list(t.merged(t.Block(*p) for _, p in blocks))
    assert [(s, c) for _, s, c, _ in got] == sorted(seqs)
    assert [h for h, *_ in got[1:]] == [t.shared_turns(a[1], b[1]) for a, b in zip(got, got[1:])]


def test_query_against_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS FROM '{folder}/conversations.parquet'")
    want = sorted(str(r) for r in db.sql(t.SQL["op13_conversation_trie"]).fetchall())
    assert found(t.op13_conversation_trie(spark, folder)) == want
