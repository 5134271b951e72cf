"""The kept index against scans of the texts, one document at a time."""

import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pressmark.operators import index

WORDS = [f"w{k}" for k in range(30)] + ["école", "ñandú", "the", "of"]


def texts(seed, n):
    r = random.Random(seed)
    weights = [1 / (k + 1) for k in range(len(WORDS))]
    out = {k * 3 - 50: " ".join(r.choices(WORDS, weights, k=r.choice([0, 1, 5, 40, 300]))) for k in range(n)}
    return out | {10_001: None, 10_002: "The of, the OF the", -1_000: "école"}


def tokens(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def ranked(docs, terms, k):
    toks = {d: tokens(t) for d, t in docs.items()}
    n, total = len(docs), sum(map(len, toks.values()))
    df = {w: sum(w in ts for ts in toks.values()) for w in terms}
    scores = {}
    for d, ts in toks.items():
        for w in terms:
            if (tf := ts.count(w)):
                scores[d] = scores.get(d, 0) + math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / (total / n)))
    return sorted(((-round(s, 9), d) for d, s in scores.items()))[:k]


@pytest.fixture(scope="module", params=[(128, 4_000_000), (4, 700)])
def kept(spark, request, tmp_path_factory):
    docs = texts(1, 400)
    root = str(tmp_path_factory.mktemp("index"))
    df = spark.createDataFrame(list(docs.items()) + [(None, "w1 w2")], "id long, t string").repartition(3)
    index.build(df, "id", "t", root, 4, *request.param)
    return docs, index.Index(spark, root)


@pytest.mark.parametrize("terms", [["w0"], ["w29", "w0", "école"], ["the", "of", "w3", "w3"], ["w20", "nowhere"], ["nowhere"], []])
@pytest.mark.parametrize("k", [1, 10, 10_000])
def test_top_k(kept, terms, k):
    docs, ix = kept
    got, want = ix.top(terms, k).collect(), ranked(docs, list(dict.fromkeys(terms)), k)
    assert [r.key for r in got] == [d for _, d in want] and [r.score for r in got] == pytest.approx([-s for s, _ in want], abs=2e-9)


def test_phrases_all_of_and_prefixes(kept):
    docs, ix = kept
    for phrase in (["the", "of"], ["of", "the", "of"], ["w0", "w0"], ["w1", "w0", "w2"], ["école"], ["the", "nowhere"], []):
        want = {}
        for d, t in docs.items():
            ts = tokens(t)
            hits = sum(ts[i : i + len(phrase)] == phrase for i in range(len(ts) - len(phrase) + 1)) if phrase else 0
            if hits:
                want[d] = hits
        assert {r.key: r.hits for r in ix.phrase(phrase).collect()} == want
        every = sorted(d for d, t in docs.items() if phrase and set(phrase) <= set(tokens(t)))
        assert sorted(r.key for r in ix.all_of(phrase).collect()) == every
    assert sorted(r.key for r in ix.prefix("w2").collect()) == sorted(d for d, t in docs.items() if any(w.startswith("w2") for w in tokens(t)))


def test_a_batch_of_phrases(kept):
    docs, ix = kept
    asked = [(k, [f"w{k}", f"w{(k + 1) % 30}"]) for k in range(30)] + [(99, []), (100, ["nowhere"])]
    want = {(q, d): n for q, p in asked for d, t in docs.items() if p and (n := sum(tokens(t)[i : i + 2] == p for i in range(len(tokens(t)) - 1)))}
    assert {(r.q, r.key): r.hits for r in ix.phrases(asked).collect()} == want


def test_blocks_that_cannot_matter_are_not_decoded(spark, tmp_path):
    docs = [(k, "common " * 3 + " ".join(f"x{k}_{j}" for j in range(20)) + (" rare" if k in (70, 4000) else "")) for k in range(5000)]
    index.build(spark.createDataFrame(docs, "id long, t string").coalesce(1), "id", "t", str(tmp_path / "i"))
    rows = index.Index(spark, str(tmp_path / "i")).top(["common", "rare"], 2, told=True).collect()
    assert [r.key for r in rows] == [70, 4000] and rows[0].held > 39 and rows[0].decoded <= 8


def test_only_the_terms_are_read(spark, kept, tmp_path):
    """The filter reaches the scan, with the columns that the search needs and no others."""
    _, ix = kept
    plan = ix.top(["w3"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,w3)" in plan and "positions" not in plan
    plan = ix.all_of(["w3"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,w3)" in plan and "tfs" not in plan


def test_an_index_needs_integer_keys_and_may_be_empty(spark, tmp_path):
    none = spark.createDataFrame([], "id long, t string")
    assert index.build(none, "id", "t", str(tmp_path / "e"))["n"] == 0
    assert index.Index(spark, str(tmp_path / "e")).top(["a"], 3).collect() == []
    with pytest.raises(TypeError):
        index.build(none.withColumn("id", F.lit("x")), "id", "t", str(tmp_path / "s"))


def test_a_worker_holds_a_small_segment():
    """Memory of a task that takes four million tokens apart, as numpy counts it: that of one segment, not of all."""
    words = pa.array([f"w{i % 5000}" for i in range(1000)])
    batch = lambda first: pa.record_batch([pa.array(range(first, first + 100)), pa.ListArray.from_arrays(pa.array(range(0, 100_001, 1000), pa.int32()), pa.concat_arrays([words] * 100))], ["k", "ts"])
    tracemalloc.start()
    held = sum(b.column("n").to_numpy()[np.array(b.column("term")) == ""].sum() for b in index._segments(map(batch, range(0, 4000, 100)), 0, index.BLOCK, index.SEGMENT_TOKENS))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held == 4000 and peak < 200 << 20, peak
