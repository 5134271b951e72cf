"""Batches of dense queries against brute force, over several blocks."""

import numpy as np
import pytest

from pressmark.operators import retrieval as S


def _tables(spark, some=60, dim=40):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(some, dim)), 3)
    v[7], v[8] = v[9], 0.0  # equal vectors, a vector without length
    rows = [(i, v[i].tolist() if i != 5 else None, None if i % 6 == 0 else f"g{i % 3}") for i in range(some)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>, owner string")
    return v, rows, vectors, vectors.filter("id % 4 = 1").selectExpr("id AS q", "v")


def _cosine(a, b):
    n = np.sqrt((a * a).sum() * (b * b).sum())
    return round(float(a @ b / n), 9) if n else 0.0


def _signs(a, b):
    return -float(((a > 0) != (b > 0)).sum())


@pytest.mark.parametrize("block", [7, 2048])
@pytest.mark.parametrize("measure", ["cosine", "dot", "hamming"])
def test_batch(spark, monkeypatch, block, measure):
    monkeypatch.setattr(S, "BLOCK", block)
    v, rows, vectors, queries = _tables(spark)
    like = {"cosine": _cosine, "dot": lambda a, b: round(float(a @ b), 9), "hamming": _signs}[measure]
    if measure == "hamming":
        vectors, queries = (t.withColumn("v", S.sign_words(S.doubles("v"))) for t in (vectors, queries))
    got = {}
    for r in S.dense_batch(vectors, "id", "v", queries, "q", 4, measure).orderBy("q", "score", "id").collect():
        got.setdefault(r["q"], []).append((-r["score"], r["id"]))
    some = [i for i in range(len(v)) if i != 5]
    assert set(got) == {i for i in some if i % 4 == 1}
    for q, found in got.items():
        want = sorted((-like(v[q], v[i]), i) for i in some)[:4]
        assert [i for _, i in sorted(found)] == [i for _, i in want]
        assert np.allclose([s for s, _ in sorted(found)], [s for s, _ in want])


@pytest.mark.parametrize("block", [7, 2048])
def test_best_of_each_group(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    v, rows, vectors, queries = _tables(spark)
    got = {(r["q"], r["owner"]): r["id"] for r in S.dense_batch(vectors, "id", "v", queries, "q", 1, group="owner").collect()}
    want = {}
    for q in (i for i in range(len(v)) if i % 4 == 1 and i != 5):
        for i, vec, owner in rows:
            if vec is not None:
                want[q, owner] = min(want.get((q, owner), (9, 0)), (-_cosine(v[q], v[i]), i))
    assert got == {k: i for k, (_, i) in want.items()}


def test_batch_of_one_is_the_search_of_one(spark):
    v, rows, vectors, queries = _tables(spark)
    one = queries.filter("q = 9")
    batch = S.dense_batch(vectors, "id", "v", one, "q", 10).select("id", "score").collect()
    alone = S.dense_top(vectors.filter("v is not null"), "id", "v", one.select("v"), 10).collect()
    assert sorted(map(tuple, batch)) == sorted(map(tuple, alone))


def test_no_vectors_or_no_queries(spark):
    v, rows, vectors, queries = _tables(spark)
    assert S.dense_batch(vectors.limit(0), "id", "v", queries, "q", 3).collect() == []
    assert S.dense_batch(vectors, "id", "v", queries.limit(0), "q", 3).collect() == []
