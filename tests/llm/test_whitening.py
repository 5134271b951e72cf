"""Whitening against numpy's full eigendecomposition and Python's integers."""

import math

import numpy as np
import pytest

from pressmark.llm import whitening as w

COLUMNS = "vec_id long, embedding array<double>, n long, component string"


def plain(rows, components=4):
    """(vec_id, n, deviation) and the whitened matrix, explained shares, of rows (id, vector)."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(v) for _, v in kept)
    xs = [[math.floor(256 * c) for c in v] + [0] * (d - len(v)) for _, v in kept]
    fit = sorted(set(map(tuple, xs)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    y = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in xs]) @ vectors / np.sqrt(values)
    return [(i, n, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for (i, _), x in zip(kept, xs)], y, values / np.trace(centred.T @ centred / n)


def compare(got, rows, tolerance=1e-8):
    want, y, explained = plain(rows)
    k = y.shape[1]
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == len(want) * k and len(by) == len(want)
    made = np.array([[by[i][c + 1].whitened for c in range(k)] for i, *_ in want])
    sign = np.sign((made * y).sum(axis=0))
    assert np.abs(made - y * sign).max() < tolerance
    for i, n, dev in want:
        assert all(r.n == n and r.deviation == dev for r in by[i].values())
    assert np.allclose([by[want[0][0]][c + 1].explained for c in range(k)], explained, rtol=1e-10)
    assert 0 <= got[0].identity_error < 1e-9


@pytest.mark.parametrize("d,n", [(64, 700), (5, 90), (100, 60)])
def test_against_numpy(spark, d, n):
    rng = np.random.default_rng(d)
    v = rng.standard_normal((n, d)) * np.linspace(0.1, 1, d)
    rows = [(i, list(map(float, x))) for i, x in enumerate(v)] + [(n + 1, list(map(float, v[0]))), (n + 2, None), (n + 3, [None] * d), (n + 4, [math.nan] * d), (n + 5, [math.inf] + [0.0] * (d - 1)), (n + 6, [0.5, -0.25])]
    got = w.whitened(w.quantised(spark.createDataFrame([(i, x, 1, "c") for i, x in rows], COLUMNS).repartition(5))).collect()
    compare(got, rows)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    compare(w.op11_embedding_whitening(spark, folder).collect(), rows)


def test_without_variance_and_without_rows(spark):
    same = w.whitened(w.quantised(spark.createDataFrame([(1, [0.5, 1.0], 1, ""), (None, [0.5, 1.0], 1, "")], COLUMNS))).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)] * 2
    line = w.whitened(w.quantised(spark.createDataFrame([(k, [k / 4, 1.0, 2.0], 1, "") for k in range(9)], COLUMNS))).collect()
    assert {r.component for r in line if r.whitened is None} == {2, 3} and line[0].identity_error < 1e-12
    for rows in ([], [(1, None, 1, "")], [(1, [], 1, "")]):
        assert w.whitened(w.quantised(spark.createDataFrame(rows, COLUMNS))).collect() == []


def test_numbers_beyond_64_bits(spark):
    rows = [(k, [1e17 * k, float(k % 3), 1e300 if k == 5 else 0.0], 1, "") for k in range(6)]
    got = w.whitened(w.quantised(spark.createDataFrame(rows, COLUMNS))).collect()
    assert len(got) == 18 and got[0].deviation is None and all(math.isfinite(r.whitened) for r in got if r.component == 1)


def test_certified_residuals_of_close_eigenvalues():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((300, 300)))[0]
    values = np.concatenate([[5, 4.99, 4.5, 4.4], np.linspace(4, 0.1, 296)])
    v = (q * values) @ q.T
    found = w.lobpcg(lambda b: (v @ b, float(values.sum())), 300, 4)
    assert np.allclose(found.values, values[:4], rtol=1e-12) and found.residual <= w.TOLERANCE * 5
    assert np.abs(np.abs(found.vectors.T @ q[:, :4]) - np.eye(4)).max() < 1e-10
