"""Whitening of embeddings by LOBPCG, with the covariance never formed.

An entry c of a vector becomes the integer x = floor(256 c). The model is fitted on each
distinct x once. What a pass over the fit list gives is V Q, V being its covariance and Q an
orthonormal block of some dozens of columns: every task multiplies its centred rows with Q,
and the transposed rows with that; the parts are added up by dimension.

A pass serves one Rayleigh-Ritz step on the span of three blocks: the iterate, its residuals
and the previous directions. From the same products come the new residuals, so each step
also certifies the one before. It ends once the residuals of the wanted components are below
``TOLERANCE`` times the largest eigenvalue and a further pass no longer halves the largest of
them; without that within ``MOST_PASSES`` it is an error. ``GUARD`` more columns than wanted
are iterated, so that the wanted ones converge with the gap to the last of these.

Rows are centred as (n x - S) / n with exact integers, S being the sums, wherever these fit
into 64 bits. What the driver holds is a few blocks with one row per dimension.

Defined cases: a vector that is null, or has a null or non-finite entry, is left out; shorter
vectors are filled with zeros to the length of the longest; repeated vectors and ids are rows
of their own; there are as many components as dimensions where these are fewer; where the
covariance has no such direction (eigenvalue zero up to rounding), whitened is null; explained
is null without any variance; a deviation beyond 64 bits is null; without rows, or without
dimensions, there is no result row; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmark.llm.shared import checkpointed

COMPONENTS = 4
GUARD = 12
SCALE = 256
TOLERANCE = 2.0**-44
MOST_PASSES = 400
_BLOCK_BYTES = 1 << 20
_LONG = 2**63 - 1


def quantised(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x, all of one length, of the rows that have a vector of finite entries."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = rows.filter(F.col(vector).isNotNull() & finite).select("vec_id", F.col(vector).alias("v"))
    d = kept.agg(F.max(F.size("v"))).first()[0] or 0  # one number
    whole = F.transform("v", lambda c: F.floor(c.cast("double") * SCALE))
    return kept.select("vec_id", F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("v"))).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors in blocks of a megabyte, so that every later pass reads a few long rows."""
    for b in batches:
        if not b.num_rows:
            continue
        x = _matrix(b.column("x"))
        step = max(1, _BLOCK_BYTES // (8 * max(1, x.shape[1])))
        for i in range(0, len(x), step):
            part = np.ascontiguousarray(x[i : i + step], "<i8")
            yield pa.record_batch([pa.array([len(part)], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["n", "body"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        for n, body in zip(b.column("n").to_pylist(), b.column("body")):
            yield np.frombuffer(body.as_buffer(), "<i8").reshape(n, -1)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


@dataclass(frozen=True)
class Centre:
    """The number of vectors of the fit list, and their sums."""

    n: int
    sums: tuple[int, ...]

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: in 64 bits, or as Python's integers where these would not do."""
        if self.n * _largest(x) + max(map(abs, self.sums), default=0) < 1 << 62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.numerators(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        d = self.numerators(x)
        if d.dtype == np.int64 and d.shape[1] * _largest(d) ** 2 <= _LONG:
            return (d * d).sum(axis=1).tolist()
        return [s if s <= _LONG else None for s in (sum(int(v) ** 2 for v in row) for row in d)]


def centre(blocks: DataFrame, d: int) -> Centre:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for x in _unpacked(batches):
            n += len(x)
            own = x.sum(axis=0) if _largest(x) * len(x) < _LONG else x.astype(object).sum(axis=0)
            sums = [a + int(b) for a, b in zip(sums, own)]
        if n:
            yield pa.record_batch([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))], ["i", "n", "s"])

    added = blocks.mapInArrow(run, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s")).alias("s"))
    rows = sorted(added.collect())  # one row per dimension
    return Centre(int(rows[0]["n"]), tuple(int(r["s"]) for r in rows))


def product(blocks: DataFrame, c: Centre, q: np.ndarray) -> tuple[np.ndarray, float]:
    """V Q and the trace of V, by one pass over the fit list."""
    d, k = q.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _unpacked(batches):
            own = c.rows(x)
            part = np.column_stack([own.T @ (own @ q), (own * own).sum(axis=0)])
            total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(range(d), pa.int32()), *(pa.array(total[:, j]) for j in range(k + 1))], ["i", *(f"w{j}" for j in range(k + 1))])

    names = [f"w{j}" for j in range(k + 1)]
    added = blocks.mapInArrow(run, "i int, " + ", ".join(f"{w} double" for w in names)).groupBy("i").agg(*(F.sum(w).alias(w) for w in names))
    w = np.array([list(r)[1:] for r in sorted(added.collect())]) / c.n  # one row per dimension
    return w[:, :k], float(w[:, k].sum())


def _extended(basis: np.ndarray, more: np.ndarray) -> np.ndarray:
    """An orthonormal basis that spans the columns of another block too; what adds nothing is left out."""
    size = np.linalg.norm(more, axis=0)
    more = more[:, size > 0] / size[size > 0]
    for _ in range(2):
        more = more - basis @ (basis.T @ more)
    u, s, _ = np.linalg.svd(more, full_matrices=False)
    new = u[:, s > 1e-10][:, : basis.shape[0] - basis.shape[1]]
    new = new - basis @ (basis.T @ new)
    return np.column_stack([basis, np.linalg.qr(new)[0]])


@dataclass(frozen=True)
class Spectrum:
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    passes: int


def lobpcg(multiply: Callable[[np.ndarray], tuple[np.ndarray, float]], d: int, wanted: int, guard: int = GUARD, tolerance: float = TOLERANCE) -> Spectrum:
    """The largest eigenvalues of the operator behind ``multiply``, falling, and their unit eigenvectors."""
    m = min(d, wanted + guard)
    basis = np.linalg.qr(np.random.default_rng(0).standard_normal((d, m)))[0]
    best: Spectrum | None = None
    for passes in range(1, MOST_PASSES + 1):
        w, trace = multiply(basis)
        h = basis.T @ w
        values, c = np.linalg.eigh((h + h.T) / 2)
        values, c = values[::-1][:m], c[:, ::-1][:, :m]
        x, vx = basis @ c, w @ c
        r = vx - x * values
        worst = float(np.linalg.norm(r[:, :wanted], axis=0).max())
        if best is not None and worst > best.residual / 2:
            return best if best.residual < worst else Spectrum(values[:wanted], x[:, :wanted], trace, worst, passes)
        if worst <= tolerance * max(values[0], 0.0):
            best = Spectrum(values[:wanted], x[:, :wanted], trace, worst, passes)
            if not worst:
                return best
        directions = basis[:, m:] @ c[m:]
        basis = _extended(np.linalg.qr(x)[0], r)
        if directions.shape[1] and basis.shape[1] < d:
            basis = _extended(basis, directions)
    raise ArithmeticError(f"residuals are not below {tolerance} of the largest eigenvalue after {MOST_PASSES} passes")


@dataclass(frozen=True)
class Whitener:
    centre: Centre
    spectrum: Spectrum

    @property
    def scales(self) -> np.ndarray:
        """One over the root of each eigenvalue, nan where that is zero up to rounding."""
        e = self.spectrum.values
        real = e > e[0] * len(self.centre.sums) * np.finfo(float).eps
        return np.where(real, 1 / np.sqrt(np.where(real, e, 1.0)), np.nan)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centre.rows(x) @ self.spectrum.vectors * self.scales


def identity_error(blocks: DataFrame, w: Whitener) -> float | None:
    """How far the covariance of the whitened fit list is from the identity, at its worst entry; None if nothing is whitened."""
    real = ~np.isnan(w.scales)
    k = int(real.sum())
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _unpacked(batches):
            y = w.whiten(x)[:, real]
            mean = y.mean(axis=0)
            y = y - mean
            yield pa.record_batch([pa.array([float(v)]) for v in [*(y.T @ y + len(x) * np.outer(mean, mean)).ravel(), *(len(x) * mean)]], names)

    names = [f"c{j}" for j in range(k * k + k)]
    sums = np.array(blocks.mapInArrow(run, ", ".join(f"{n} double" for n in names)).agg(*(F.sum(n) for n in names)).first())  # one row
    n, mean = w.centre.n, sums[k * k :] / w.centre.n
    return float(np.abs(sums[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per row of quantised() vectors and component; the model is fitted on the distinct x."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    ddl = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    blocks = checkpointed(vectors.select("x").distinct().mapInArrow(_pack, "n long, body binary"))
    head = blocks.select((F.length("body") / 8 / F.col("n")).cast("int")).first()
    d = head[0] if head else 0
    if not d:
        return vectors.sparkSession.createDataFrame([], ddl)
    at = centre(blocks, d)
    spectrum = lobpcg(lambda q: product(blocks, at, q), d, min(components, d))
    w = Whitener(at, spectrum)
    k = len(spectrum.values)
    error = identity_error(blocks, w)
    explained = [float(e) / spectrum.trace if spectrum.trace > 0 else None for e in spectrum.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("x"))
            rows = len(x)
            y = w.whiten(x).ravel()
            yield pa.record_batch(
                [
                    b.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array([at.n] * (rows * k), pa.int64()),
                    pa.array([v for v in at.deviations(x) for _ in range(k)], pa.int64()), pa.array(y, mask=np.isnan(y)), pa.array(explained * rows, pa.float64()), pa.array([error] * (rows * k), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(run, ddl)


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
