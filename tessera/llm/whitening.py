"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

Vectors are put on a grid of whole numbers, x = floor(256 c), and the model is
fitted on each distinct x once. A table that holds one vector a billion times thus
fits as if it held it once, and the partial aggregate of the distinct step meets the
copies before any shuffle.

*Fit.* One pass counts the distinct vectors and sums them per dimension, in whole
numbers. A second pass centres every vector before anything is multiplied: a whole
number next to the mean is subtracted exactly, what is left of the mean (at most a
half) in double precision, so no size of offset costs digits. Tasks return one d x d scatter
each; they are added in a stream by a few tasks, and the driver gets at most ``SUMS``
of them. There the scatter A is factored with pivoting, P'AP = LL', until no pivot
stands out of rounding. Jacobi rotations then make the columns of the triangular
factor L orthogonal: LV = U diag(s) gives A = PU diag(s^2) U'P'. The rotated
columns' squared norms are the eigenvalues, the columns over their norms, rows put back
in place, the components; neither A nor the rotations V are needed for that.

*Check.* A third pass whitens the fit list and measures its covariance (means and
centred products of blocks merged pairwise) against the identity.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Contract of the registered query: steps of the grid in one, and components returned.
SCALE, COMPONENTS = 256, 4
#: Partial results that the driver adds.
SUMS = 16
#: Sweeps over all pairs of columns after which Jacobi must have ended.
SWEEPS = 60


@dataclass(frozen=True)
class Whitening:
    """n fitted vectors, their sums, eigenvalues falling, components as columns, trace and identity error."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float | None

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.eigenvalues))


def grid(rows: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """``rows`` with usable vectors, and their grid points ``__x``.

    Dropped: vectors that are null, empty or hold null or non-finite entries, and those
    whose length is not the commonest of the rest (of equally common ones the longest).
    """
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    fine = rows.filter(F.col(vector).isNotNull() & finite & (F.size(vector) > 0))
    common = fine.groupBy(F.size(vector).alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), F.desc("dim")).first()
    return fine.filter(F.size(vector) == (common["dim"] if common else 0)).withColumn(
        "__x", F.transform(v, lambda c: F.floor(c * F.lit(float(scale)))))


def _matrix(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False)
    return x.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - sums / n without loss: the nearest whole number first, then the rest of the mean."""
    near = [(2 * s + n) // (2 * n) for s in sums]
    rest = np.array([float(Fraction(s, n) - m) for s, m in zip(sums, near, strict=True)])
    return (x - np.array(near, np.int64)).astype(np.float64) - rest


def _sums(points: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Number of grid points and their exact sums per dimension; d + 1 rows reach the driver."""
    def work(batches):
        n, total = 0, None
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                n += len(x)
                # Halves of 32 bits: no sum over a batch passes 64 bits.
                high, low = x >> 32, x & 0xFFFFFFFF
                part = (high.sum(axis=0).astype(object) << 32) + low.sum(axis=0).astype(object)
                total = part if total is None else total + part
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, len(total)), pa.int32()),
                 pa.array([str(v) for v in (n, *total.tolist())], pa.string())], names=["dim", "total"])

    sums = (points.mapInArrow(work, "dim int, total string")
            .groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total")))
    found = {r["dim"]: int(r["total"]) for r in sums.collect()}
    n = found.pop(-1, 0)
    return n, tuple(found[k] for k in sorted(found))


def _scatter(points: DataFrame, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """Sum of products of centred grid points."""
    d = len(sums)

    def work(batches):
        total = np.zeros((d, d))
        for batch in batches:
            y = _centred(_matrix(batch.column(0)).reshape(-1, d), n, sums)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    def add(batches):
        total = np.zeros((d, d))
        for batch in batches:
            for part in batch.column(0):
                total += np.frombuffer(part.as_buffer(), np.float64).reshape(d, d)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = points.mapInArrow(work, "part binary").repartition(SUMS).mapInArrow(add, "part binary").collect()
    return sum((np.frombuffer(p["part"], np.float64).reshape(d, d) for p in parts), np.zeros((d, d)))


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order): a[order][:, order] = L L' with L lower trapezoidal, of as many columns as ``a`` has rank."""
    d = len(a)
    rest, order = a.copy(), np.arange(d)
    factor = np.zeros((d, d))
    least = d * np.finfo(float).eps * max(np.diag(a).max(initial=0.0), 0.0)
    for k in range(d):
        p = k + int(np.argmax(np.diag(rest)[k:]))
        if rest[p, p] <= least:
            return factor[:, :k], order
        for m in (rest, factor):
            m[[k, p]] = m[[p, k]]
        rest[:, [k, p]] = rest[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        factor[k, k] = np.sqrt(rest[k, k])
        factor[k + 1:, k] = rest[k + 1:, k] / factor[k, k]
        rest[k + 1:, k + 1:] -= np.outer(factor[k + 1:, k], factor[k + 1:, k])
    return factor, order


def orthogonal_columns(factor: np.ndarray) -> np.ndarray:
    """One-sided Jacobi: rotate pairs of columns until all are orthogonal to rounding.

    Each round rotates disjoint pairs at once; a sweep of rounds meets every pair.
    """
    g = factor.copy()
    r = g.shape[1]
    players = np.arange(r + r % 2)
    half = len(players) // 2
    small = np.finfo(float).eps * np.sqrt(max(len(g), 1))
    for _ in range(SWEEPS):
        turned = False
        for _ in range(max(len(players) - 1, 0)):
            p, q = players[:half], players[half:][::-1]
            real = (p < r) & (q < r)
            p, q = p[real], q[real]
            players = np.concatenate([players[:1], players[-1:], players[1:-1]])
            gp, gq = g[:, p], g[:, q]
            a, b, c = (gp * gp).sum(0), (gq * gq).sum(0), (gp * gq).sum(0)
            turn = np.abs(c) > small * np.sqrt(a * b)
            if not turn.any():
                continue
            turned = True
            a, b, c = a[turn], b[turn], c[turn]
            zeta = (b - a) / (2 * c)
            tangent = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cosine = 1 / np.hypot(1.0, tangent)
            sine = cosine * tangent
            g[:, p[turn]] = cosine * gp[:, turn] - sine * gq[:, turn]
            g[:, q[turn]] = sine * gp[:, turn] + cosine * gq[:, turn]
        if not turned:
            return g
    return g


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a positive semidefinite matrix, down to its rank.

    Of either sign the one whose largest entry (the first of equals) is positive.
    """
    factor, order = pivoted_cholesky(a)
    g = orthogonal_columns(factor)
    norms = np.sqrt((g * g).sum(axis=0))
    by = np.argsort(-norms, kind="stable")
    vectors = np.zeros_like(g)
    vectors[order] = g[:, by] / norms[by]
    if vectors.size:
        top = np.abs(vectors).argmax(axis=0)
        vectors *= np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return norms[by] ** 2, vectors


def _identity_error(points: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity."""
    k, d = len(model.eigenvalues), len(model.sums)
    kinds = "n long, mean binary, products binary"

    def merge(x, y):  # (n, means, centred products) of two disjoint lists
        n, step = x[0] + y[0], y[1] - x[1]
        return n, x[1] + step * (y[0] / n), x[2] + y[2] + np.outer(step, step) * (x[0] * y[0] / n)

    def row(x):
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0]], pa.int64()), pa.array([x[1].tobytes()], pa.binary()), pa.array([x[2].tobytes()], pa.binary())],
            names=["n", "mean", "products"])

    def read(r):
        return r["n"], np.frombuffer(r["mean"], np.float64), np.frombuffer(r["products"], np.float64).reshape(k, k)

    def work(batches):
        have = None
        for batch in batches:
            w = model.whitened(_matrix(batch.column(0)).reshape(-1, d))
            if len(w):
                mean = w.mean(axis=0)
                part = len(w), mean, (w - mean).T @ (w - mean)
                have = part if have is None else merge(have, part)
        if have:
            yield row(have)

    def add(batches):
        have = None
        for batch in batches:
            for r in batch.to_pylist():
                have = read(r) if have is None else merge(have, read(r))
        if have:
            yield row(have)

    have = None
    for r in points.mapInArrow(work, kinds).repartition(SUMS).mapInArrow(add, kinds).collect():
        have = read(r) if have is None else merge(have, read(r))
    return float(np.abs(have[2] / have[0] - np.eye(k)).max())


def fit(gridded: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct grid points ``__x``, with at most ``components`` components.

    None if there are no rows or all grid points are one (no direction has any
    variance). Components beyond the rank are left out.
    """
    points = stored(gridded.select("__x").distinct(), "whitening-points")
    n, sums = _sums(points)
    if n == 0:
        return None
    scatter = _scatter(points, n, sums)
    values, vectors = eigen(scatter)
    if not len(values):
        return None
    model = Whitening(n, sums, values[:components] / n, vectors[:, :components], float(np.trace(scatter)) / n, None)
    return Whitening(n, sums, model.eigenvalues, model.components, model.trace, _identity_error(points, model))


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Per row the exact sum of (n x - sums)^2; None where it passes a long."""
    limit = 1 << 63
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most * most * max(len(sums), 1) < limit:
        apart = n * x - np.array(sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    apart = n * x.astype(object) - np.array(sums, object)
    return [v if v < limit else None for v in (apart * apart).sum(axis=1)]


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row per usable row and component.

    Rows whose vector is null, empty, or holds null or non-finite entries are dropped,
    as are vectors of another than the commonest length. Null keys and repeated rows stay.
    The fit counts each distinct grid point once, so repeated rows do not move it.
    Entries from 2^55 on leave the grid of longs and are set to its end; a deviation
    beyond a long is null. Components are numbered from 1 by falling
    eigenvalue; directions without variance give none, so a table with one distinct
    vector, or with none, gives an empty result. Only ``key`` and ``vector`` are read.
    """
    gridded = grid(rows.select(F.col(key).alias("__key"), F.col(vector).alias("__v")), "__v").select("__key", "__x")
    model = fit(gridded, components)
    schema = T.StructType([T.StructField(key, gridded.schema["__key"].dataType)])
    for name, kind in (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()),
                       ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())):
        schema = schema.add(name, kind)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    k, d, explained = len(model.eigenvalues), len(model.sums), model.eigenvalues / model.trace

    def work(batches):
        for batch in batches:
            x = _matrix(batch.column(1)).reshape(-1, d)
            each = np.repeat(np.arange(len(x)), k)
            apart = pa.array(deviations(x, model.n, model.sums), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(each), model.n)), apart.take(pa.array(each)),
                 pa.array(model.whitened(x).reshape(-1)), pa.array(np.tile(explained, len(x))),
                 pa.array(np.full(len(each), model.identity_error))], names=schema.names)

    return gridded.mapInArrow(work, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """First four whitened components of every embedding."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
