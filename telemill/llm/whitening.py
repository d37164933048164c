"""Embedding whitening: principal components of a distributed covariance, each scaled to unit variance.

Three passes over a written table. The first sums the integer vectors exactly. The second centres every vector at
the nearest whole number of the mean and multiplies afterwards, so products are small whole numbers and their sums exact
in double precision as long as they stay under 2^53; what the rounding of the centre leaves is taken off at the end. The covariance, as
wide as the vectors, comes to the driver: Householder reflections make it tridiagonal, bisection on Sturm counts
finds the leading eigenvalues, inverse iteration their vectors, made orthogonal within clusters of close eigenvalues, and the
reflections carry them back. The third pass projects with the components broadcast.

Defined results: vectors that are null, empty, or hold a null or non-finite component, or have another dimension than most, take no part; scaled components are held
within 2^52; repeated rows count each; components whose eigenvalue is zero but for rounding have no unit
variance and are left out, so fewer than two different vectors give no rows; ``deviation`` is null where it exceeds 64 bits; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import finite_vectors, shared_dir, written

EPS = np.finfo(float).eps
LONGEST = 1 << 52


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit vectors of the Householder reflections that make a symmetric matrix tridiagonal."""
    a, n, reflections = a.copy(), len(a), []
    for k in range(n - 2):
        x = a[k + 1 :, k]
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        length = np.linalg.norm(v)
        v = v / length if length else v  # a column of zeros stays
        reflections.append(v)
        rest = a[k + 1 :, k + 1 :]
        w = rest @ v
        w = w - (v @ w) * v
        rest -= 2.0 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2.0 * v * (v @ x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def sturm_counts(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie under each value: the negative terms of the Sturm sequence of ratios."""
    least = EPS * max(1e-300, float(np.abs(d).max(initial=0) + 2 * np.abs(e).max(initial=0)))
    q, n = d[0] - at, np.zeros(len(at), int)
    for i in range(len(d)):
        if i:
            q = d[i] - at - e[i - 1] ** 2 / q
        q = np.where(np.abs(q) < least, -least, q)
        n += q < 0
    return n


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest, falling, by bisection until an interval holds no further double."""
    around = np.abs(np.r_[e, 0.0]) + np.abs(np.r_[0.0, e])
    low, high = np.full(k, (d - around).min()), np.full(k, (d + around).max())
    margin = EPS * len(d) * np.maximum(np.abs(low), np.abs(high))
    low, high = low - margin, high + margin
    rank = len(d) - 1 - np.arange(k)  # so many eigenvalues are smaller
    while True:
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high)).any():
            return middle
        under = sturm_counts(d, e, middle) > rank
        low, high = np.where(under, low, middle), np.where(under, middle, high)


def solve_shifted(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """Solution of (T - shift) x = b by elimination with row exchanges; vanishing pivots are replaced by tiny ones."""
    n, x = len(d), b.copy()
    main, up, up2 = d - shift, np.r_[e, 0.0], np.zeros(n)
    tiny = EPS * max(1e-300, float(np.abs(d).max() + 2 * np.abs(e).max(initial=0)))
    for i in range(n - 1):
        below = e[i]
        if abs(main[i]) >= abs(below):
            pivot = main[i] if main[i] else tiny
            main[i] = pivot
            f = below / pivot
            main[i + 1] -= f * up[i]
            x[i + 1] -= f * x[i]
        else:
            f = main[i] / below
            main[i], up_i, next_main, next_up = below, up[i], main[i + 1], up[i + 1]
            up[i], up2[i] = next_main, next_up
            main[i + 1], up[i + 1] = up_i - f * next_main, -f * next_up
            x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
    for i in range(n - 1, -1, -1):
        pivot = main[i] if abs(main[i]) > tiny else np.copysign(tiny, main[i] or 1.0)
        x[i] = (x[i] - (up[i] * x[i + 1] if i + 1 < n else 0.0) - (up2[i] * x[i + 2] if i + 2 < n else 0.0)) / pivot
    return x


def inverse_iteration(d: np.ndarray, e: np.ndarray, values: np.ndarray, rounds: int = 6, close: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Unit eigenvectors, a column each. Vectors of eigenvalues closer than ``close`` of the norm are made orthogonal to those before them in every round."""
    rng, norm = np.random.default_rng(seed), max(1e-300, float(np.abs(d).max() + 2 * np.abs(e).max(initial=0)))
    out, first = np.zeros((len(d), len(values))), 0
    shift = np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > close * norm:
            first = j
        shift = min(value, shift - 4 * EPS * norm) if j > first else value  # equal eigenvalues get shifts apart
        x = rng.standard_normal(len(d))
        for _ in range(rounds):
            x = solve_shifted(d, e, shift, x / np.linalg.norm(x))
            x = x / np.abs(x).max()
            for _ in range(2):
                x = x - out[:, first:j] @ (out[:, first:j].T @ x)
        out[:, j] = x / np.linalg.norm(x)
    return out


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors, a column each) of the ``k`` largest eigenvalues of a symmetric matrix. The largest entry of a vector is positive."""
    size, k = float(np.abs(v).max(initial=0)), min(k, len(v))
    if not size:
        return np.zeros(k), np.eye(len(v))[:, :k]
    d, e, reflections = tridiagonal(v / size)
    values = leading_eigenvalues(d, e, k)
    vectors = inverse_iteration(d, e, values)
    for i in range(len(reflections) - 1, -1, -1):
        h = reflections[i]
        vectors[i + 1 :] -= 2.0 * np.outer(h, h @ vectors[i + 1 :])
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return values * size, vectors * sign


@dataclass
class Whitening:
    """Number and exact sums of the fitted vectors, eigenvalues and unit components (columns), and the trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n * x - sums, exact; x - mean) of integer vectors."""
        most = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        z = x * self.n - np.array(self.sums, np.int64) if most < 1 << 62 else x.astype(object) * self.n - np.array(self.sums, object)
        return z, (z / self.n).astype(float)


def integers(vectors: DataFrame, scale: int, offset: int, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    rows, width = finite_vectors(vectors, vector_column, {"id": F.col(id_column)})
    x = F.transform("v", lambda c: F.least(F.greatest(F.floor(scale * c), F.lit(-LONGEST)), F.lit(LONGEST)) + offset)
    return written(rows.select("id", x.alias("x")), "whitening-vectors"), width


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def fit(rows: DataFrame, width: int, k: int) -> Whitening:
    """The whitening of the integer vectors ``x``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            for part in np.array_split(matrix(batch.column(0), width), -(-batch.num_rows // 500) or 1):  # 500 * 2^53 fits into 64 bits
                total = [a + b for a, b in zip(total, part.sum(axis=0).tolist(), strict=True)]
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([Decimal(s) for s in total], pa.decimal128(38)), pa.array([n] * width)], names=["i", "s", "n"])

    sums_ = rows.select("x").mapInArrow(add, "i int, s decimal(38,0), n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()  # a row per dimension
    n = sums_[0]["n"] if sums_ else 0
    sums = [int(r["s"]) for r in sums_]
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    at = rows.sparkSession.sparkContext.broadcast(np.array(centre, np.int64))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = (matrix(batch.column(0), width) - at.value).astype(float)
            total += x.T @ x
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "s"])

    products = rows.select("x").mapInArrow(multiply, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # as many as the covariance has entries
    v = np.zeros((width, width))
    for r in products:
        v[r["i"], r["j"]] = v[r["j"], r["i"]] = r["s"] / n
    rest = np.array([(s - n * c) / n for s, c in zip(sums, centre, strict=True)])  # the mean's distance from the centre, at most a half
    v -= np.outer(rest, rest)
    values, components = leading_components(v, k)
    trace = float(np.trace(v))
    good = values > 8 * EPS * width * max(trace, 0.0)
    return Whitening(n, sums, values[good], components[:, good], trace)


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, k: int = 8, scale: int = 1024, offset: int = 100_000, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """A row per vector and component (from 1): id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    shared_dir(spark)
    rows, width = integers(vectors, scale, offset, id_column, vector_column)
    model = fit(rows, width, k)
    kind = rows.schema["id"].dataType.simpleString()
    k = len(model.values)
    if not k:
        return spark.createDataFrame([], f"id {kind}, {SCHEMA}")
    shared = spark.sparkContext.broadcast(model)  # as many numbers as k dimensions have

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            z, centred = m.centred(matrix(batch.column(1), width))
            w = centred @ m.components / np.sqrt(m.values)
            if z.dtype == object or float((z.astype(float) ** 2).sum(axis=1).max(initial=0)) >= 2.0**62:
                deviation = [s if (s := sum(int(c) ** 2 for c in row)) < 1 << 63 else None for row in z]
            else:
                deviation = (z * z).sum(axis=1).tolist()
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * k, pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), flat], names=["id", "deviation", "w"])

    done = written(rows.mapInArrow(project, f"id {kind}, deviation long, w array<double>"), "whitened")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = done.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True))
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    return done.select("id", "deviation", F.posexplode("w").alias("_at", "whitened")).select(
        "id", (F.col("_at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("_at")).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
