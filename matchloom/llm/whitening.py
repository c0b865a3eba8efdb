"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: An entry c becomes the integer floor(SCALE * c) + SHIFT; entries beyond +-LIMIT count as +-LIMIT.
SCALE, SHIFT, LIMIT = 1024, 100_000, float(1 << 42)

#: Sums of integers are kept in two parts that cannot overflow: multiples of 2^PART and the rest.
PART = 26

#: Cosine of two columns below which they count as orthogonal, and sweeps after which the rotation must have settled.
ORTHOGONAL, MAX_SWEEPS = 1e-15, 60


@dataclass(frozen=True)
class Whitening:
    """What was learnt: number of vectors, exact sums, and the covariance's components (columns) by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """``L`` of full column rank with ``L @ L.T == a``; in the order of its pivots its rows are lower triangular."""
    d = len(a)
    low, left, free = np.zeros((d, d)), a.diagonal().astype(float), np.ones(d, bool)
    least = d * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    for k in range(d):
        pivot = int(np.argmax(np.where(free, left, -np.inf)))
        if left[pivot] <= least:
            return low[:, :k]
        free[pivot] = False
        low[pivot, k] = root = np.sqrt(left[pivot])
        low[free, k] = (a[free, pivot] - low[free, :k] @ low[pivot, :k]) / root
        left[free] -= low[free, k] ** 2
    return low


def one_sided_jacobi(low: np.ndarray) -> np.ndarray:
    """``low`` times a rotation, with orthogonal columns by falling norm. Disjoint pairs of columns turn at once."""
    g = low.astype(float)
    if g.shape[1] % 2:
        g = np.column_stack([g, np.zeros(len(g))])
    half, ring = g.shape[1] // 2, np.arange(g.shape[1])
    for _ in range(MAX_SWEEPS):
        worst = 0.0
        for _ in range(max(0, len(ring) - 1)):
            p, q = ring[:half], ring[half:][::-1]
            x, y = g[:, p], g[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            cosine = np.abs(xy) / np.sqrt(np.maximum(xx * yy, np.finfo(float).tiny))
            worst = max(worst, cosine.max())
            turn = cosine > ORTHOGONAL
            zeta = (yy - xx) / np.where(turn, 2 * xy, 1.0)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            g[:, p], g[:, q] = c * x - c * t * y, c * t * x + c * y
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if worst <= ORTHOGONAL * len(g):
            break
    norms = (g * g).sum(0)
    order = np.argsort(-norms, kind="stable")[:low.shape[1]]
    return g[:, order]


def _usable(df: DataFrame, vector_col: str) -> DataFrame:
    odd = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return df.filter(F.col(vector_col).isNotNull() & ~odd)


def _integers(column: pa.Array, d: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return np.floor(np.clip(values, -LIMIT, LIMIT) * SCALE).astype(np.int64) + SHIFT


class _Centre:
    """Mean of each dimension as an integer and a fraction, so that centring is exact but for one rounding."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.whole, self.rest = n, np.array([s // n for s in sums], np.int64), [s % n for s in sums]
        self.part = np.array([r / n for r in self.rest])

    def steps(self, x: np.ndarray) -> np.ndarray:
        return x - self.whole

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.steps(x) - self.part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Per row the sum of (n * x - S)^2, in integers of any size; null beyond a long."""
        u = self.steps(x)
        rest = np.array(self.rest, np.int64)
        if len(u) and float(np.abs(u).max()) * max(float(np.abs(u).max()), float(rest.max())) * u.shape[1] < 2.0 ** 62:
            squares, mixed = (u * u).sum(1).tolist(), (u * rest).sum(1).tolist()
        else:
            squares = [sum(a * a for a in row) for row in u.tolist()]
            mixed = [sum(a * b for a, b in zip(row, self.rest, strict=True)) for row in u.tolist()]
        last, n = sum(r * r for r in self.rest), self.n
        out = [n * n * s - 2 * n * m + last for s, m in zip(squares, mixed, strict=True)]
        return [v if v < 1 << 63 else None for v in out]


def _sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = _integers(batch.column(0), d)
            n, high, low = n + len(x), high + (x >> PART).sum(0), low + (x & ((1 << PART) - 1)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n] * d, pa.int64()), pa.array(range(d), pa.int32()), pa.array(high), pa.array(low)], names=["n", "i", "high", "low"])

    parts = vectors.mapInArrow(summed, "n long, i int, high long, low long").groupBy("i").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low")))
    rows = sorted(parts.collect())
    return (rows[0]["n"] if rows else 0), [(r["high"] << PART) + r["low"] for r in rows]


def _scatter(vectors: DataFrame, d: int, centre: _Centre) -> np.ndarray:
    """Sum of products of centred vectors: a matrix a task, added up row by row in as many tasks as there are rows."""

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((d, d))
        for batch in batches:
            y = centre.centred(_integers(batch.column(0), d))
            out += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(list(out), pa.list_(pa.float64()))], names=["i", "row"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), _rows(batch.column(1), d), strict=True):
                out[i] = out.get(i, 0.0) + row
        yield pa.RecordBatch.from_arrays([pa.array([*out], pa.int32()), pa.array([*out.values()], pa.list_(pa.float64()))], names=["i", "row"])

    parts = vectors.mapInArrow(multiplied, "i int, row array<double>").repartition("i").mapInArrow(added, "i int, row array<double>")
    out = np.array([r["row"] for r in sorted(parts.collect(), key=lambda r: r["i"])])
    return (out + out.T) / 2


def _rows(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def dimension(df: DataFrame, vector_col: str = "embedding") -> int:
    """The most frequent length of usable vectors, of equally frequent ones the greatest; 0 if there are none."""
    top = _usable(df, vector_col).groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else 0


def fit(df: DataFrame, vector_col: str = "embedding") -> Whitening | None:
    """Learn from all usable vectors of the table's ``dimension``; None without any. What reaches the driver is one
    matrix of that dimension squared, however many vectors there are."""
    d = dimension(df, vector_col)
    if not d:
        return None
    vectors = _usable(df, vector_col).filter(F.size(vector_col) == d).select(vector_col)
    n, sums = _sums(vectors, d)
    scatter = _scatter(vectors, d, _Centre(n, sums))
    turned = one_sided_jacobi(pivoted_cholesky(scatter))
    norms = (turned * turned).sum(0)
    return Whitening(n, sums, norms / n, turned / np.sqrt(norms), float(scatter.trace()) / n)


def transform(df: DataFrame, model: Whitening, components: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id_col, deviation, whitened)`` of each usable vector of the model's dimension; ``whitened`` is an array of the
    first ``components`` (or as many as have a positive eigenvalue)."""
    d, centre = len(model.sums), _Centre(model.n, model.sums)
    k = min(components, len(model.values))
    scaled = model.axes[:, :k] / np.sqrt(model.values[:k])
    kind = df.schema[id_col].dataType.simpleString()

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _integers(batch.column(1), d)
            w = pa.array((centre.centred(x) @ scaled).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), w)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(centre.deviations(x), pa.int64()), lists], names=["id", "deviation", "whitened"])

    vectors = _usable(df, vector_col).filter(F.size(vector_col) == d).select(F.col(id_col).alias("id"), vector_col)
    return vectors.mapInArrow(whitened, f"id {kind}, deviation long, whitened array<double>").withColumnRenamed("id", id_col)


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of the column ``whitened`` minus the identity."""

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = _rows(batch.column(0), k)
            total, squares = total + w.sum(0), squares + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k + k), pa.int32()), pa.array(np.concatenate([squares.ravel(), total]))], names=["i", "v"])

    sums = whitened.select("whitened").mapInArrow(multiplied, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    flat = np.array([r["v"] for r in sorted(sums.collect(), key=lambda r: r["i"])])
    mean = flat[k * k:] / n  # of centred values: nought but for rounding
    return float(np.abs(flat[:k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(df: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id_col, component, n, deviation, whitened, explained, identity_error)``: a row for each usable vector and
    component.

    An entry c counts as the integer floor(1024 * c) + 100000 (entries beyond +-2^42 as +-2^42). Vectors that are null
    or hold a null or non-finite entry take no part and get no rows; neither do vectors of another length than the most
    frequent one. Components without variance get no rows, so equal vectors alone, empty vectors and an empty table
    give no rows. Repeated ids and repeated vectors are vectors of their own; a null id stays null. ``deviation`` is
    exact, and null if it does not fit a long. Other columns are not carried along.
    """
    kind = df.schema[id_col].dataType.simpleString()
    model = fit(df, vector_col)
    k = min(components, len(model.values)) if model else 0
    if not k:
        return df.sparkSession.createDataFrame([], f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = stored(transform(df, model, k, id_col, vector_col), "whitened")
    error = identity_error(rows, model.n, k)
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.values[:k]))
    each = rows.select(id_col, "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    return each.select(id_col, (F.col("_k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       explained[F.col("_k")].alias("explained"), F.lit(error).alias("identity_error"))
