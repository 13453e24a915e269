"""Operator 12: whitening of embeddings through an incremental eigendecomposition.

A spectrum is the count, the mean and the eigenpairs of the scatter matrix of some vectors. Each partition takes its vectors
one at a time: a centred rank-one update of the scatter, whose new eigenvalues are the roots of a secular equation. Pairs
that the update doesn't touch are deflated: equal eigenvalues are first turned so that one of them alone is touched, and
those whose part in the update is below rounding stay as they are. Two spectra combine by as many rank-one updates as there
are dimensions, and one more for the distance of the means; a tree of such combinations leaves one spectrum. Its basis is
then refined by a Rayleigh-Ritz step, whose projected covariance all partitions sum up, centred by the exact mean.

What the driver gets is bounded by the dimension: sums, one spectrum, one projected matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import settle, tuned

COMPONENTS = 4
#: Steps of a root of the secular equation at most; about eight are usual.
ROOT_STEPS = 80
#: Rows of the tree of partial results that one task combines.
FAN_IN = 16

_EPS = float(np.finfo(float).eps)


def secular_roots(poles: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum(squares / (poles - r)), one above each ascending pole: the index of a pole near it and the distance from that.

    Each step takes the root of a function with the two neighbouring poles that has the same value and slopes; the bracket
    is halved where that leads out of it.
    """
    n = len(poles)
    at = np.arange(n)
    gap = np.append(np.diff(poles), squares.sum())
    middle = 1 + (squares / (poles - (poles + gap / 2)[:, None])).sum(1)
    left = middle >= 0
    left[-1] = True
    near = np.where(left, at, np.minimum(at + 1, n - 1))
    apart = poles - poles[near][:, None]
    low, high = np.where(left, 0.0, -gap / 2), np.where(left, gap / 2, 0.0)
    high[-1] = gap[-1]
    below = np.tri(n, dtype=bool)
    own = apart[at, at]
    following = own + gap
    tau = (low + high) / 2
    open_ = np.ones(n, bool)
    with np.errstate(all="ignore"):
        for _ in range(ROOT_STEPS):
            parts = apart - tau[:, None]
            terms = squares / parts
            f = 1 + terms.sum(1)
            slopes = terms / parts
            psi = np.where(below, slopes, 0).sum(1)
            phi = slopes.sum(1) - psi
            low, high = np.where(f < 0, tau, low), np.where(f >= 0, tau, high)
            d0, d1 = own - tau, following - tau
            a, b, c = (d0 + d1) * f - d0 * d1 * (psi + phi), d0 * d1 * f, f - d0 * psi - d1 * phi
            root = np.sqrt(np.abs(a * a - 4 * b * c))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = tau + step
            new = np.where((new > low) & (new < high), new, (low + high) / 2)
            done = (np.abs(new - tau) <= 2 * _EPS * np.abs(tau)) | (f == 0)
            tau = np.where(open_ & ~done, new, tau)
            open_ &= ~done
            if not open_.any():
                break
    return near, tau


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues, and eigenvectors in columns, after weight * v v' (weight >= 0) is added to the matrix that has these."""
    z = vectors.T @ v
    size = float(np.sqrt(z @ z))
    if weight * size * size == 0:
        return values, vectors
    rounding = 8 * _EPS * max(float(np.abs(values).max()), weight * size * size)
    same = np.diff(values) <= rounding
    if same.any():
        vectors = vectors.copy()
        starts = np.flatnonzero(same & ~np.concatenate(([False], same[:-1])))
        ends = np.flatnonzero(same & ~np.concatenate((same[1:], [False]))) + 2
        for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
            u = z[i:j].copy()
            length = float(np.copysign(np.sqrt(u @ u), u[-1]))
            u[-1] += length
            if u @ u > 0:
                vectors[:, i:j] -= np.outer(vectors[:, i:j] @ u, 2 / (u @ u) * u)
                z[i:j] = 0
                z[j - 1] = -length
    moved = weight * np.abs(z) * size > rounding
    if not moved.any():
        return values, vectors
    poles, part = values[moved], z[moved]
    near, tau = secular_roots(poles, weight * part * part)
    new = poles[near] + tau
    from_root = poles - poles[near][:, None] - tau[:, None]  # a row for each root, a column for each pole
    # The update for which these roots are exact: its eigenvectors are orthogonal to rounding.
    n = len(poles)
    under = np.ones((n, n))
    if n > 1:
        differ = poles[:, None] - poles
        under[:-1] = np.where(np.tri(n, k=-1, dtype=bool).T[:-1], differ[:-1], differ[1:])
    exact = np.sqrt(np.abs(np.prod(-from_root / under, axis=0)))
    own = (np.copysign(exact, part) / from_root).T
    own /= np.sqrt((own * own).sum(0))
    values, vectors = values.copy(), vectors.copy()
    values[moved] = new
    vectors[:, moved] = vectors[:, moved] @ own
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Count, mean and eigenpairs of the scatter matrix of some vectors."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, width: int) -> Spectrum:
        return cls(0, np.zeros(width), np.zeros(width), np.eye(width))

    def add(self, x: np.ndarray) -> None:
        """Takes one more vector."""
        away = x - self.mean
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + away / self.n

    def combine(self, other: Spectrum) -> None:
        """Takes all that the other has taken."""
        if not other.n:
            return
        if not self.n:
            self.n, self.mean, self.values, self.vectors = other.n, other.mean, other.values, other.vectors
            return
        away, n = other.mean - self.mean, self.n + other.n
        self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n * other.n / n)
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
        self.n, self.mean = n, self.mean + away * (other.n / n)

    def flat(self) -> np.ndarray:
        return np.concatenate(([float(self.n)], self.mean, self.values, self.vectors.ravel()))

    @classmethod
    def of(cls, flat: np.ndarray, width: int) -> Spectrum:
        return cls(int(flat[0]), flat[1 : 1 + width], flat[1 + width : 1 + 2 * width], flat[1 + 2 * width :].reshape(width, width))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _one(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.tolist()], pa.list_(pa.float64()))], ["part"])


def _gathered(rows: DataFrame, width: int, make: Callable[[Iterator[np.ndarray]], np.ndarray | None], merge: Callable[[Iterator[np.ndarray]], np.ndarray]) -> np.ndarray | None:
    """make() of each partition's matrices, then merge() of FAN_IN results at a time until one is left; null if no partition has any."""
    tuned(rows.sparkSession)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = make(_matrix(b.column(0), width) for b in batches if b.num_rows)
        if made is not None:
            yield _one(made)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (np.asarray(x.values.to_numpy(zero_copy_only=False)) for b in batches for x in b.column(0))
        head = next(parts, None)
        if head is not None:
            yield _one(merge(_chained(head, parts)))

    parts = settle(rows.mapInArrow(first, "part array<double>"))
    left = parts.count()
    while left > 1:
        left = -(-left // FAN_IN)
        parts = settle(parts.repartition(left).mapInArrow(again, "part array<double>"))
    found = parts.first()
    return None if found is None else np.array(found["part"])


def _chained(head: np.ndarray, rest: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    yield head
    yield from rest


def _summed(parts: Iterator[np.ndarray]) -> np.ndarray:
    total = next(parts).copy()
    for p in parts:
        total += p
    return total


def spectrum_of(rows: DataFrame, width: int) -> Spectrum:
    """The spectrum of all vectors (x array<long>, each of this width), without the refinement."""

    def make(matrices: Iterator[np.ndarray]) -> np.ndarray | None:
        whole = Spectrum.empty(width)
        for m in matrices:
            for x in m.astype(float):
                whole.add(x)
        return whole.flat() if whole.n else None

    def merge(parts: Iterator[np.ndarray]) -> np.ndarray:
        whole = Spectrum.empty(width)
        for p in parts:
            whole.combine(Spectrum.of(p, width))
        return whole.flat()

    flat = _gathered(rows, width, make, merge)
    return Spectrum.empty(width) if flat is None else Spectrum.of(flat, width)


def fixed(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array of long) of the rows whose vector is whole: there, not empty, without null, NaN or infinite entries."""
    c = F.col("embedding").cast("array<double>")
    whole = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("embedding")).where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & whole)
    return rows.select("vec_id", F.transform("embedding", lambda v: F.floor(256 * v) + F.lit(0).cast("long")).alias("x"))


@dataclass
class Model:
    """width: dimensions of the vectors; n and sums: of the fit list; components: a row each, already divided by sqrt(eigenvalue)."""

    width: int
    n: int
    sums: list[int]
    components: np.ndarray
    explained: list[float]
    identity_error: float | None


def _sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """How many rows there are, and the exact sum of each dimension; halves of the numbers are summed apart, so none overflows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for b in batches:
            m = _matrix(b.column(0), width)
            n, high, low = n + len(m), high + (m >> 32).sum(0), low + (m & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(high), pa.array(low)], ["k", "n", "high", "low"])

    whole = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    found = rows.mapInArrow(each, "k int, n long, high long, low long").groupBy("k").agg(F.sum("n").alias("n"), whole("high"), whole("low")).orderBy("k").collect()
    return (int(found[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in found]) if found else (0, [])


def fit(rows: DataFrame) -> Model | None:
    """The model of fixed() rows: each distinct vector once. Vectors of another length than most have don't count; null without any."""
    distinct = settle(rows.select("x").distinct())
    most = distinct.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if most is None:
        return None
    width = int(most["width"])
    listed = distinct.where(F.size("x") == width)
    n, sums = _sums(listed, width)
    mean = np.array([s / n for s in sums])
    basis = np.linalg.qr(spectrum_of(listed, width).vectors)[0]

    def projected(matrices: Iterator[np.ndarray]) -> np.ndarray | None:
        total = None
        for m in matrices:
            y = (m - mean) @ basis
            total = y.T @ y if total is None else total + y.T @ y
        return None if total is None else total.ravel()

    ritz = _gathered(listed, width, projected, _summed).reshape(width, width) / n
    values, turns = np.linalg.eigh((ritz + ritz.T) / 2)
    total = float(values.sum())
    top = [k for k in range(width - 1, -1, -1)[:COMPONENTS]]
    lasting = np.array([values[k] > width * _EPS * max(total, 0.0) and total > 0 for k in top])
    scale = np.array([1 / np.sqrt(values[k]) if ok else np.nan for k, ok in zip(top, lasting, strict=True)])
    components = (basis @ turns[:, top] * scale).T
    explained = [float(values[k] / total) if ok else 0.0 for k, ok in zip(top, lasting, strict=True)]
    error = None
    if lasting.any():
        kept = components[lasting]

        def moments(matrices: Iterator[np.ndarray]) -> np.ndarray | None:
            total = None
            for m in matrices:
                w = (m - mean) @ kept.T
                part = np.concatenate((w.sum(0), (w.T @ w).ravel()))
                total = part if total is None else total + part
            return total

        found = _gathered(listed, width, moments, _summed) / n
        k = len(kept)
        error = float(np.abs(found[k:].reshape(k, k) - np.outer(found[:k], found[:k]) - np.eye(k)).max())
    return Model(width, n, sums, components, explained, error)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """sum((n * x - S) ** 2) of each row, exact; null where it is beyond a long."""
    about = (n * x.astype(float) - np.array(sums, float)) ** 2
    if float(about.sum(1).max(initial=0)) < 2.0**62 and max(map(abs, sums)) < 2**62 and n * float(np.abs(x.astype(float)).max(initial=0)) < 2.0**62:
        away = n * x - np.array(sums, np.int64)
        return (away * away).sum(1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


def whiten(vectors: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each whole vector and component up to COMPONENTS.

    Rows that repeat, and rows without an id, each give their own; vectors of another length than most distinct ones have
    give none, nor does an empty table. A component without variance has whitened null and explained 0; without any variance
    identity_error is null too. A deviation beyond a long is null. Of equal eigenvalues any eigenvectors are taken. Columns of
    other names aren't looked at.
    """
    spark = tuned(vectors.sparkSession)
    rows = fixed(vectors)
    model = fit(rows)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], schema)
    mean, k, width = np.array([s / model.n for s in model.sums]), len(model.components), model.width

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), width)
            whitened = ((x - mean) @ model.components.T).ravel()
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n, np.int64)),
                    pa.array([v for v in _deviations(x, model.n, model.sums) for _ in range(k)], pa.int64()),
                    pa.array(whitened, mask=np.isnan(whitened)),
                    pa.array(np.tile(model.explained, m)),
                    pa.array([model.identity_error] * (m * k), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.where(F.size("x") == width).mapInArrow(each, schema)
