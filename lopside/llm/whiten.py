"""Whitening of vectors by Chebyshev-filtered subspace iteration.

The largest principal components are found without forming the covariance: a
pass over the centred rows gives (1 / n) XᵀXQ for a block Q of a few directions,
and a Chebyshev polynomial of that product, built by its three-term recurrence,
one pass for each degree, shrinks all of the spectrum below the block and lets
what is above grow. QR makes the block orthonormal, a Rayleigh-Ritz step turns
it to the best components in it, and the smallest value found bounds the spectrum to
damp next. The last pass of a round also gives the residuals |Vq - eq|; rounds
end when those of all wanted components are certified small.

A pass leaves one block of numbers per partition, added up in two levels, so
the driver gets at most SHARDS blocks of (dimensions x directions).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = 32
GUARD = 16  # directions beyond the wanted ones: they widen the gap that is damped
DEGREE = 8
TOLERANCE = 1e-13  # residual over the largest eigenvalue
ACCEPTED = 1e-10  # what rounding may leave if rounds no longer gain
MAX_ROUNDS = 60
GROWTH = 1e8  # most that a round lets the largest component outgrow the damped ones
ZERO = 1e-13  # eigenvalues below this share of the largest are zero


@dataclass
class Whitener:
    """Fitted components: ``vectors`` is dimensions x components."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residual: float  # largest |Vq - eq| / e1 of the components
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def usable(vector: str = "embedding") -> Column:
    """The vector is there and holds neither null nor non-finite entries."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(vector).isNotNull() & fine


def _matrix(column) -> np.ndarray:
    width = len(column.flatten()) // len(column) if len(column) else 0
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(column) and not np.all(np.diff(column.offsets.to_numpy()) == width):
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(column), width)


def _plus(total: np.ndarray | None, part: np.ndarray) -> np.ndarray:
    if total is not None and total.shape != part.shape:
        raise ValueError("vectors of different lengths")
    return part if total is None else total + part


def _sum(rows: DataFrame, of, dtype) -> np.ndarray:
    """Sum over all rows of ``of(matrix)``, an array of one fixed shape.

    Partitions are summed alone, then in SHARDS groups, then on the driver in
    order of the group, so that reruns on the same files add alike.
    """
    element = "bigint" if dtype == np.int64 else "double"
    kind = pa.list_(pa.int64() if dtype == np.int64 else pa.float64())
    schema = f"part int, m array<{element}>"

    def one(batches):
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                total = _plus(total, of(_matrix(batch.column(0))))
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()),
                 pa.array([np.ascontiguousarray(total).ravel()], kind)], names=["part", "m"])

    def add(key, table):
        table = table.sort_by("part")
        summed = None
        for m in table.column("m").combine_chunks():
            summed = _plus(summed, np.asarray(m.values, dtype=dtype))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "m": pa.array([summed], kind)})

    parts = rows.mapInArrow(one, schema)
    merged = parts.groupBy((F.col("part") % SHARDS).alias("shard")).applyInArrow(add, schema)
    total = None
    for row in sorted(merged.collect(), key=lambda r: r["part"]):
        total = _plus(total, np.array(row["m"], dtype=dtype))
    return np.zeros(0, dtype) if total is None else total


def fit_whitening(rows: DataFrame, k: int, vector: str = "x", seed: int = 0) -> Whitener | None:
    """The ``k`` largest components of an ``array<bigint>`` column without nulls.

    Rows are read once for each pass: hand in a written table. Repeated rows
    count as often as they stand. Components of eigenvalue zero are left out, so
    fewer than ``k`` come back for few dimensions, few rows or equal rows; no rows
    give None. Vectors of different lengths are an error.
    """
    only = rows.select(vector)
    head = _sum(only, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]).astype(np.int64), np.int64)
    if not len(head):
        return None
    n, sums = int(head[0]), [int(s) for s in head[1:]]
    d, mean = len(sums), np.array([s / int(head[0]) for s in head[1:]])
    trace = float(np.sum(_sum(only, lambda x: ((x - mean) ** 2).sum(axis=0), np.float64))) / n
    fitted = Whitener(n, sums, np.zeros((d, 0)), np.zeros(0), trace, 0.0, 2)
    if not trace > 0:
        return fitted

    def product(q: np.ndarray) -> np.ndarray:
        """V q, in one pass."""
        def partial(x):
            centred = x - mean
            return centred.T @ (centred @ q)

        fitted.passes += 1
        return _sum(only, partial, np.float64).reshape(q.shape) / n

    def ritz(q: np.ndarray):
        """(directions turned to components, their images, values falling)."""
        image = product(q)
        inner = q.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        turn = turn[:, ::-1]
        return q @ turn, image @ turn, values[::-1]

    def certified() -> int:
        """How many leading directions of the block are components by now."""
        nonlocal best, stalled
        off = np.linalg.norm(image - q * values, axis=0) / top
        wanted = off[: k - locked.shape[1]]
        stalled = 0 if wanted.max() < best / 2 else stalled + 1
        best = min(best, float(wanted.max()))
        allowed = ACCEPTED if stalled >= 2 else TOLERANCE
        fine = (wanted <= allowed) & (values[: len(wanted)] > ZERO * top)
        count = len(fine) if fine.all() else int(np.argmin(fine))
        fitted.residual = max(fitted.residual, float(off[:count].max(initial=0.0)))
        return count

    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(d, k + GUARD))))
    q, image, values = ritz(q)
    locked, found, top = np.zeros((d, 0)), [], float(values[0])
    best, stalled = np.inf, 0

    def clear(y: np.ndarray) -> np.ndarray:
        """``y`` without what is locked, which would outgrow the rest."""
        return y - locked @ (locked.T @ y)

    for _ in range(MAX_ROUNDS):
        done = certified()
        if done:
            locked, found = np.hstack([locked, q[:, :done]]), [*found, *values[:done]]
            q, image, values = q[:, done:], image[:, done:], values[done:]
            best, stalled = np.inf, 0
        if len(found) == k or not len(values) or values[0] <= ZERO * top:
            break
        # The polynomial maps [0, bound] to [-1, 1], where it stays small; scaling
        # by its growth at the largest value keeps numbers in range. Its degree
        # falls where that growth would drown the smaller wanted components.
        bound = max(float(values[-1]), ZERO * top)
        centre = half = bound / 2
        first = half / (float(values[0]) - centre)
        degree = DEGREE if first >= 1 else max(1, min(DEGREE, int(np.arccosh(GROWTH) / np.arccosh(1 / first))))
        scale = first
        past, now = q, clear((image - centre * q) * (scale / half))
        for _ in range(degree - 1):
            following = 1 / (2 / first - scale)
            past, now = now, clear(
                (product(now) - centre * now) * (2 * following / half) - past * (scale * following))
            scale = following
        q, _ = np.linalg.qr(now / np.maximum(np.linalg.norm(now, axis=0), 1e-300))
        q, _ = np.linalg.qr(clear(q))
        q, image, values = ritz(q)
    else:
        raise RuntimeError(f"residual {best:.1e} after {MAX_ROUNDS} rounds")
    order = np.argsort(found)[::-1]
    fitted.vectors, fitted.values = locked[:, order], np.array(found)[order]
    return fitted


def whiten(rows: DataFrame, fitted: Whitener, vector: str = "x", output: str = "whitened") -> DataFrame:
    """``rows`` with ``output``: the centred vector on each component, over the
    root of its eigenvalue. Rows must hold vectors like those fitted on."""
    mean, loadings = fitted.mean, fitted.vectors / np.sqrt(fitted.values)

    def apply(batches):
        for batch in batches:
            x = _matrix(batch.column(at))
            out = (x - mean) @ loadings if len(x) else np.zeros((0, loadings.shape[1]))
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * loadings.shape[1])
            columns = [c for c, name in zip(batch.columns, batch.schema.names) if name != output]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=names)

    at = rows.columns.index(vector)
    kept = [f for f in rows.schema.fields if f.name != output]
    names = [*(f.name for f in kept), output]
    schema = rows.select(*[f.name for f in kept], F.array(F.lit(0.0)).alias(output)).schema
    return rows.mapInArrow(apply, schema)


def identity_error(whitened: DataFrame, n: int, column: str = "whitened") -> float:
    """Largest entry of the whitened rows' covariance minus the identity."""
    only = whitened.select(column)
    sums = _sum(only, lambda w: w.sum(axis=0), np.float64)
    if not len(sums):
        return 0.0
    mean, k = sums / n, len(sums)
    inner = _sum(only, lambda w: (w - mean).T @ (w - mean), np.float64).reshape(k, k) / n
    return float(np.abs(inner - np.eye(k)).max())
