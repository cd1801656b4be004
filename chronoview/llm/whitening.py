"""Embedding whitening: exact covariance by Spark, leading eigenpairs by FEAST contour integration.

Vectors become integers, so sums and products over all distinct vectors are exact however rows are dealt out:
tasks add up blocks, Spark adds up tasks, and the driver gets sums of the size of one matrix (dimensions squared,
whatever the number of rows). The eigenpairs of that matrix are found by FEAST: a quadrature of resolvents
(z - V)^-1 Y on a contour around the wanted eigenvalues projects Y onto their space, Rayleigh-Ritz takes
the pairs out of it, and the inertia of V - s (pivots of its tridiagonal form) says how many there must be.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free

#: Nodes of the quadrature on the upper half of the contour; turns of FEAST at most for one subspace.
NODES, TURNS = 8, 30
EXACT = 2.0**53
LONG = 2**63 - 1
ROWS = "vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, x array<bigint>): each component c, as a double, becomes floor(scale * c), held to 64 bits. Rows
    whose vector is null or has a null or non-finite component are dropped; a null vec_id stays."""
    v = F.col("embedding")
    fit = F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return vectors.where(v.isNotNull() & fit).select("vec_id", F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a batch as rows of integers; shorter ones end in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    if width and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _whole(x: np.ndarray) -> np.ndarray:
    """The same numbers as Python's integers, which have no bound."""
    return x.astype(object)


def gram(y: np.ndarray) -> np.ndarray:
    """Y'Y of integers, exactly: in doubles where no sum can pass 53 bits, else in Python's integers."""
    top = float(np.abs(y.astype(np.float64)).max(initial=0))
    if top * top * max(1, len(y)) < EXACT:
        z = y.astype(np.float64)
        return _whole((z.T @ z).astype(np.int64))
    z = _whole(y)
    return z.T.dot(z)


def _summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], width: int, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows of part(block), whose entries are integers: one partial sum a task, added by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, object)
        for batch in batches:
            if batch.num_rows:
                total = total + part(_matrix(batch.column(0), width))
        at = np.flatnonzero(total != 0)
        values = [str(v) for v in total.ravel()[at]]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(values, pa.string())], names=["at", "v"])

    summed = rows.select("x").mapInArrow(run, "at bigint, v string").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out = np.zeros(shape, object)
    for at, v in summed.collect():  # as many rows as the shape has places
        out.flat[at] = int(v)
    return out


def moments(fit: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sums S by dimension and covariance V (divisor n) of the distinct vectors. Vectors are centred on the
    rounded mean before they are multiplied, and what is left of the mean is taken off exactly; V is rounded once."""
    n, width = fit.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    sums = _summed(fit, lambda x: _whole(x).sum(0), width, (width,))
    near = np.array([(2 * int(s) + n) // (2 * n) for s in sums], object) if n else sums
    small = near.astype(np.int64)

    def centred(x: np.ndarray) -> np.ndarray:
        safe = float(np.abs(x.astype(np.float64)).max(initial=0)) < 2.0**62 and float(np.abs(small.astype(np.float64)).max(initial=0)) < 2.0**62
        return gram(x - small) if safe else (lambda z: z.T.dot(z))(_whole(x) - near)

    products = _summed(fit, centred, width, (width, width))
    left = sums - n * near
    top = n * products - np.outer(left, left)
    return n, sums, np.array([[int(t) / (n * n) for t in row] for row in top], np.float64).reshape(width, width)


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared off-diagonal of a similar tridiagonal matrix, by Householder reflections."""
    a = v.copy()
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x[0] += np.copysign(size, x[0])
        x /= np.linalg.norm(x)
        a[k + 1 :, :] -= 2 * np.outer(x, x @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1) ** 2


def above(form: tuple[np.ndarray, np.ndarray], at: float) -> int:
    """How many eigenvalues are above ``at``: the positive pivots of the tridiagonal form less at (its inertia)."""
    diagonal, squares = form
    count, pivot = 0, 1.0
    for i, x in enumerate(diagonal):
        pivot = x - at - (squares[i - 1] / pivot if i else 0.0)
        if abs(pivot) < 1e-300:
            pivot = -1e-300
        count += pivot > 0
    return count


def _edge(form: tuple[np.ndarray, np.ndarray], k: int, top: float) -> tuple[float, float]:
    """(low, high) around the k-th largest eigenvalue, as near as doubles have it."""
    low, high = -top * 1e-3, top
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if above(form, mid) >= k else (low, mid)
    return low, high


def project(v: np.ndarray, y: np.ndarray, low: float, high: float) -> np.ndarray:
    """Y projected onto the eigenvectors whose eigenvalues are between low and high: the Gauss-Legendre
    quadrature of (z - V)^-1 Y on the circle over that interval."""
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(y)
    for x, w in zip(*np.polynomial.legendre.leggauss(NODES), strict=True):
        turn = np.exp(1j * np.pi / 2 * (x + 1))
        solved = np.linalg.solve((centre + radius * turn) * np.eye(len(v)) - v, y.astype(complex))
        out += w / 2 * (radius * turn * solved).real
    return out


def feast(v: np.ndarray, low: float, high: float, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` eigenpairs between low and high, largest first. The count comes from the inertia; a
    subspace in which fewer are found is widened, at last to the whole space."""
    d = len(v)
    size = min(d, wanted + max(4, wanted))
    while True:
        y = np.random.default_rng(7).standard_normal((d, size))
        best = np.inf
        for _ in range(TURNS):
            q = np.linalg.qr(project(v, y, low, high))[0]
            values, small = np.linalg.eigh(q.T @ v @ q)
            y = q @ small
            inside = np.flatnonzero((values > low) & (values < high))[::-1]
            left = np.linalg.norm(v @ y[:, inside] - y[:, inside] * values[inside], axis=0).max(initial=0)
            if len(inside) == wanted and (left <= 1e-15 * high or left >= best / 2 and left <= 1e-12 * high):
                return values[inside], y[:, inside]
            best = min(best, left) if len(inside) == wanted else np.inf
        if size == d:
            raise ArithmeticError(f"{len(inside)} of {wanted} eigenvalues found")
        size = min(d, 2 * size)


def leading(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues (at most ``components``, none that is 0 to double precision) and their unit
    eigenvectors in columns. Where eigenvalues tie over the edge, all that tie are found and the first stay."""
    trace = float(np.trace(v)) if len(v) else 0.0
    if not trace > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    scaled = v / trace
    form = tridiagonal(scaled)
    rank = above(form, len(v) * 2.0**-50)
    keep = min(components, rank)
    if not keep:
        return np.zeros(0), np.zeros((len(v), 0))
    low = _edge(form, keep, 1.01)[0]
    wanted = keep
    while wanted < len(v):  # down to a gap that the contour can pass through
        following = _edge(form, wanted + 1, 1.01)[1]
        if low - following > 1e-9:
            break
        wanted, low = wanted + 1, min(low, _edge(form, wanted + 1, 1.01)[0])
    bottom = (low + _edge(form, wanted + 1, 1.01)[1]) / 2 if wanted < len(v) else low - 1e-3
    values, vectors = feast(scaled, bottom, 1.01, wanted)
    return values[:keep] * trace, vectors[:, :keep]


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exactly."""
    top = float(np.abs(x.astype(np.float64)).max(initial=0)) * n + max((abs(float(s)) for s in sums), default=0.0)
    return n * x - sums.astype(np.int64) if top < 2.0**62 else n * _whole(x) - sums


def _deviation(z: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exactly; null where it passes 64 bits."""
    top = float(np.abs(z.astype(np.float64)).max(initial=0))
    if top * top * max(1, z.shape[1]) < 2.0**62:
        return (z * z).sum(1).tolist()
    w = _whole(z)
    return [int(t) if t <= LONG else None for t in (w * w).sum(1)] if z.shape[1] else [0] * len(z)


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of each row and component.

    vectors has vec_id and embedding; other columns are not looked at. The covariance is that of the distinct
    vectors, each once; repeated rows and null ids have rows of their own. Rows with a null vector or null or
    non-finite components are dropped; a shorter vector ends in zeros. There are fewer components where the
    covariance has fewer eigenvalues above 0, and no rows where it has none or the table is empty. deviation is
    null where it passes 64 bits. The matrix (dimensions squared) is all that the driver holds.
    """
    rows = quantized(vectors, scale)
    kind = rows.schema["vec_id"].dataType.simpleString()
    fit = cut(rows.select("x").distinct(), "whiten-fit")
    n, sums, v = moments(fit)
    values, units = leading(v, components)
    k, width = len(values), len(v)
    if not k:
        free(fit)
        return vectors.sparkSession.createDataFrame([], ROWS.format(kind=kind))
    scaled = units / np.sqrt(values)
    explained = values / np.trace(v)

    def projected(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        z = _centred(_matrix(column, width), n, sums)
        from_mean = (z / n).astype(np.float64)
        out = np.zeros((len(z), k))
        for j in range(width):  # one order of sums for all blocks, so that equal vectors get equal values
            out += from_mean[:, j : j + 1] * scaled[j]
        return z, out

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = projected(batch.column(0))[1]
            total, squares = total + w.sum(0), squares + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k), pa.int64()), pa.array(np.append(squares.ravel(), total))], names=["at", "v"])

    found = dict(fit.mapInArrow(spread, "at bigint, v double").groupBy("at").agg(F.sum("v")).collect())  # k * k + k rows
    mean = np.array([found[k * k + i] for i in range(k)]) / n
    spreads = np.array([found[i] for i in range(k * k)]).reshape(k, k) / n - np.outer(mean, mean)
    error = float(np.abs(spreads - np.eye(k)).max())
    free(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, w = projected(batch.column(1))
            m = batch.num_rows
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            each = [
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)),
                pa.array(_deviation(z), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(w.ravel()),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays([ids, *each], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, ROWS.format(kind=kind))
