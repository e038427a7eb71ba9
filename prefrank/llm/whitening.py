"""Whitening of embeddings with eigenpairs found by contour integration.

Vectors become whole numbers; each distinct one counts once. Their covariance, a d x d matrix, is summed by
Spark in two passes (sums first, then products of centred vectors). Its largest eigenvalues lie in an
interval that counts of inertia find by bisection. A contour around the interval filters a block of random
vectors: the quadrature of complex shifted solves projects them onto the eigenvectors inside, Rayleigh-Ritz
extracts these, and the steps repeat until the residuals are those of double precision. At the end the
inertia at both ends of the interval tells how many eigenvalues lie inside, so none is missed.

Only sums of d and d x d numbers reach the driver. Rows are whitened where they lie, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prefrank.llm.common import pieces, written

#: Most dimensions: matrices of d x d doubles are held by the driver.
MOST_DIMENSIONS = 4096
LONG = 1 << 63


def negative_pivots(a: np.ndarray) -> int:
    """Negative eigenvalues of a symmetric matrix: those of the blocks of its LDL' factorisation.

    Pivots of one or two rows are chosen over the whole rest, so entries cannot grow without bound.
    """
    a, negative = np.array(a, "f8"), 0
    bound = (1 + np.sqrt(17)) / 8
    while (n := len(a)):
        diagonal = np.abs(np.diag(a))
        k = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        r, s = divmod(int(off.argmax()), n)
        if diagonal[k] >= bound * off[r, s]:
            if diagonal[k] == 0:
                return negative
            rest = np.delete(np.arange(n), k)
            negative += a[k, k] < 0
            a = a[np.ix_(rest, rest)] - np.outer(a[rest, k], a[rest, k]) / a[k, k]
        else:
            pair, rest = [r, s], np.delete(np.arange(n), [r, s])
            block = a[np.ix_(pair, pair)]
            negative += int((np.linalg.eigvalsh(block) < 0).sum())
            a = a[np.ix_(rest, rest)] - a[np.ix_(rest, pair)] @ np.linalg.solve(block, a[np.ix_(pair, rest)])
        a = (a + a.T) / 2
    return int(negative)


def above(v: np.ndarray, shift: float) -> int:
    """Eigenvalues of `v` above `shift`."""
    return negative_pivots(shift * np.eye(len(v)) - v)


def interval(v: np.ndarray, wanted: int) -> tuple[float, float, int]:
    """An interval that holds the `wanted` largest eigenvalues and, if some lie close together, the rest of their cluster.

    Bisection by inertia first finds a lower end with at least `wanted` above it, then moves that end into the
    widest gap below the last wanted eigenvalue that some steps of bisection find, so that the filter is sharp.
    """
    top = float(np.abs(v).sum(1).max()) * (1 + 1e-9)
    low, high = -top, top  # all eigenvalues above low; fewer than wanted above high
    for _ in range(60):
        middle = (low + high) / 2
        if above(v, middle) >= wanted:
            low = middle
        else:
            high = middle
        if high - low <= 1e-13 * top:
            break
    # the wanted-th eigenvalue is within [low, high]; look for the first clear gap below it
    width = 1e-6 * top
    while width < top:
        inside, outside = above(v, low - width), above(v, low - 3 * width)
        if inside == outside or inside >= len(v):
            while 6 * width < top and above(v, low - 6 * width) == inside:
                width *= 2
            return low - 2 * width, top, inside
        width *= 2
    return -top, top, len(v)


def feast(v: np.ndarray, wanted: int, points: int = 16, most_steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    d = len(v)
    scale = float(np.abs(v).max())
    if scale == 0 or d == 0:
        return np.zeros(wanted), np.eye(d)[:, :wanted]
    v = v / scale
    low, high, inside = interval(v, wanted)
    size = min(d, 2 * inside + 4)
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(points)
    angles = np.pi * (nodes + 1) / 2  # the upper half of the circle; the lower one gives the conjugate
    block = np.random.default_rng(1).normal(size=(d, size))
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for _ in range(most_steps):
        filtered = np.zeros((d, size))
        for angle, weight in zip(angles, weights):
            turn = np.exp(1j * angle)
            filtered += weight / 2 * np.real(radius * turn * np.linalg.solve((centre + radius * turn) * np.eye(d) - v, block))
        basis, _ = np.linalg.qr(filtered)
        values, mix = np.linalg.eigh(basis.T @ v @ basis)
        order = np.argsort(-values)
        values, vectors = values[order], basis @ mix[:, order]
        residual = float(np.abs(v @ vectors[:, :wanted] - vectors[:, :wanted] * values[:wanted]).max())
        if best is None or residual < best[0]:
            best = (residual, values, vectors)
        elif best[0] < 1e-12:
            break
        block = vectors
    residual, values, vectors = best
    # inertia at the ends of the interval: all of its eigenvalues have been found, none lies above it
    found = int(((values > low) & (values < high)).sum())
    if residual > 1e-9 or found < inside or above(v, high) or above(v, low) != inside:
        raise ArithmeticError(f"contour integration found {found} of {inside} eigenvalues, residual {residual}")
    return values[:wanted] * scale, vectors[:, :wanted]


def quantised(batches: Iterator[pa.RecordBatch], bins: int) -> Iterator[pa.RecordBatch]:
    """vec_id and x = floor(bins * c) of vectors without null and non-finite entries; the end of the long range where beyond."""
    for b in pieces(batches, 4096):
        lists = b.column("vector")
        flat = lists.flatten()
        fine = np.isfinite(flat.fill_null(np.nan).to_numpy(zero_copy_only=False))
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        bad = np.concatenate([[0], np.cumsum(~fine)])
        keep = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]]) & (np.diff(offsets) > 0)
        with np.errstate(invalid="ignore", over="ignore"):
            x = np.floor(bins * flat.fill_null(0).to_numpy(zero_copy_only=False))
            x = np.where(x >= LONG, LONG - 1, np.where(x <= -LONG, -LONG, np.where((np.abs(x) < LONG) & fine, x, 0).astype("i8")))
        out = pa.ListArray.from_arrays(pa.array(offsets.astype("i4")), pa.array(x.astype("i8")))
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), out], names=["vec_id", "x"]).filter(pa.array(keep))


def matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n and the sums of each dimension of a task, as decimals."""
    n, total = 0, None
    for b in batches:
        if b.num_rows:
            x = matrix(b.column("x"))
            safe = int(np.abs(x.astype("f8")).max()) < (1 << 62) // len(x)
            part = x.sum(0).astype(object) if safe else x.astype(object).sum(0)
            n, total = n + len(x), part if total is None else total + part
    if n:
        at = pa.array(np.arange(len(total), dtype="i4"))
        yield pa.RecordBatch.from_arrays([at, pa.array([n] * len(total), pa.int64()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], names=["i", "n", "s"])


def partial_products(batches: Iterator[pa.RecordBatch], centre: np.ndarray, axes: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows of the sum of outer products of a task's vectors, less `centre` and, if given, projected on `axes`."""
    total = None
    for b in batches:
        if b.num_rows:
            y = matrix(b.column("x")).astype("f8") - centre
            y = y if axes is None else y @ axes
            total = y.T @ y if total is None else total + y.T @ y
    if total is not None:
        d = len(total)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, d * d + 1, d, dtype="i4")), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype="i4")), lists], names=["i", "v"])


def summed_products(fit: DataFrame, centre: np.ndarray, axes: np.ndarray | None = None) -> np.ndarray:
    """Sum over the fit list of the outer products; rows of the matrix are added up by Spark, in sorted order of the parts."""
    import pandas as pd

    def added(group: pd.DataFrame) -> pd.DataFrame:
        parts = np.sort(np.stack(group["v"].to_list()), axis=0)
        return pd.DataFrame({"i": group["i"].iloc[:1].to_numpy(), "v": [parts.sum(0)]})

    rows = fit.mapInArrow(lambda b: partial_products(b, centre, axes), "i int, v array<double>").groupBy("i").applyInPandas(added, "i int, v array<double>").collect()
    return np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])])


@dataclass
class Whitener:
    """n, sums and eigenpairs of the fit list; identity_error is measured on it. Without vectors all is empty."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    bins: int
    identity_error: float = 0.0

    @property
    def centre(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums], "f8")

    @property
    def scaled(self) -> np.ndarray:
        return self.axes / np.sqrt(self.values)


def vectors_of(rows: DataFrame, id_column: str, vector: str, bins: int) -> DataFrame:
    chosen = rows.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    return chosen.mapInArrow(lambda b: quantised(b, bins), "vec_id long, x array<long>")


def train(rows: DataFrame, components: int = 4, bins: int = 256, id_column: str = "vec_id", vector: str = "embedding") -> Whitener:
    """Fit on the distinct quantised vectors of the whole table, in three passes over them.

    Vectors that are null, empty or hold null or non-finite entries are left out, as are those of another
    length than the most frequent one (the longest of equally frequent ones). Components of zero variance are
    not made, so there may be fewer than `components`.
    """
    fit = written(vectors_of(rows, id_column, vector, bins).select("x").distinct())
    lengths = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return Whitener(0, [], np.zeros(0), np.zeros((0, 0)), 0.0, bins)
    d = lengths["d"]
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions; at most {MOST_DIMENSIONS}")
    fit = fit.where(F.size("x") == d)
    sums = fit.mapInArrow(partial_sums, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    model = Whitener(sums[0]["n"], [int(r["s"]) for r in sums], np.zeros(0), np.zeros((d, 0)), 0.0, bins)
    covariance = summed_products(fit, model.centre) / model.n
    covariance = (covariance + covariance.T) / 2
    model.trace = float(np.trace(covariance))
    values, axes = feast(covariance, min(components, d))
    positive = values > 1e-12 * max(model.trace, 0.0)
    model.values, model.axes = values[positive], axes[:, positive]
    if len(model.values):
        model.identity_error = float(np.abs(summed_products(fit, model.centre, model.scaled) / model.n - np.eye(len(model.values))).max())
    return model


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[Decimal | None]:
    """Sum over the dimensions of (n * x - S) ** 2, exact; null beyond 38 digits."""
    most = n * int(np.abs(x.astype("f8")).max()) + max(abs(s) for s in sums)
    if most * most * len(sums) < 1 << 62:
        return [Decimal(int(v)) for v in ((n * x - np.array(sums, "i8")) ** 2).sum(1)]
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(1)
    return [Decimal(int(v)) if v < 10**38 else None for v in exact]


def whiten(rows: DataFrame, model: Whitener, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error, a row for each vector and component.

    Every row whose vector took part in the fit, or could have, is returned; repeated rows and null ids too.
    Other columns of `rows` are left out. deviation is a decimal of 38 digits, null where it needs more.
    """
    centre, axes, d = (model.centre, model.scaled, len(model.sums)) if model.n else (np.zeros(0), np.zeros((0, 0)), 0)
    n, sums, k = model.n, model.sums, axes.shape[1]
    explained = model.values / model.trace if model.trace > 0 else np.zeros(k)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x").cast(pa.list_(pa.int64()))) if b.num_rows else np.zeros((0, d), "i8")
            if not len(x) or not k:
                continue
            y = (x.astype("f8") - centre) @ axes
            ids = b.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k)))
            gone = pa.array([v for v in deviations(x, n, sums) for _ in range(k)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), len(x))), pa.array(np.full(len(x) * k, n)), gone, pa.array(y.ravel()),
                pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, model.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    chosen = vectors_of(rows, id_column, vector, model.bins).where(F.size("x") == d)
    return chosen.mapInArrow(projected, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
