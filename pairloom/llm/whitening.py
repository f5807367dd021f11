"""Embedding whitening from a compensated covariance (operator 11).

Entries are integers x = floor(64 * c) + 1000000, so their sums are exact. Rows are centred to a double and its
error (double-double). Products of centred columns are added without any rounding: a block of columns is cut
into slices of so few bits that a matrix product of two slices is exact in doubles (an error-free transformation of the
outer products of the block's rows), and each such product is added to a high part whose rounding error goes to a low part.
Tasks send high and low parts, and these are merged in double-double as well. The eigenvectors come from a
reduction to tridiagonal form and divide and conquer (LAPACK's syevd), and are then corrected once with residuals taken in double-double.

What a task, a merge and the driver hold grows with the square of the vectors' width, never with their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import arrow_batches

SCALE, SHIFT = 64, 1_000_000
#: Rows whose slices are multiplied together: 2 ** 10 products of 2 * 21 bits add up within 53 bits.
ROWS, BITS, SLICES = 1024, 22, 5
#: Entries beyond it count as it, so that x stays a long.
_LARGEST = float(1 << 62)
#: Variance, as a share of all, below which a direction counts as empty.
EMPTY = 1e-12

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b as rounded, and the rounding error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(a: Pair, b: Pair) -> Pair:
    """The sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def _slices(x: Pair) -> list[np.ndarray]:
    """Matrices that add up to x (to about 100 bits of each column's largest entry), each of few bits by column."""
    rest, low, out = x[0].copy(), x[1], []
    for k in range(SLICES):
        if k == 2:  # so much of the high part is gone that the low one fits beside the rest
            rest = rest + low
        top = np.abs(rest).max(axis=0, initial=0.0)
        sigma = np.where(top > 0, np.ldexp(1.5, np.frexp(top)[1] + 53 - BITS), 0.0)
        part = (rest + sigma) - sigma
        out.append(part)
        rest = rest - part
    return out


def product(x: Pair, y: Pair) -> Pair:
    """x transposed times y, as a double-double; rows go by in blocks of ROWS."""
    total = (np.zeros((x[0].shape[1], y[0].shape[1])), np.zeros((x[0].shape[1], y[0].shape[1])))
    for a in range(0, len(x[0]), ROWS):
        p = _slices((x[0][a : a + ROWS], x[1][a : a + ROWS]))
        q = p if y is x else _slices((y[0][a : a + ROWS], y[1][a : a + ROWS]))
        for k in range(SLICES):
            for i in range(k + 1):
                total = add(total, (p[i].T @ q[k - i], np.zeros_like(total[0])))
    return total


def eigen(v: Pair) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns, largest entry positive) of a symmetric matrix.

    After the solve in doubles, one step of Ogita and Aishima's refinement: how far the vectors are from orthogonal, and from
    making v diagonal, is measured in double-double and put right to first order.
    """
    values, x = np.linalg.eigh(v[0] + v[1])
    zero = np.zeros_like(x)
    xs = (x, zero)
    gram = product(xs, xs)
    r = (np.eye(len(x)) - gram[0]) - gram[1]
    s = product(xs, product(v, xs))
    s = s[0] + s[1]
    values = np.diag(s) / (1 - np.diag(r))
    gap = values[None, :] - values[:, None]
    off = s + values[None, :] * r
    near = np.abs(gap) <= 2 * (np.abs(s - np.diag(np.diag(s))).sum(axis=0).max(initial=0.0) + np.abs(values).max(initial=0.0) * np.abs(r).sum(axis=0).max(initial=0.0))
    x = x + x @ np.where(near, r / 2, off / np.where(near, 1.0, gap))
    order = np.argsort(-values, kind="stable")
    values, x = values[order], x[:, order]
    x = x / np.sqrt((x * x).sum(axis=0))
    return values, x * np.where(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])] < 0, -1.0, 1.0)


class Model(NamedTuple):
    """Whitening of the vectors of one width: n of them, exact sums by dimension, unit components (columns), their variances, variance of all."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float


def matrix(col: pa.Array) -> np.ndarray:
    """x of vectors of one width without nulls, one row each."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.clip(np.floor(SCALE * flat), -_LARGEST, _LARGEST).astype(np.int64) + SHIFT).reshape(len(col), -1)


def centred(x: np.ndarray, n: int, sums: list[int]) -> Pair:
    """x - sums / n as double-doubles."""
    mean = [(s / n, float(Fraction(s, n) - Fraction(s / n))) for s in sums]
    high = x.astype(np.float64)
    low = (x - high.astype(np.int64)).astype(np.float64)
    s, e = two_sum(high, -np.array([m[0] for m in mean]))
    return two_sum(s, e + (low - np.array([m[1] for m in mean])))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum of (n * x - sums) ** 2 of each row, exact; null where it is beyond a long."""
    most = n * max(float(np.abs(x).max(initial=0)), 1.0)
    if most < 2.0**61 and max(map(abs, sums), default=0) < 2**61:
        d = n * x - np.array(sums, np.int64)
        if float(np.abs(d).max(initial=0)) ** 2 * max(d.shape[1], 1) < 2.0**62:
            return pa.array((d * d).sum(axis=1))
    out = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
    return pa.array([v if v < 2**63 else None for v in out], pa.int64())


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, e array of double) of the rows whose vector is not null and holds finite entries only."""
    finite = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).filter(F.col("e").isNotNull()).filter(finite)


def _exact_sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number and exact sums by dimension of the vectors of each width: as many rows reach the driver as all widths together."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            sizes = np.diff(b.column("e").offsets.to_numpy())
            for w in np.unique(sizes[sizes > 0]):
                x = matrix(b.column("e").filter(pa.array(sizes == w)))
                high = x >> 32
                now = [len(x), high.sum(axis=0), (x - (high << 32)).sum(axis=0)]
                held[int(w)] = [p + q for p, q in zip(held[int(w)], now)] if int(w) in held else now
        for w, (n, high, low) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(w, v, np.int64)) for v in (w,)] + [pa.array(np.arange(w)), pa.array(np.full(w, n, np.int64)), pa.array(high), pa.array(low)], ["w", "d", "n", "high", "low"])

    parts = rows.select("e").mapInArrow(go, "w long, d long, n long, high long, low long")
    found: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("w", "d").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("w", "d").collect():
        found.setdefault(r.w, (r.n, []))[1].append((r.high << 32) + r.low)
    return found


def _products(rows: DataFrame, width: int, made) -> Pair:
    """Sum over all vectors of the outer product of made(x) with itself; only width rows of high and low parts reach the driver."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (np.zeros((width, width)), np.zeros((width, width)))
        for b in batches:
            if len(b.column("e")):
                c = made(matrix(b.column("e")))
                total = add(total, product(c, c))
        for i in range(width):
            yield _part(i, total[0][i], total[1][i])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Pair] = {}
        for b in batches:
            for k, i in enumerate(b.column("i").to_pylist()):
                now = tuple(b.column(c)[k].values.to_numpy() for c in ("high", "low"))
                held[i] = add(held[i], now) if i in held else now
        for i, (high, low) in held.items():
            yield _part(i, high, low)

    kind = "i long, high array<double>, low array<double>"
    found = rows.select("e").mapInArrow(go, kind).repartition("i").mapInArrow(merged, kind).toArrow().sort_by("i")
    return tuple(np.array([v.values.to_numpy() for c in found.column(n).chunks for v in c]) for n in ("high", "low"))


def _part(i: int, high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i]), pa.array([high], pa.list_(pa.float64())), pa.array([low], pa.list_(pa.float64()))], ["i", "high", "low"])


def fit(rows: DataFrame, width: int, n: int, sums: list[int], components: int) -> Model:
    """The model of the usable vectors of one width. Directions without variance are no components."""
    m = _products(rows, width, lambda x: centred(x, n, sums))
    high, low = m[0] / n, np.zeros_like(m[0])
    for i in range(width):  # the division, in double-double
        low[i] = [float(Fraction(h) + Fraction(e) - Fraction(q) * n) / n for h, e, q in zip(m[0][i], m[1][i], high[i])]
    values, x = eigen((high, low))
    trace = float(np.trace(high) + np.trace(low))
    k = min(components, int((values > EMPTY * trace).sum())) if trace > 0 else 0
    return Model(n, sums, x[:, :k], values[:k], trace)


def project(x: np.ndarray, model: Model) -> np.ndarray:
    return centred(x, model.n, model.sums)[0] @ model.components / np.sqrt(model.variances)


def identity_error(rows: DataFrame, model: Model) -> float:
    """Largest absolute entry of the covariance of all whitened vectors minus the identity, measured in a pass of its own."""
    k = len(model.variances)
    if not k:
        return 0.0

    def made(x: np.ndarray) -> Pair:
        z = np.column_stack((project(x, model), np.ones(len(x))))  # the last column adds up the others
        return z, np.zeros_like(z)

    m = _products(rows, k + 1, made)
    m = (m[0] + m[1]) / model.n
    return float(np.abs(m[:k, :k] - np.outer(m[:k, k], m[:k, k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = 32) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries are left out, of the fit too. Vectors of each width are
    whitened among themselves (a pass for each width); empty ones have no components. A direction without variance
    (below EMPTY of all, as for one vector alone, or equal ones) is no component, so it gives no rows. Repeated rows count
    and are returned as often as they occur; null ids are carried; other columns are ignored; no usable vectors give no rows.
    deviation is null where it is beyond a long; entries beyond 2 ** 56 count as 2 ** 56.
    """
    spark = vectors.sparkSession
    arrow_batches(spark)
    rows = usable(vectors)
    kind = T.StructType([T.StructField("vec_id", vectors.schema["vec_id"].dataType), *[T.StructField(n, t) for n, t in (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()))]])
    out = spark.createDataFrame([], kind)
    for width, (n, sums) in _exact_sums(rows).items():
        mine = rows.filter(F.size("e") == width)
        model = fit(mine, width, n, sums, components)
        out = out.unionByName(mine.mapInArrow(_whitener(model, identity_error(mine, model)), kind))
    return out


def _whitener(model: Model, error: float):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.variances)
        for b in batches:
            if not k or not len(b.column("e")):
                continue
            x = matrix(b.column("e"))
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([
                b.column("vec_id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), model.n, np.int64)),
                deviations(x, model.n, model.sums).take(pa.array(rows)), pa.array(project(x, model).ravel()),
                pa.array(np.tile(model.variances / model.trace, len(x))), pa.array(np.full(len(rows), error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return go
