"""Principal components, nearest neighbours, coverage and novelty over vectors (vec_id, embedding)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.arrays import ARRAYS, array_rows, summed
from pairloom.operators.hamming import best_agreement

#: Vectors in a block.
BLOCK = 4096
#: Sites of sequences that are compared by sets of sites: 2 to that power sets at most.
SHORT = 10


def _vectors(col: pa.Array) -> np.ndarray:
    """A row for each list of an array column without nulls."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def _rotated(df: DataFrame, mean: np.ndarray, axes: np.ndarray, name: str) -> DataFrame:
    """Blocks (name_id, name_x) of about BLOCK vectors along the axes (columns), whose distances are those of the vectors."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = (_vectors(b.column("embedding")) - mean) @ axes
                off = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.ListArray.from_arrays(off, pa.array(x.ravel()))], ["vec_id", "x"])

    rows = df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(go, "vec_id long, x array<double>")
    parts = max(1, -(-df.count() // BLOCK))
    return rows.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("b")).agg(F.collect_list("vec_id").alias(f"{name}_id"), F.flatten(F.collect_list("x")).alias(f"{name}_x")).drop("b")


def _search(query: DataFrame, reference: DataFrame, exclude_self: bool) -> DataFrame:
    """(vec_id, distance, measured, pairs) of each query and block of reference vectors: the least distance, and how many were measured in full."""
    n, mean, _, axes = covariance(reference)
    if not n:
        return query.sparkSession.createDataFrame([], "vec_id long, distance double, measured long, pairs long")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                qi, q, ri, r = (batch.column(c)[k].values.to_numpy() for c in ("q_id", "q_x", "r_id", "r_x"))
                q, r = q.reshape(len(qi), -1), r.reshape(len(ri), -1)
                a, b = np.sqrt((q * q).sum(1)), np.sqrt((r * r).sum(1))
                large = not max(a.max(), b.max()) < 1e15  # squares must fit single precision
                kind = np.float64 if large else np.float32
                low = (-2 * q).astype(kind) @ r.T.astype(kind)
                low += (a * a).astype(kind)[:, None]
                low += (b * b).astype(kind)
                if exclude_self and len(np.intersect1d(qi, ri)):
                    low[qi[:, None] == ri[None, :]] = np.inf
                # a square is off by less than this: rounded inputs, a dot product of their width, two sums
                off = (q.shape[1] + 8) * 2 * np.finfo(kind).eps * (a + b.max()) ** 2 + np.finfo(kind).tiny
                least = low.min(axis=1)
                i, j = np.nonzero(low <= (least + 2 * off).astype(kind)[:, None] * kind(1 + 1e-6))
                some = np.isfinite(low[i, j])
                i, j = i[some], j[some]
                best = np.full(len(q), np.inf)
                for x in range(0, len(i), BLOCK * 16):
                    p, o = i[x : x + BLOCK * 16], j[x : x + BLOCK * 16]
                    np.minimum.at(best, p, ((q[p] - r[o]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(qi), pa.array(np.sqrt(best)), pa.array(np.bincount(i, minlength=len(q))), pa.array(np.full(len(q), len(r)))], ["vec_id", "distance", "measured", "pairs"])

    pairs = _rotated(query, mean, axes, "q").crossJoin(_rotated(reference, mean, axes, "r"))  # blocks with blocks
    return pairs.mapInArrow(go, "vec_id long, distance double, measured long, pairs long")


def nearest(query: DataFrame, reference: DataFrame, exclude_self: bool = True) -> DataFrame:
    """(vec_id, distance): Euclidean distance to the nearest reference vector, exact.

    Vectors are centred and turned once. A block of queries meets each block of reference vectors once: a product in single precision gives
    all squares to within a bound that is known, and pairs that the bound cannot tell from the least are measured in double precision; others
    there are not measured. Without another reference vector, a query is left out.
    """
    return _search(query, reference, exclude_self).groupBy("vec_id").agg(F.min("distance").alias("distance")).filter("distance < double('infinity')")


def measured_share(query: DataFrame, reference: DataFrame, exclude_self: bool = True) -> float:
    """The share of all pairs that nearest() measures in full."""
    return _search(query, reference, exclude_self).agg(F.sum("measured") / F.sum("pairs")).first()[0]


def coverage(real: DataFrame, generated: DataFrame, factor: float = 3.0) -> DataFrame:
    """(spacing, covered): median distance between real neighbours, and the share of reals with a generated one near."""
    spacing = nearest(real, real).agg(F.percentile("distance", 0.5).alias("spacing"))
    near = nearest(real, generated, exclude_self=False)
    return near.crossJoin(F.broadcast(spacing)).groupBy("spacing").agg(F.avg((F.col("distance") <= factor * F.col("spacing")).cast("double")).alias("covered"))


def covariance(df: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """n, mean, and eigenvalues (falling) and eigenvectors (columns) of the sample covariance of the vectors.

    Sums and products are added up by partition, then by row of the matrix on the executors; the driver sees one matrix.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, gram = 0, 0.0, 0.0
        for b in batches:
            if b.num_rows:
                x = _vectors(b.column("embedding"))
                n, total, gram = n + len(x), total + x.sum(0), gram + x.T @ x
        if n:
            yield array_rows([-1, *range(len(total))], [np.append(total, n), *gram])

    found = summed(df.select(F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(go, ARRAYS))
    if not found:
        return 0, np.zeros(0), np.zeros(0), np.zeros((0, 0))
    total, n = found[-1][:-1], int(found[-1][-1])
    mean = total / n
    gram = np.stack([found[i] for i in range(len(mean))])
    values, vectors = np.linalg.eigh((gram - n * np.outer(mean, mean)) / max(1, n - 1))
    return n, mean, values[::-1], vectors[:, ::-1]


def _components(spark, values: np.ndarray, whole: float, vectors: np.ndarray, mean: np.ndarray) -> DataFrame:
    rows = []
    for c, v in enumerate(vectors.T, 1):
        v = v * np.sign(v[np.abs(v).argmax()])
        rows.append((c, float(values[c - 1] / whole), v.tolist(), mean.tolist()))
    return spark.createDataFrame(rows, "component int, explained double, loadings array<double>, mean array<double>")


def principal_components(df: DataFrame, k: int) -> DataFrame:
    """(component, explained, loadings, mean): eigenvectors of the sample covariance; the largest loading is positive."""
    _, mean, values, vectors = covariance(df)
    return _components(df.sparkSession, values, values.sum(), vectors[:, :k], mean)


def wide_components(df: DataFrame, k: int, seed: int = 1, more: int = 8, power: int = 4) -> DataFrame:
    """principal_components() of vectors so wide that a matrix of width squared is too large: a randomised range finder.

    What is held anywhere is width times k + more numbers. Each pass multiplies the centred rows with a thin matrix; the product is made orthogonal
    by a tree of small factorisations (a triangle for each partition, then one of those), and multiplied back. After `power` passes the
    components are those of a small matrix. Explained shares are of the variance of all columns.
    """
    spark, thin = df.sparkSession, k + more
    rows = df.select(F.col("embedding").cast("array<double>").alias("embedding"))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, 0.0, 0.0
        for b in batches:
            if b.num_rows:
                x = _vectors(b.column("embedding"))
                n, total, square = n + len(x), total + x.sum(0), square + (x * x).sum(0)
        if n:
            yield array_rows([0], [np.concatenate(([n], total, square))])

    found = summed(rows.mapInArrow(moments, ARRAYS))
    if not found:
        return _components(spark, np.zeros(0), 1.0, np.zeros((0, 0)), np.zeros(0))
    n, width = int(found[0][0]), (len(found[0]) - 1) // 2
    mean = found[0][1 : width + 1] / n
    whole = float((found[0][width + 1 :] - n * mean * mean).sum())
    thin = min(thin, width, n)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, thin)))[0]

    def passed(basis: np.ndarray):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            back, triangle = 0.0, np.zeros((0, thin))
            for b in batches:
                if b.num_rows:
                    x = _vectors(b.column("embedding")) - mean
                    y = x @ basis
                    back, triangle = back + x.T @ y, np.linalg.qr(np.vstack((triangle, y)), mode="r")
            if len(triangle):
                full = np.zeros((thin, thin))
                full[: len(triangle)] = triangle
                yield array_rows(list(range(thin)), list(back.T))
                yield array_rows([-1 - TaskContext.get().partitionId()], [full.ravel()])

        return go

    for _ in range(power):
        parts = summed(rows.mapInArrow(passed(basis), ARRAYS))
        triangle = np.linalg.qr(np.vstack([x.reshape(thin, thin) for site, x in parts.items() if site < 0]), mode="r")
        back = np.stack([parts[i] for i in range(thin)], axis=1)  # rows times their image, width by thin
        # rows transposed times an orthogonal basis of the image; a direction without variance adds nothing
        sound = np.abs(np.diag(triangle)) > 1e-12 * np.abs(triangle).max(initial=1e-300)
        back = np.linalg.lstsq(triangle[sound][:, sound].T, back[:, sound].T, rcond=None)[0].T if sound.any() else back[:, :0]
        basis, values, _ = np.linalg.svd(back, full_matrices=False)
        thin = basis.shape[1]
        if not thin:
            break
    return _components(spark, values[:k] ** 2, whole or 1.0, basis[:, :k], mean)


def project(df: DataFrame, basis: DataFrame) -> DataFrame:
    """(vec_id, component, value), centred."""
    b = F.broadcast(basis)  # k rows
    dot = F.aggregate(F.zip_with(F.zip_with("embedding", "mean", lambda x, m: x - m), "loadings", lambda x, v: x * v), F.lit(0.0), lambda s, x: s + x)
    return df.crossJoin(b).select("vec_id", "component", dot.alias("value"))


def best_identity(query: DataFrame, reference: DataFrame, order: str) -> DataFrame:
    """(row_id, identity): the share of sites at which rows (row_id, seq) agree with the most similar reference row.

    Equal sequences are compared once. Short ones meet without sets of sites (best_agreement); of wider ones, agreements of one-hot vectors are half of what their squared distance lacks.
    """
    wide = query.select("seq").unionByName(reference.select("seq")).agg(F.min(F.length("seq")).alias("lo"), F.max(F.length("seq")).alias("hi")).first()
    if wide.lo is not None and wide.lo == wide.hi and 0 < wide.lo <= SHORT:
        d = best_agreement(query.select("seq").distinct(), reference.select("seq").distinct(), wide.lo)
        met = d.select("seq", (1 - F.col("d") / wide.lo).alias("identity"))
        return query.select("row_id", "seq").join(met, "seq").select("row_id", "identity")
    symbols = F.array(*[F.lit(c) for c in order])
    hot = lambda df: df.select("seq").distinct().select(F.xxhash64("seq").alias("vec_id"), "seq", F.flatten(F.transform(F.split("seq", ""), lambda s: F.transform(symbols, lambda a: (a == s).cast("float")))).alias("embedding"))
    q = hot(query)
    near = nearest(q.select("vec_id", "embedding"), hot(reference).select("vec_id", "embedding"), exclude_self=False)
    found = q.select("vec_id", "seq").join(near, "vec_id").select("seq", (1 - F.round(F.col("distance") * F.col("distance") / 2) / F.length("seq")).alias("identity"))
    return query.select("row_id", "seq").join(found, "seq").select("row_id", "identity")


def novelty(query: DataFrame, reference: DataFrame, order: str, least: float = 0.95) -> DataFrame:
    """(near_copies, mean_identity): the share of rows almost equal to a reference row, and the mean best identity."""
    best = best_identity(query, reference, order)
    return best.agg(F.avg((F.col("identity") >= least).cast("double")).alias("near_copies"), F.avg("identity").alias("mean_identity"))


def spread(values: DataFrame) -> DataFrame:
    """(component, real_std, made_std, ratio, real_low, real_high, made_low, made_high) of values(component, value, made)."""
    side = lambda m: F.when(F.col("made") == m, F.col("value"))
    g = values.groupBy("component").agg(
        F.stddev_samp(side(False)).alias("real_std"), F.stddev_samp(side(True)).alias("made_std"),
        F.min(side(False)).alias("real_low"), F.max(side(False)).alias("real_high"), F.min(side(True)).alias("made_low"), F.max(side(True)).alias("made_high"),
    )
    return g.withColumn("ratio", F.try_divide("made_std", "real_std"))
