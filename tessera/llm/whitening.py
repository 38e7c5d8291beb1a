"""Whitening of embeddings with an exact covariance, by matrix products over digit slices.

A component c counts as the integer floor(64 * c) + 1000000, so the large common offset must not cost precision. Rows
are centred at the floor of the mean first. The centred integers are split into slices of a few bits, low ones first
and the highest one signed; a block of rows is so short that a float64 product of two slices adds up to less than 2**53
and is exact whatever order BLAS adds in. Products of slices are put together as big integers, tasks send their digits,
Spark adds these, and the remainder of the mean is taken off exactly. Only then is the covariance rounded, once, and
decomposed: a matrix of dimensions squared, which does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import bounded_batches, drop, read, written
from tessera.llm.vectors import SUMS, digits, dimensions, integers, summed, whole

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Bits of a slice, and rows of a block: 2 * SLICE + log2(ROWS) = 53.
SLICE, ROWS = 20, 1 << 13
#: Components are below this in size, so that their differences are longs.
MOST = 2.0**61


def slices(y: np.ndarray) -> list[np.ndarray]:
    """y (longs) as float64 matrices with y = sum(slice k * 2 ** (SLICE * k)); slices lie between -2 ** SLICE and 2 ** SLICE."""
    out = []
    while y.size and not (-(1 << SLICE) <= int(y.min()) and int(y.max()) < 1 << SLICE):
        out.append((y & ((1 << SLICE) - 1)).astype(np.float64))
        y = y >> SLICE
    return [*out, y.astype(np.float64)]


def exact_gram(y: np.ndarray) -> np.ndarray:
    """y.T @ y (objects, integers of any size) of a matrix of longs."""
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), ROWS):
        parts = slices(y[at : at + ROWS])
        for a, left in enumerate(parts):
            for b, right in enumerate(parts[: a + 1]):
                product = (left.T @ right).astype(np.int64).astype(object) << SLICE * (a + b)
                out += product if a == b else product + product.T
    return out


def principal(cov: np.ndarray, sweeps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(variances, components as columns) by falling variance, by Jacobi rotations of disjoint pairs at a time.

    A pair is rotated until its covariance is small beside its own two variances, not beside the largest one, so a small
    variance keeps its digits where another dimension has a far larger scale.
    """
    d = len(cov)
    a, axes = cov.astype(np.float64), np.eye(d)
    m = d + d % 2
    ring = np.arange(m)
    tiny = np.finfo(np.float64).eps
    for _ in range(sweeps):
        turned = False
        for _ in range(m - 1):
            p, q = np.minimum(ring[: m // 2], ring[: m // 2 - 1 : -1]), np.maximum(ring[: m // 2], ring[: m // 2 - 1 : -1])
            ring[1:] = np.roll(ring[1:], 1)
            p, q = p[q < d], q[q < d]
            x, y, z = a[p, p], a[q, q], a[p, q]
            on = np.abs(z) > tiny * np.sqrt(np.abs(x * y))
            if not on.any():
                continue
            turned = True
            p, q, x, y, z = p[on], q[on], x[on], y[on], z[on]
            half = (y - x) / (2 * z)
            t = np.where(half < 0, -1.0, 1.0) / (np.abs(half) + np.hypot(1, half))
            c = 1 / np.hypot(1, t)
            s = c * t
            for left in (a, a.T, axes):  # columns of a, rows of a, columns of the components
                u, v = left[:, p].copy(), left[:, q]
                left[:, p], left[:, q] = c * u - s * v, s * u + c * v
            a[p, p], a[q, q], a[p, q], a[q, p] = x - t * z, y + t * z, 0.0, 0.0
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], axes[:, order]


class Fit:
    """What whitening needs of the fit list: rows n, sums S, centre and rest with S = n * centre + rest, components
    (a column each, by falling variance), their variances, and the share of all variance."""

    def __init__(self, n: int, sums: list[int], gram: np.ndarray, most: int = COMPONENTS) -> None:
        self.n, self.sums = n, sums
        self.centre = [s // n for s in sums]
        self.rest = [s % n for s in sums]
        square = n * n
        cov = np.array([[(n * int(g) - a * b) / square for g, b in zip(row, self.rest)] for row, a in zip(gram, self.rest)], np.float64)
        values, columns = principal(cov)
        trace = float(np.trace(cov))
        self.variances, self.axes = values[:most], columns[:, :most]
        # Rounding is in proportion to the variances of the dimensions that a component is made of.
        self.spread = self.variances > 8 * len(sums) * np.finfo(np.float64).eps * (np.diag(cov) @ self.axes**2)
        self.shares = np.where(self.spread, self.variances / trace if trace else 0.0, 0.0)
        self.scales = np.where(self.spread, 1 / np.sqrt(np.where(self.spread, self.variances, 1.0)), 0.0)

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """Rows of y (x - centre, longs) projected on the components, in units of their standard deviations."""
        return (y.astype(np.float64) - np.array([r / self.n for r in self.rest])) @ self.axes * self.scales

    def deviations(self, y: np.ndarray) -> list[int]:
        """sum over dimensions of (n * x - S) ** 2 of each row of y, exact."""
        top = max(int(y.max()), -int(y.min()), 1) if y.size else 1
        if ((top + 1) * self.n) ** 2 * max(len(self.rest), 1) < 1 << 63:
            z = y * self.n - np.array(self.rest, np.int64)
            return (z * z).sum(1).tolist()
        z = y.astype(object) * self.n - np.array(self.rest, object)
        return (z * z).sum(1).tolist()


def _centred(column: pa.Array, centre: list[int]) -> np.ndarray:
    return integers(column, len(centre), SCALE, MOST) - np.array(centre, np.int64)


def _exact_sums(dims: int):
    """A pass that adds up components; i is the dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            low, high = x & ((1 << 31) - 1), x >> 31  # a batch has far fewer than 2**31 rows
            total = [t + int(a) + (int(b) << 31) for t, a, b in zip(total, low.sum(0), high.sum(0))]
        yield digits((i, 0, t) for i, t in enumerate(total))

    return run


def _blocks(batches: Iterator[pa.RecordBatch], centre: list[int]) -> Iterator[np.ndarray]:
    """Centred rows of the fit list in blocks of ROWS."""
    held: list[np.ndarray] = []
    dims = len(centre)
    for batch in batches:
        held.append(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) - np.array(centre, np.int64))
        if sum(map(len, held)) >= ROWS:
            yield np.concatenate(held)
            held.clear()
    if held:
        yield np.concatenate(held)


def _exact_products(centre: list[int]):
    """A pass that adds up products of centred components; i <= j are the dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centre), len(centre)), object)
        for y in _blocks(batches, centre):
            total += exact_gram(y)
        yield digits((i, j, int(total[i, j])) for i in range(len(centre)) for j in range(i, len(centre)))

    return run


def _measured(fit: Fit):
    """A pass that adds up products of whitened components, centred by construction; j is -1 for their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fit.scales)
        products, sums = np.zeros((k, k)), np.zeros(k)
        for y in _blocks(batches, fit.centre):
            w = fit.whitened(y)
            products += w.T @ w
            sums += w.sum(0)
        i, j = np.indices((k, k + 1)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(np.where(j < k, j, -1).astype(np.int32)), pa.array(np.c_[products, sums].ravel())], ["i", "j", "value"])

    return run


def fitted(kept: DataFrame, dims: int, most: int = COMPONENTS) -> tuple[Fit, float] | None:
    """The fit over each distinct row of kept (embedding) once, and how far the whitened covariance is from the identity."""

    def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column("embedding"), dims, SCALE, MOST)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dims), pa.array(x.ravel()))], ["x"])

    # Equal vectors are folded before the shuffle.
    rows = written(kept.select("embedding").mapInArrow(quantised, "x array<long>").groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit", True)
    n = rows.count()
    if not n:
        drop(rows)
        return None
    totals = summed(rows.mapInArrow(_exact_sums(dims), SUMS))
    sums = [totals[i, 0] for i in range(dims)]
    upper = summed(rows.mapInArrow(_exact_products([s // n for s in sums]), SUMS))
    gram = np.zeros((dims, dims), object)
    for (i, j), value in upper.items():
        gram[i, j] = gram[j, i] = value
    fit = Fit(n, sums, gram, most)
    k = len(fit.scales)
    found = np.zeros((k, k + 1))
    for i, j, value in rows.mapInArrow(_measured(fit), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value")).collect():
        found[i, j] = value
    mean = found[:, k] / n
    off = np.abs(found[:, :k] / n - np.outer(mean, mean) - np.eye(k))[np.ix_(fit.spread, fit.spread)]
    drop(rows)
    return fit, float(off.max()) if off.size else 0.0


def whitened(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each whole row of vectors (vec_id,
    embedding, ...) and each of the first `most` principal components, or all where there are fewer dimensions.

    Rows whose vector is null or holds null or non-finite components are left out. The fit takes each distinct vector of
    integers once; n is their number, deviation (decimal) the sum of (n * x - S) ** 2, explained a component's share of
    all variance. A component without variance beyond rounding, as where all vectors are equal, gives whitened 0 and
    explained 0 and does not count in identity_error, which is 0 if there is no other. Rows that repeat a vec_id or have
    none each get their rows. An empty table, or one without whole vectors, gives no rows. Vectors of unlike lengths and
    components of 2**61 or more are errors. Other columns are not read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    kept = whole(vectors, "vec_id")
    dims = dimensions(kept)
    found = fitted(kept, dims, most) if dims else None
    schema = f"vec_id {dict(kept.dtypes)['vec_id']}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if found is None:
        return spark.createDataFrame([], schema)
    fit, error = found
    k = len(fit.scales)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = part.num_rows
                y = _centred(part.column("embedding"), fit.centre)
                row = np.repeat(np.arange(rows), k)
                far = pa.array(fit.deviations(y), pa.decimal128(38, 0)).take(pa.array(row))
                fixed = [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, fit.n)), far]
                values = [pa.array(fit.whitened(y).ravel()), pa.array(np.tile(fit.shares, rows)), pa.array(np.full(rows * k, error))]
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(pa.array(row)), *fixed, *values], schema_names)

    schema_names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return kept.mapInArrow(project, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitened(read(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))
