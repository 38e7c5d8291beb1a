"""What the operators on vectors share: rows that count, integer components, and exact sums of any size."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sums travel as digits of this many bits, the highest one signed, so that Spark adds them as plain longs.
DIGIT = 32
SUMS = "i int, j int, digit int, value long"
_SUMS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("digit", pa.int32()), ("value", pa.int64())])


def whole(vectors: DataFrame, *fields: str) -> DataFrame:
    """The fields and the embedding of rows whose vector is not null and holds neither null nor non-finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(*fields, F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & finite)


def dimensions(vectors: DataFrame) -> int:
    """The length that all vectors share; 0 without rows."""
    low, high = vectors.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if low != high:
        raise ValueError(f"vectors have {low} to {high} components; all must have one length")
    return low or 0


def integers(column: pa.Array, dims: int, scale: int, most: float) -> np.ndarray:
    """floor(scale * component) as a row of longs for each vector; one of `most` or more in size is an error."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)
    out = np.floor(scale * flat)
    if out.size and max(-out.min(), out.max()) >= most:
        raise ValueError(f"a component of {max(-out.min(), out.max()):g} is too large for exact sums of 64 bits; the limit is {most:g}")
    return out.astype(np.int64)


def digits(sums: Iterable[tuple[int, int, int]]) -> pa.RecordBatch:
    """Rows of SUMS for integers of any size (i, j, integer)."""
    rows: list[tuple[int, int, int, int]] = []
    for i, j, x in sums:
        at = 0
        while not -(1 << DIGIT - 1) <= x < 1 << DIGIT - 1:
            rows.append((i, j, at, x & (1 << DIGIT) - 1))
            x, at = x >> DIGIT, at + 1
        rows.append((i, j, at, x))
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [()] * 4, _SUMS)], schema=_SUMS)


def summed(rows: DataFrame) -> dict[tuple[int, int], int]:
    """The exact sum for each (i, j) of rows of SUMS: a few for each of these, however many rows there are."""
    out: dict[tuple[int, int], int] = {}
    for i, j, digit, value in zip(*(c.to_pylist() for c in rows.groupBy("i", "j", "digit").agg(F.sum("value").alias("value")).toArrow().columns)):
        out[i, j] = out.get((i, j), 0) + (value << DIGIT * digit)
    return out
