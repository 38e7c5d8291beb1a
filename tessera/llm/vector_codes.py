"""Product codes of vectors: each of 16 parts is named by the nearest entry of a codebook learned for its place.

The nearest entry is found by annular norm pruning. A codebook's entries are sorted by norm. By the triangle inequality
an entry at distance d has a norm within d of the part's own, so binary search starts at the entry with the nearest
norm and gives the interval that its distance allows; only entries in this annulus, bounds included, are evaluated,
outwards from the start, and each better one narrows it. Distances are exact integers and ties go to the lower index,
so pruning never changes an answer: the interval's bounds are floats with room for rounding.

Each round is one pass over the vectors. A task adds up its parts for each entry and sends sums and counts only, so
what meets in the driver is a codebook's size, whatever the table holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.components import met
from tessera.llm.shared import bounded_batches, read, written
from tessera.llm.vectors import SUMS, digits, dimensions, integers, summed, whole

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Relative room for rounding in the bounds of an annulus.
ROOM = 1e-9


class Codebook:
    """Entries (k, width) of one place, sorted by norm for the search."""

    def __init__(self, entries: np.ndarray) -> None:
        squares = (entries * entries).sum(1)
        self.order = np.lexsort((np.arange(len(entries)), squares))
        self.sorted, self.norms = entries[self.order], np.sqrt(squares[self.order].astype(np.float64))

    def _closer(self, parts: np.ndarray, at: np.ndarray, place: np.ndarray, best: np.ndarray, name: np.ndarray) -> None:
        """Evaluate one entry for each of the parts `at`."""
        gap = parts[at] - self.sorted[place]
        d, i = (gap * gap).sum(1), self.order[place]
        won = (d < best[at]) | (d == best[at]) & (i < name[at])
        best[at[won]], name[at[won]] = d[won], i[won]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each row of parts (n, width)."""
        k, n = len(self.norms), len(parts)
        norm = np.sqrt((parts * parts).sum(1).astype(np.float64))
        right = np.searchsorted(self.norms, norm)
        left = np.maximum(right - 1, 0)
        right = np.minimum(right, k - 1)
        start = np.where(norm - self.norms[left] <= self.norms[right] - norm, left, right)
        best, name = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        every = np.arange(n)
        self._closer(parts, every, start, best, name)
        room = ROOM * (norm + self.norms[-1] + 1)
        reach = np.sqrt(best.astype(np.float64)) + room
        low, high = np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")
        for step, bound in ((-1, low), (1, high)):
            at, place = every, start + step
            while True:
                inside = place >= bound[at] if step < 0 else place < bound[at]
                at, place = at[inside], place[inside]
                near = np.abs(self.norms[place] - norm[at]) <= np.sqrt(best[at].astype(np.float64)) + room[at]
                at, place = at[near], place[near]
                if not len(at):
                    break
                self._closer(parts, at, place, best, name)
                place = place + step
        return name, best


def most_of(dims: int) -> float:
    """Components from which on the squared distances of a vector might not fit into 63 bits."""
    return float(int((2**61 / max(dims, 1)) ** 0.5))


def _assigned(column: pa.Array, dims: int, parts: int, scale: int, books: list[Codebook]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parts (n, places, width), indexes (n, places), squared distances (n, places))."""
    x = integers(column, dims, scale, most_of(dims)).reshape(len(column), parts, dims // parts)
    found = [book.nearest(x[:, p]) for p, book in enumerate(books)]
    return x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def learned(kept: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[list[list[int]]]:
    """Codebooks [place][entry][component] of kept (vec_id, embedding): the parts of the first vectors by vec_id, moved to
    the floor of the mean of what is nearest to them in each round."""
    rows = kept.select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).toArrow()
    first = integers(rows.column("embedding").combine_chunks(), dims, scale, most_of(dims)).reshape(rows.num_rows, parts, dims // parts)
    books = [first[:, p].tolist() for p in range(parts)]
    for _ in range(rounds if rows.num_rows else 0):
        sums = summed(kept.select("embedding").mapInArrow(_summing(dims, parts, scale, books), SUMS))
        for p, book in enumerate(books):
            for e, slot in enumerate(range(p * len(book), (p + 1) * len(book))):
                if count := sums.get((slot, -1)):
                    book[e] = [sums.get((slot, k), 0) // count for k in range(dims // parts)]
    return books


def _summing(dims: int, parts: int, scale: int, books: list):
    """A pass that adds up the parts of each entry: i is place * size of a codebook + entry, j a component, or -1 for their number."""
    k, width = len(books[0]), dims // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [Codebook(np.array(b, np.int64).reshape(k, width)) for b in books]
        total = np.zeros((parts * k, width + 1), object)
        for batch in batches:
            x, name, _ = _assigned(batch.column("embedding"), dims, parts, scale, ready)
            slot = (name + np.arange(parts) * k).ravel()
            order = np.argsort(slot, kind="stable")
            begins = np.flatnonzero(np.diff(slot[order], prepend=-1))
            if len(begins):
                counted = np.c_[np.add.reduceat(x.reshape(-1, width)[order], begins), np.diff(np.append(begins, len(slot)))]
                total[slot[order][begins]] += counted.astype(object)
        yield digits((int(s), j if j < width else -1, total[s, j]) for s in np.flatnonzero(total[:, width]) for j in range(width + 1))

    return run


def _coding(dims: int, parts: int, scale: int, books: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [Codebook(np.array(b, np.int64).reshape(len(b), dims // parts)) for b in books]
        for batch in batches:
            if batch.num_rows:
                _, name, far = _assigned(batch.column("embedding"), dims, parts, scale, ready)
                text = name.astype(np.uint8).tobytes().hex()
                codes = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(far.sum(1))], ["vec_id", "label", "code", "error"])

    return run


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[list[list[int]]]]:
    """((vec_id, label, code, error, label_error) of each whole row of vectors (vec_id, embedding, label, ...), codebooks).

    Rows whose vector is null or holds null or non-finite components are left out. A component x counts as
    floor(scale * x). Codebooks begin with the parts of the first rows by vec_id (null ids last, equal ids by their
    vectors; rows that repeat an id count each), fewer where there are fewer rows. code has two hex digits for each part,
    error the squared distances of all parts, label_error the sum of error over rows of the same label, null labels
    together. An empty table, or one without whole vectors, gives no rows and empty codebooks. Vectors of unlike
    lengths, of a length that parts does not divide, or with components too large for exact 64-bit distances are
    errors. Other columns are not read.
    """
    spark = vectors.sparkSession
    if not 1 <= entries <= 256:
        raise ValueError(f"two hex digits name 256 entries, not {entries}")
    bounded_batches(spark)
    kept = whole(vectors, "vec_id", "label")
    dims = dimensions(kept)
    if dims % parts:
        raise ValueError(f"{dims} components cannot be cut into {parts} equal parts")
    books = learned(kept, dims, parts, entries, rounds, scale)
    kinds = dict(kept.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    coded = written(kept.mapInArrow(_coding(dims, parts, scale, books), schema), "codes")
    named = coded.withColumns({"known": F.col("label").isNotNull(), "name": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    sums = named.groupBy("name", "known").agg(F.sum("error").alias("label_error"))
    return met(named, sums, "name", "vec_id", others=["known"]).select("vec_id", "label", "code", "error", "label_error"), books


def digest(books: list[list[list[int]]]) -> str:
    """SHA-256 of all entries' components in decimal, by place, entry and component, with commas between."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compressed(read(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """Assignment number k to the codebook b(k-1), and the codebook b(k) that it gives."""
    return f"""
a{k} AS (
  SELECT row, p, w, min(64 * list_sum(list_transform(range(1, len(w) + 1), lambda i: (w[i] - c[i]) * (w[i] - c[i]))) + e) AS m
  FROM parts JOIN b{k - 1} USING (p) GROUP BY row, p, w),
t{k} AS (
  SELECT p, e, list(floor_mean ORDER BY i) AS c FROM (
    SELECT p, CAST(m % 64 AS BIGINT) AS e, i, (sum(w[i]) - ((sum(w[i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_mean
    FROM (SELECT p, m, w, unnest(range(1, len(w) + 1)) AS i FROM a{k}) GROUP BY p, m % 64, i)
  GROUP BY p, e),
b{k} AS (SELECT b.p, b.e, coalesce(t.c, b.c) AS c FROM b{k - 1} b LEFT JOIN t{k} t ON t.p = b.p AND t.e = b.e)"""


ORACLE = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT row, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS w FROM (SELECT row, v, unnest(range(16)) AS p FROM kept)),
b0 AS (SELECT p, row - 1 AS e, w AS c FROM parts WHERE row <= 64),
{_round(1)},
{_round(2)},
{_round(3)},
coded AS (
  SELECT row, string_agg(printf('%02x', CAST(m % 64 AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a3 GROUP BY row),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row) CROSS JOIN book
"""
