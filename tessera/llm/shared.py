"""What the corpus operators share: reading, written intermediate tables, and byte-level word arrays."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task handles at once; a longer text is handled alone.
BLOCK_BYTES = 1 << 19


def bounded_batches(spark: SparkSession) -> None:
    """Rows and bytes that Spark sends to Python at once: texts may be long, so the usual 10 000 rows are too many.

    Results are computed when the caller asks for them, so these bounds stay in the session. Smaller ones are kept.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        found = spark.conf.get(name).rstrip("b")
        if not (found.isdigit() and 0 < int(found) <= most):
            spark.conf.set(name, str(most))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---------------------------------------------------------------- written tables

_kept: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or one set here where it is unset.

    A cluster must name it: a folder made here would be another one on each machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))  # unset: a single machine, as in tests
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder, until the session's end."""
    if not _kept:
        atexit.register(_drop_all)
    path = f"{shared_folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    _kept.append((spark, path))
    return path


#: Rows of the input that a file of an intermediate table stands for, about.
ROWS_A_FILE = 10_000


def files_for(spark: SparkSession, rows: int) -> int:
    """Files of intermediate tables of an input of so many rows: four for each core at least, and more as it grows."""
    return max(4 * spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_FILE))


def written(df: DataFrame, name: str, even: bool = False, files: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut and lost executors cost no recomputation.

    files: at most so many, where the partitions of a table may be many more than its size asks for.

    even: Spark evens out and joins the partitions of a shuffle by their measured sizes first, so that a small table
    has few files, a large one many, and none grows with the table.
    """
    spark = df.sparkSession
    df = df.hint("rebalance") if even else df.coalesce(files) if files else df
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for t in tables:
        if path := getattr(t, "_tessera_path", None):
            _delete(t.sparkSession, path)
            _kept[:] = [x for x in _kept if x[1] != path]


def mark() -> int:
    """How many folders there are now, for drop_since."""
    return len(_kept)


def drop_since(place: int, *but: DataFrame) -> None:
    """Delete the folders made since a mark, but those of some tables: what an operator wrote for a result that is read."""
    kept = {getattr(t, "_tessera_path", None) for t in but}
    for spark, path in _kept[place:]:
        if path not in kept:
            _delete(spark, path)
    _kept[place:] = [x for x in _kept[place:] if x[1] in kept]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_all() -> None:
    for spark, path in _kept:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone
            return


# ---------------------------------------------------------------- texts as bytes


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    size = int(offsets[-1] - offsets[0])
    data = np.frombuffer(col.buffers()[2], np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(batch: pa.RecordBatch, text: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with their texts' bytes and offsets, of at most `most` bytes or one row."""
    data, offsets = utf8(batch.column(text))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _table(separators) -> np.ndarray:
    """Byte to byte: A-Z lower-cased, separators 0."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[list(separators)] = 0
    return t


#: Words are runs of other bytes than white space; all bytes of characters beyond ASCII belong to words.
SPACED = _table([0x20, *range(0x09, 0x0E)])
#: Words are runs of digits, a-z and characters beyond ASCII. Upper case is lower-cased before.
_plain = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
PLAIN = _table(_plain)


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, first word of each text): words never cross texts.

    NUL is a word character of SPACED, so separators are told by the table's input, not its output.
    """
    low = table[data]
    inside = np.ones(len(data) + 1, bool)
    sep = table == 0
    sep[0] = table is PLAIN
    np.logical_not(sep[data], out=inside[:-1])
    inside[-1] = False
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    stops = inside[:-1].copy()
    stops &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (_BASE, _BACK):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = _powers(1 << max(20, int(n + 1).bit_length()))
    return a[: n + 1], b[: n + 1]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of values times powers, modulo 2**64, for span_hash."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(len(values))[0][:-1], out=out[1:], dtype=np.uint64)
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the values in each span that does not depend on where it lies."""
    back = powers(len(sums) - 1)[1]
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(low.astype(np.uint64) + np.uint64(1)), starts, ends)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first shingle of each text). A text of 1 to k-1 words is one shingle; one without words has none."""
    n_words = np.diff(first)
    counts = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    starts_of = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=starts_of[1:])
    if not starts_of[-1]:
        return np.zeros(0, np.uint64), starts_of
    starts = np.repeat(first[:-1] - starts_of[:-1], counts) + np.arange(starts_of[-1])
    ends = starts + np.repeat(np.minimum(n_words, k), counts)
    return span_hash(prefix_sums(words), starts, ends), starts_of


def distinct_in_texts(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text sorted without repeats, and where each text's begin."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return h[keep], np.searchsorted(t[keep], np.arange(len(first)))


# ---------------------------------------------------------------- bitmaps of fixed size

#: Bits of a bitmap that tells tasks which keys may matter: 16 MB, whatever the tables hold.
BITMAP_BITS = 1 << 27


def bitmap(keys: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """A set bit for each value of the one long column of keys, modulo bits; Spark folds the bits into words first."""
    (name,) = keys.columns
    bit = F.pmod(F.col(name), F.lit(bits))
    words = keys.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("value"))
    found = words.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("word").to_numpy()] = found.column("value").to_numpy().view(np.uint64)
    return out


def may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which unsigned keys may be among those of a bitmap; a signed key has the same bit as its unsigned twin."""
    at = keys & np.uint64(64 * len(words) - 1)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
