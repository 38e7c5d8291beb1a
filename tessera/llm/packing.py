"""Packing of token ids into sequences of one length, with a bounded number of open windows.

Each task cuts whole sequences off its documents and places what remains in the open window with the smallest gap
that it fits (best fit). If it fits none and no more windows may be opened, it fills up the fullest, which is
emitted, and its rest is placed in turn; so sequences that a task emits are full. The windows still open at its end,
a few at most, are merged over groups of tasks the same way, and what such a group keeps is cut into sequences of
powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import blocks, bounded_batches, read, written
from tessera.llm.tokens import byte_encoder

LENGTH, OPEN, END = 1024, 16, 0
#: Tasks whose leftovers meet in one group: at most TASKS * OPEN windows.
TASKS = 32
FIELDS = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
_TYPES = [*[pa.int64()] * 6, pa.binary()]

#: doc_id, start, ids (4 bytes each), ids of the whole document
Piece = tuple


class Packer:
    """Online packing; take() yields the sequences that are full, as lists of pieces."""

    def __init__(self, length: int = LENGTH, windows: int = OPEN):
        self.length, self.windows = length, windows
        self.open: list[tuple[int, list[Piece]]] = []

    def take(self, doc, start: int, ids: memoryview, total: int) -> Iterator[list[Piece]]:
        n = len(ids) // 4
        while n >= self.length:
            yield [(doc, start, ids[: 4 * self.length], total)]
            start, ids, n = start + self.length, ids[4 * self.length :], n - self.length
        while n:
            best = min((k for k, (gap, _) in enumerate(self.open) if gap >= n), key=lambda k: self.open[k][0], default=None)
            if best is None and len(self.open) < self.windows:
                self.open.append((self.length - n, [(doc, start, ids, total)]))
                return
            at = min(range(len(self.open)), key=lambda k: self.open[k][0]) if best is None else best
            gap, pieces = self.open[at]
            cut = min(gap, n)
            pieces.append((doc, start, ids[: 4 * cut], total))
            start, ids, n = start + cut, ids[4 * cut :], n - cut
            if gap == cut:
                del self.open[at]
                yield pieces
            else:
                self.open[at] = (gap - cut, pieces)

    def rest(self) -> list[list[Piece]]:
        """The open windows, fullest first."""
        return [p for _, p in sorted(self.open, key=lambda w: w[0])]


def powers_of_two(pieces: list[Piece], length: int = LENGTH) -> Iterator[list[Piece]]:
    """The pieces one after another in sequences of the length, then of falling powers of two."""
    left, k = sum(len(p[2]) // 4 for p in pieces), 0
    pieces = list(pieces)
    while left:
        want = length if left >= length else 1 << (left.bit_length() - 1)
        left, out = left - want, []
        while want:
            doc, start, ids, total = pieces[k]
            cut = min(want, len(ids) // 4)
            out.append((doc, start, ids[: 4 * cut], total))
            want -= cut
            if cut == len(ids) // 4:
                k += 1
            else:
                pieces[k] = (doc, start + cut, ids[4 * cut :], total)
        yield out


class _Rows:
    """Sequences as record batches of pieces."""

    def __init__(self, first_id: int):
        self.next_id, self.columns, self.size = first_id, [[] for _ in _NAMES], 0

    def add(self, pieces: list[Piece]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            for c, v in zip(self.columns, (doc, start, n, total, self.next_id, offset, bytes(ids))):
                c.append(v)
            offset, self.size = offset + n, self.size + len(ids)
        self.next_id += 1

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.columns, _TYPES)], _NAMES)
        self.columns, self.size = [[] for _ in _NAMES], 0
        return out


#: Sequence ids are numbered within a task; from here on they are those of open windows.
_STEP, _LEFT = 1 << 36, 1 << 35


def _pack(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    encoder, packer, task = byte_encoder(path), Packer(), TaskContext.get().partitionId()
    rows, end = _Rows(task * _STEP), np.array([END], "<u4").tobytes()
    for batch in batches:
        for part, data, offsets in blocks(batch):
            for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(data, offsets)):
                ids = memoryview(ids.tobytes() + end)
                for full in packer.take(doc, 0, ids, len(ids) // 4):
                    rows.add(full)
            if rows.size:
                yield rows.batch()
    rows.next_id = task * _STEP + _LEFT
    for window in packer.rest():
        rows.add(window)
    if rows.size:
        yield rows.batch()


def _merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The open windows of a group of tasks: packed again, then cut into powers of two."""
    packer, rows = Packer(), _Rows((1 << 62) + key[0].as_py() * _STEP)
    table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
    for doc, start, total, ids in zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))):
        for full in packer.take(doc, start, memoryview(ids), total):
            rows.add(full)
    for few in powers_of_two([p for w in packer.rest() for p in w]):
        rows.add(few)
    return pa.Table.from_batches([rows.batch()])


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids) of each piece of docs (doc_id long, text string, ...).

    ids are little-endian unsigned 32-bit integers. A document's ids end with END, so null and empty texts have one.
    Each id lies in one piece. Rows that repeat a doc_id, or have none, are documents of their own. An empty table
    gives no rows. Other columns are not read. path: the vocabulary file.
    """
    bounded_batches(docs.sparkSession)
    packed = written(docs.select("doc_id", "text").mapInArrow(lambda it: _pack(it, path), FIELDS), "packed")
    left = F.pmod("sequence_id", F.lit(_STEP)) >= _LEFT
    group = F.expr(f"sequence_id div {_STEP * TASKS}")
    merged = packed.where(left).groupBy(group.alias("group")).applyInArrow(_merge, FIELDS)
    return packed.where(~left).union(merged)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
