"""Removal of repeated strings with suffix arrays.

A string of LENGTH bytes is found by the 80-byte gram in it with the smallest hash. Starts of a text one after another
whose strings have the same smallest gram make a chunk, so each string lies in one chunk and all its copies lie in
chunks with the same gram. Grams that occur once need no more work: a bitmap of fixed size tells tasks which may
occur more often. Equal chunks are folded and counted; one that stays alone under its gram repeats in its copies or
not at all. Unlike chunks of one gram meet in one task, which builds a suffix array of them by two-stage sorting and
takes the strings that share LENGTH bytes with a neighbour. A gram with very many unlike chunks (a line that many
texts share) is not gathered: its chunks are cut into pieces of fewer starts, which meet under the bytes that all
strings of a piece share, and the same is done with those, down to single strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import BLOCK_BYTES, bitmap, blocks, bounded_batches, drop, files_for, may_hold, mix, powers, prefix_sums, read, span_hash, written
from tessera.llm.suffixes import repeated_starts

LENGTH, GRAM = 200, 80
GRAMS = LENGTH - GRAM + 1
#: Unlike chunks of one gram that one task takes together, at most.
TOGETHER = 256
#: Starts of the pieces that crowded chunks are cut into, level by level; the last are single strings.
WIDTHS = (16, 4, 1)
#: Bytes of a suffix array.
SORT_BYTES = 1 << 20
_PLACE_BITS = 21


def _window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest value in each window."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(rows, width)
    down = np.minimum.accumulate(grid, axis=1).ravel()
    up = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(up[:n], down[width - 1 : width - 1 + n])


def _stretch_chunks(data: np.ndarray, offsets: np.ndarray):
    """(text, first start, starts, gram hash, chunk hash, bytes from the first start to the gram) of each chunk; data is
    short enough for _PLACE_BITS."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none
    sums = prefix_sums(data.astype(np.uint64) + np.uint64(1))
    n = len(data) - GRAM + 1
    grams = mix((sums[GRAM:] - sums[:n]) * powers(len(data))[1][:n])
    # The place in the lower bits: of equal grams, the first.
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least = _window_minima((grams & ~low) | np.arange(n, dtype=np.uint64), GRAMS)
    place = (least & low).astype(np.int64)
    starts = np.arange(len(place))
    text = np.searchsorted(offsets, starts, "right") - 1
    valid = starts + LENGTH <= offsets[text + 1]
    starts, text, place = starts[valid], text[valid], place[valid]
    if not len(starts):
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(fresh)
    counts = np.diff(np.append(at, len(starts)))
    first = starts[at]
    hashes = span_hash(sums, first, first + counts + LENGTH - 1)
    return text[at], first - offsets[text[at]], counts, grams[place[at]], hashes, place[at] - first


def chunks(data: np.ndarray, offsets: np.ndarray):
    """(text, first start, starts, gram hash, chunk hash, bytes from the first start to the gram) of each chunk."""
    if len(data) < 1 << _PLACE_BITS:
        return _stretch_chunks(data, offsets)
    found = []
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for s in range(a, max(b - LENGTH + 1, a + 1), BLOCK_BYTES):  # starts of a long text, BLOCK_BYTES at a time
            piece = data[s : min(b, s + BLOCK_BYTES + LENGTH - 1)]
            got = _stretch_chunks(piece, np.array([0, len(piece)]))
            found.append((got[0] + k, got[1] + (s - a), *got[2:]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _keys(text_id: pa.Array, rows: np.ndarray) -> pa.Array:
    return text_id.take(pa.array(rows))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, offsets in blocks(batch):
            names, n = np.unique(chunks(data, offsets)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], ["gram", "n"])


def _chosen(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Chunks whose gram may repeat; a chunk's bytes come with its first copy in a block only."""
    for batch in batches:
        for part, data, offsets in blocks(batch):
            found = chunks(data, offsets)
            keep = may_hold(wanted, found[3])
            text, first, counts, grams, hashes, lead = (x[keep] for x in found)
            shown = np.zeros(len(text), bool)
            shown[np.unique(grams ^ mix(hashes), return_index=True)[1]] = True
            begin = offsets[text] + first
            raw = [data[a : a + n + LENGTH - 1].tobytes() if s else None for a, n, s in zip(begin.tolist(), counts.tolist(), shown.tolist())]
            columns = [_keys(part.column("doc_id"), text), _keys(part.column("digest"), text), *(pa.array(x) for x in (first, lead, grams.view(np.int64), hashes.view(np.int64))), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "first", "lead", "gram", "chunk", "bytes"])


CHOSEN = "doc_id long, digest long, first long, lead long, gram long, chunk long, bytes binary"


def covered(starts: np.ndarray) -> np.ndarray:
    """Runs of bytes (from, to) that strings at these sorted starts cover."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    gap = np.flatnonzero(np.diff(starts) > LENGTH)
    return np.stack((starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + LENGTH), 1)


def _sorted_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeated starts of chunks, which come by gram; a gram's chunks are taken together."""
    held: list[tuple] = []
    size = 0

    def found() -> pa.RecordBatch:
        got = repeated_starts([h[3] for h in held], LENGTH)
        starts = [np.flatnonzero(g | (h[2] > 1)) for g, h in zip(got, held)]
        kept = [(h[0], h[1], s) for h, s in zip(held, starts) if len(s)]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64()), pa.array([covered(k[2]).ravel() for k in kept], pa.list_(pa.int64()))], ["gram", "chunk", "runs"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "chunk", "n", "bytes"))):
            if size >= SORT_BYTES and row[0] != held[-1][0]:
                yield found()
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield found()


PIECES = "gram long, chunk long, at long, gram1 long, chunk1 long, n long, lead long, bytes binary"


def _cut_up(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Pieces of chunks: strings whose starts lie as far before the gram, in steps of width.

    gram1 stands for the bytes that all strings of such a piece would share, chunk1 for all bytes of the piece.
    """
    for batch in batches:
        rows = []
        for gram, chunk, n, lead, raw in zip(*(batch.column(c).to_pylist() for c in ("gram", "chunk", "n", "lead", "bytes"))):
            starts = len(raw) - LENGTH + 1
            at = 0
            while at < starts:
                step = (lead - at) // width
                to = min(starts, lead - step * width + 1)
                core = raw[lead - step * width : lead - (step + 1) * width + 1 + LENGTH]
                piece = raw[at : to - 1 + LENGTH]
                key = hashlib.blake2b(core, digest_size=8, salt=step.to_bytes(4, "little", signed=True)).digest()
                name = hashlib.blake2b(piece, digest_size=8, salt=(lead - at).to_bytes(4, "little", signed=True)).digest()
                rows.append((gram, chunk, at, int.from_bytes(key, "little", signed=True), int.from_bytes(name, "little", signed=True), n, lead - at, piece))
                at = to
        types = [*[pa.int64()] * 7, pa.binary()]
        columns = list(zip(*rows)) if rows else [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in PIECES.split(", ")])


def _resolved(folded: DataFrame, widths: tuple[int, ...], files: int) -> DataFrame:
    """(gram, chunk, runs) of the chunks in folded (gram, chunk, n, lead, bytes) with strings that repeat."""
    spark = folded.sparkSession
    kinds = written(folded.groupBy("gram").agg(F.count("*").alias("kinds"), F.max("n").alias("most")).where("kinds > 1 or most > 1"), "kinds", files=files)
    # A gram with one chunk, once, is alone.
    few, many = (kinds.where(c).select("gram") for c in (f"kinds between 2 and {TOGETHER}", f"kinds > {TOGETHER}"))
    alone = folded.join(kinds.where("kinds = 1 and most > 1").select("gram"), "gram", "left_semi")
    runs = alone.select("gram", "chunk", F.array(F.lit(0), F.length("bytes")).cast("array<long>").alias("runs"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = folded.join(few, "gram", "left_semi").repartition(n, "gram").sortWithinPartitions("gram", "chunk")
    runs = runs.union(near.select("gram", "chunk", "n", "bytes").mapInArrow(_sorted_chunks, "gram long, chunk long, runs array<long>"))
    if widths and not many.isEmpty():
        crowded = folded.join(many, "gram", "left_semi").select("gram", "chunk", "n", "lead", "bytes")
        pieces = written(crowded.mapInArrow(lambda it: _cut_up(it, widths[0]), PIECES), "pieces", files=files)
        below = pieces.groupBy(F.col("gram1").alias("gram"), F.col("chunk1").alias("chunk")).agg(F.sum("n").alias("n"), F.max("lead").alias("lead"), F.max("bytes").alias("bytes"))
        inner = _resolved(written(below, "folded", files=files), widths[1:], files).select(F.col("gram").alias("gram1"), F.col("chunk").alias("chunk1"), "runs")
        back = pieces.select("gram", "chunk", "at", "gram1", "chunk1").join(inner, ["gram1", "chunk1"])
        moved = back.select("gram", "chunk", F.transform("runs", lambda x: x + F.col("at")).alias("runs"))
        runs = runs.union(moved.groupBy("gram", "chunk").agg(F.flatten(F.collect_list("runs")).alias("runs")))
    return written(runs, "runs", files=files)


def _whole(batches: Iterator[pa.RecordBatch], touched: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Texts that nothing is removed from are done; the others go on with their bytes."""
    for batch in batches:
        for part, data, offsets in blocks(batch):
            maybe = may_hold(touched, part.column("digest").to_numpy().view(np.uint64))
            texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            digests = [None if m else hashlib.sha256(t).hexdigest() for t, m in zip(texts, maybe)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("digest"), pa.array(np.diff(offsets)), pa.array(digests, pa.string()), pa.array([t if m else None for t, m in zip(texts, maybe)], pa.binary())],
                ["doc_id", "digest", "n_bytes", "sha", "bytes"],
            )


def merged(runs: list[list[int]]) -> np.ndarray:
    """Sorted maximal runs (from, to) of runs that may overlap or touch."""
    x = np.concatenate([np.array(r, np.int64).reshape(-1, 2) for r in runs] or [np.zeros((0, 2), np.int64)])
    if not len(x):
        return x
    x = x[np.argsort(x[:, 0], kind="stable")]
    end = np.maximum.accumulate(x[:, 1])
    fresh = np.append(True, x[1:, 0] > end[:-1])
    at = np.flatnonzero(fresh)
    return np.stack((x[at, 0], end[np.append(at[1:] - 1, len(x) - 1)]), 1)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, n, sha, raw, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "sha", "bytes", "runs"))):
            spans = merged(runs or [])
            if raw is not None:
                edges = [0, *spans.ravel().tolist(), n]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                sha, rest = hashlib.sha256(kept).hexdigest(), kept if len(spans) else None
            else:
                rest = None
            rows.append((doc_id, n, int((spans[:, 1] - spans[:, 0]).sum()), len(spans), sha, spans.ravel().tolist(), rest))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()]
        columns = list(zip(*rows)) if rows else [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])


def repeated_strings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept) of each row of docs (doc_id long, text string, ...).

    Removed is each byte covered by a string of LENGTH bytes that also starts anywhere else, in the same text or
    another; strings lie within one text. spans are the removed runs, from and to one after another; kept are the
    bytes that stay, null where all do. Null and empty texts have no bytes. Rows that repeat a doc_id are texts of
    their own, and repeat each other where they are alike. An empty table gives no rows. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text", "doc_id"))
    counts = texts.select("text").mapInArrow(_gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(bitmap(counts.where("n > 1").select("gram")))
    chosen = written(texts.select("doc_id", "digest", "text").mapInArrow(lambda it: _chosen(it, wanted.value), CHOSEN), "chunks")
    files = files_for(spark, docs.count())
    folded = written(chosen.groupBy("gram", "chunk").agg(F.count("*").alias("n"), F.max("lead").alias("lead"), F.max("bytes").alias("bytes")), "folded", files=files)
    runs = _resolved(folded, WIDTHS, files)
    placed = chosen.select("doc_id", "digest", "first", "gram", "chunk").join(runs, ["gram", "chunk"])
    shifted = placed.select("doc_id", "digest", F.transform("runs", lambda x: x + F.col("first")).alias("runs"))
    found = written(shifted.groupBy("doc_id", "digest").agg(F.collect_set("runs").alias("runs")), "removed", files=files)
    drop(chosen, folded, runs)
    touched = spark.sparkContext.broadcast(bitmap(found.select("digest")))
    whole = texts.mapInArrow(lambda it: _whole(it, touched.value), "doc_id long, digest long, n_bytes long, sha string, bytes binary")
    found = found.withColumnRenamed("doc_id", "d")
    out = whole.join(found, (whole.digest == found.digest) & whole.doc_id.eqNullSafe(found.d), "left").select("doc_id", "n_bytes", "sha", "bytes", "runs")
    return out.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept binary")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
