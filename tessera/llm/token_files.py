"""Token-id files: documents compressed one by one against a shared zstandard dictionary.

A folder holds the dictionary and shards. A shard is one binary value with this layout, all little-endian:

    8 bytes  b"TOKSHRD1"
    32 bytes SHA-256 of the dictionary
    4 + 4    bytes of an id (2 or 4), number of documents n
    n rows   document id (8), 1 where it is null (1), start of its frame after the index (8), ids in it (8)
    frames   a zstandard frame for each document

Spark writes and reads the values, so a folder may lie in any store that Spark reaches. One short document is read
with one lookup in the index and one frame.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import blocks, bounded_batches, new_folder, read
from tessera.llm.tokens import word_encoder

MAGIC = b"TOKSHRD1"
HEAD = struct.Struct("<8s32sII")
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("at", "<u8"), ("n", "<u8")])
#: The dictionary is trained on the ids of the documents with the smallest hashes of their id and text: so many at most,
#: one for each doc_id, and of a long one the first bytes of its ids. (All documents are written whole.)
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 1 << 16, 64 << 10
SHARD_BYTES = 4 << 20
END = 1


def _encoded(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[tuple[list, list[bytes]]]:
    encoder = word_encoder(path)
    end = np.array([END], "<u4").tobytes()
    for batch in batches:
        for part, data, offsets in blocks(batch):
            yield part.column("doc_id").to_pylist(), [x.tobytes() + end for x in encoder.encode(data, offsets)]


def serialized(ids: bytes, width: int) -> bytes:
    """Ids of `width` bytes; an id that does not fit is an error, never another id."""
    if width == 4:
        return ids
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and wide.max() > 0xFFFF:
        raise ValueError(f"id {wide.max()} needs width 4")
    return wide.astype("<u2").tobytes()


def train_dictionary(docs: DataFrame, width: int, path: str | None = None) -> bytes:
    """A dictionary from a bounded sample (SAMPLE_DOCS documents, SAMPLE_BYTES of each); empty if it is too little."""
    order = F.struct(F.xxhash64("doc_id"), F.xxhash64("text")).alias("order")
    sample = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), order)
    chosen = sample.groupBy("doc_id").agg(F.min("order").alias("order")).orderBy("order").limit(SAMPLE_DOCS).select("doc_id", F.col("order.col2").alias("text_hash"))
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), "doc_id long, text_hash long")

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, found in _encoded(batches, path):
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([serialized(x, width)[:SAMPLE_BYTES] for x in found], pa.binary())], ["doc_id", "ids"])

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(F.broadcast(chosen), ["doc_id", "text_hash"], "left_semi")
    samples = texts.select("doc_id", "text").mapInArrow(ids, "doc_id long, ids binary").groupBy("doc_id").agg(F.min("ids").alias("ids"))
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sorted(bytes(r["ids"]) for r in samples.collect())).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def make_shard(doc_ids: list, ids: list[bytes], width: int, compress, digest: bytes) -> bytes:
    frames = [compress(serialized(x, width)) for x in ids]
    index = np.zeros(len(ids), INDEX)
    index["doc_id"] = [0 if d is None else d for d in doc_ids]
    index["null"] = [d is None for d in doc_ids]
    index["n"] = [len(x) // 4 for x in ids]
    index["at"][1:] = np.cumsum([len(f) for f in frames[:-1]])
    return HEAD.pack(MAGIC, digest, width, len(ids)) + index.tobytes() + b"".join(frames)


class Shard:
    """A shard's index, and its documents one at a time."""

    def __init__(self, value: bytes, dictionary: bytes):
        magic, digest, self.width, n = HEAD.unpack_from(value)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        self.index = np.frombuffer(value, INDEX, n, HEAD.size)
        self.frames = memoryview(value)[HEAD.size + n * INDEX.itemsize :]
        self.decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def __len__(self) -> int:
        return len(self.index)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document, as unsigned 32-bit integers."""
        at = int(self.index["at"][k])
        to = int(self.index["at"][k + 1]) if k + 1 < len(self) else len(self.frames)
        return np.frombuffer(self.decompressor.decompress(self.frames[at:to]), f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int) -> np.ndarray | None:
        """The ids of one document by its id; documents lie in ascending order."""
        known = self.index["doc_id"][self.index["null"] == 0]
        k = int(np.searchsorted(known, doc_id)) + len(self) - len(known)
        return self.ids(k) if k < len(self) and self.index["doc_id"][k] == doc_id else None


def write(docs: DataFrame, folder: str, path: str | None = None, width: int = 2) -> None:
    """Write the ids of docs (doc_id long, text string, ...) to a folder, in ascending doc_id order.

    Null and empty texts have the end id alone. Documents without a doc_id come first; rows that repeat a doc_id are
    all written, in the order of a hash of their texts. An empty table gives a folder without documents. Other columns are
    not read. path: the vocabulary file; width: bytes of an id in the files.
    """
    bounded_batches(docs.sparkSession)
    dictionary = train_dictionary(docs, width, path)
    digest = hashlib.sha256(dictionary).digest()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).compress
        part, number, inside, names, held, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def row() -> pa.RecordBatch:
            first = next((d for d in names if d is not None), None)
            last = next((d for d in reversed(names) if d is not None), None)
            columns = [[part], [number], [inside], [first], [last], [len(names)], [sum(len(x) for x in held) // 4], [make_shard(names, held, width, compress, digest)]]
            types = [pa.int32(), *[pa.int64()] * 6, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["part", "number", "inside", "first_doc", "last_doc", "n_docs", "n_tokens", "shard"])

        for found, ids in _encoded(batches, path):
            names += found
            held += ids
            size += sum(map(len, ids))
            if size >= 3 * SHARD_BYTES:
                yield row()
                number, inside, names, held, size = number + 1, inside + size // 4, [], [], 0
        if names:
            yield row()

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # An id of very many rows is parted by text, and equal rows by their place.
    keyed = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"), "text")
    ordered = keyed.repartitionByRange(n, "doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row").select("doc_id", "text")
    fields = "part int, number long, inside long, first_doc long, last_doc long, n_docs long, n_tokens long, shard binary"
    ordered.mapInArrow(shards, fields).write.mode("overwrite").option("compression", "none").parquet(f"{folder}/shards")
    spark.createDataFrame([(digest.hex(), bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.mode("overwrite").parquet(f"{folder}/dictionary")


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document in a folder; ids: little-endian unsigned 32-bit integers."""
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first()["dictionary"])
    shards = spark.read.parquet(f"{folder}/shards")
    # A shard knows the ids before it in its part; there are as many parts as tasks wrote, which is what is broadcast.
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = shards.join(F.broadcast(before), "part").select("shard", (F.col("before") + F.col("inside")).alias("start"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value, start in zip(batch.column("shard"), batch.column("start").to_pylist()):
                shard = Shard(value.as_py(), dictionary)
                begin = start + np.cumsum(shard.index["n"].astype(np.int64)) - shard.index["n"].astype(np.int64)
                for at in range(0, len(shard), 512):
                    cut = slice(at, min(at + 512, len(shard)))
                    ids = [shard.ids(k).tobytes() for k in range(cut.start, cut.stop)]
                    names = pa.array(shard.index["doc_id"][cut].astype(np.int64), mask=shard.index["null"][cut].astype(bool))
                    yield pa.RecordBatch.from_arrays([names, pa.array(begin[cut]), pa.array(shard.index["n"][cut].astype(np.int64)), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    write(read(spark, sf_dir, "documents"), folder)
    return read_back(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
