"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text becomes counts of word buckets, of triples of character classes and of a few measures of repetition and
length. Document frequencies come from all documents. A truncated singular value decomposition of a bounded sample of
labelled rows gives the latent space; the sample's vectors, at most SAMPLE of LATENT numbers, are broadcast. The driver
keeps the sample's rows without their zeros and decomposes them PART rows at a time. Each document's cosine with each of them is computed exactly, in blocks, and the nearest vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import SPACED, blocks, bounded_batches, distinct_in_texts, find_words, read, shingle_hashes, word_hashes

#: Labelled rows to fit on, at most: those with the smallest hashes of their id.
SAMPLE = 3072
LATENT, NEIGHBOURS, POWER = 48, 24, 4
WORDS, CLASSES = 4096, 16
SHAPES = CLASSES**3
MEASURES, BINS = 4, 12
WIDTH = WORDS + SHAPES + MEASURES * BINS
THRESHOLD = 0.3
#: Rows that the driver fills up with zeros at once.
PART = 128


def _classes() -> np.ndarray:
    t = np.full(256, 12, np.uint16)  # other ASCII
    t[97:123], t[65:91], t[48:58], t[128:] = 1, 2, 3, 4
    for k, group in enumerate((" ", "\n", ".,", "|", "#*$%&@", "!?", "-_=+~"), 5):
        for c in group:
            t[ord(c)] = k
    t[[9, 11, 12, 13]] = 13
    return t


_CLASS = _classes()


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts, a row of WIDTH for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, WIDTH), np.float32)
    low, starts, ends, first = find_words(data, offsets, SPACED)
    h = word_hashes(low, starts, ends)
    of_word = np.repeat(np.arange(n), np.diff(first))
    out[:, :WORDS] = np.bincount(of_word * WORDS + (h % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    if len(data) > 2:
        c = _CLASS[data]
        triples = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
        sizes = np.diff(offsets)
        inside = np.ones(len(data), bool)
        for back in (1, 2):  # triples stay within a text
            inside[(offsets[1:] - back)[sizes >= back]] = False
        keep = inside[:-2]
        of_byte = np.repeat(np.arange(n), sizes)[:-2]
        out[:, WORDS : WORDS + SHAPES] = np.bincount(of_byte[keep] * SHAPES + triples[keep], minlength=n * SHAPES).reshape(n, SHAPES)
    words = np.diff(first)
    some = np.maximum(words, 1)
    distinct = np.diff(distinct_in_texts(h, first)[1])
    pairs, pair_first = shingle_hashes(h, first, 5)
    repeats = 1 - np.diff(distinct_in_texts(pairs, pair_first)[1]) / np.maximum(np.diff(pair_first), 1)
    same = np.bincount(of_word[1:][(h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])], minlength=n) / some if len(h) else np.zeros(n)
    measures = (np.minimum(np.log2(words + 1), BINS - 1), distinct / some * (BINS - 1), repeats * (BINS - 1), same * (BINS - 1))
    for k, m in enumerate(measures):
        at = WORDS + SHAPES + k * BINS
        floor = np.floor(m).astype(np.int64)
        part = (m - floor).astype(np.float32)
        rows = np.arange(n)
        out[rows, at + floor] += 1 - part
        out[rows, at + np.minimum(floor + 1, BINS - 1)] += part
    return out


def weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Logarithmic counts times idf; words, shapes and measures each of one length."""
    x = np.log1p(counts)
    x *= idf
    for a, b, weight in ((0, WORDS, 0.5), (WORDS, WORDS + SHAPES, 1.0), (WORDS + SHAPES, WIDTH, 1.0)):
        part = x[:, a:b]
        part *= weight / np.maximum(np.sqrt(np.einsum("ij,ij->i", part, part)), 1e-9)[:, None]
    return x


def nonzero(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Where each row of x is not zero, and what stands there."""
    return [(at.astype("<u2"), r[at]) for r in x for at in [np.flatnonzero(r)]]


class Sparse:
    """Rows of WIDTH numbers without their zeros, as nonzero() gives them; a slice is filled up with zeros."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, part: slice) -> np.ndarray:
        rows = self.rows[part]
        out = np.zeros((len(rows), WIDTH), np.float32)
        for r, (at, values) in zip(out, rows):
            r[at] = values
        return out


def parts(x: np.ndarray | Sparse) -> Iterator[tuple[slice, np.ndarray]]:
    for i in range(0, len(x), PART):
        yield slice(i, i + PART), x[i : i + PART]


def times(x: np.ndarray | Sparse, m: np.ndarray) -> np.ndarray:
    return np.concatenate([rows @ m for _, rows in parts(x)])


def turned_times(x: np.ndarray | Sparse, m: np.ndarray) -> np.ndarray:
    """The transpose of x times m."""
    out = np.zeros((WIDTH, m.shape[1]))
    for at, rows in parts(x):
        out += rows.T @ m[at]
    return out.astype(np.float32)


def latent_space(x: np.ndarray | Sparse, rank: int = LATENT, seed: int = 7) -> np.ndarray:
    """The first right singular vectors of x, as columns, by a randomised range finder."""
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(times(x, rng.standard_normal((WIDTH, rank + 16)).astype(np.float32)))[0]
    for _ in range(2):
        q = np.linalg.qr(times(x, turned_times(x, q)))[0]
    _, _, v = np.linalg.svd(turned_times(x, q).T, full_matrices=False)
    return np.ascontiguousarray(v[:rank].T, dtype=np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Model:
    """idf, the latent space, and the labelled vectors in it."""

    def __init__(self, counts: np.ndarray | Sparse, labels: np.ndarray, df: np.ndarray, n_docs: int):
        self.idf = np.log((n_docs + 1) / (df + 1) + 1).astype(np.float32)
        self.labels = labels.astype(np.float32)
        x = Sparse([r for _, rows in parts(counts) for r in nonzero(weighed(rows, self.idf))])
        self.space = latent_space(x) if len(x) else np.zeros((WIDTH, 1), np.float32)
        self.vectors = unit(times(x, self.space)) if len(x) else np.zeros((0, 1), np.float32)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        near = unit(weighed(counts, self.idf) @ self.space) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        last = np.partition(near, near.shape[1] - k, axis=1)[:, -k]
        # Neighbours as near as the last of the nearest all vote, so ties are not broken by chance.
        row, at = np.nonzero(near >= last[:, None])
        weight = np.maximum(near[row, at], 1e-6).astype(np.float64) ** POWER
        return np.bincount(row, weight * self.labels[at], len(near)) / np.bincount(row, weight, len(near))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in blocks(batch):
            rows = nonzero(features(data, offsets))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[k].tobytes() for r in rows]) for k in (0, 1))], ["doc_id", "at", "n"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's document frequencies, and at WIDTH its number of documents."""
    df = np.zeros(WIDTH + 1, np.int64)
    for batch in batches:
        for part, data, offsets in blocks(batch):
            df[:WIDTH] += (features(data, offsets) > 0).sum(0)
            df[WIDTH] += part.num_rows
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["feature", "df"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of labels (doc_id, label) on the texts of docs, from SAMPLE labelled ids at most.

    Of labels that repeat a doc_id the largest counts, and of texts that do, the one whose features come first.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    # As Arrow: Spark then cuts to SAMPLE rows in a task, where collect() sends up to SAMPLE of each partition to the driver.
    chosen = {r["doc_id"]: r["label"] for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).toArrow().to_pylist()}
    spark = docs.sparkSession
    ids = spark.createDataFrame([(k,) for k in chosen], "doc_id long")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(_sparse, "doc_id long, at binary, n binary")
    # A row for each chosen id, however many rows repeat it; a row has a count for each of WIDTH features at most.
    found = rows.groupBy("doc_id").agg(F.min(F.struct("at", "n")).alias("x")).select("doc_id", "x.at", "x.n").toArrow().to_pylist()
    found.sort(key=lambda r: r["doc_id"])
    counts = Sparse([(np.frombuffer(r["at"], "<u2"), np.frombuffer(r["n"], np.float32)) for r in found])
    df = np.zeros(WIDTH + 1, np.int64)
    for r in docs.select("text").mapInArrow(_frequencies, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect():
        df[r["feature"]] = r["df"]
    return Model(counts, np.array([chosen[r["doc_id"]] for r in found]), df[:WIDTH], int(df[WIDTH]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of docs (doc_id long, text string, ...): 0 to 1, higher the likelier label 1 is.

    Null and empty texts are scored by their length alone. Without any labelled row every score is 0.5. Texts are
    scored whole; rows that repeat a doc_id each get a row; an empty table gives none. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sent.value.score(features(data, offsets)))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores the threshold at least."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch):
                yield part.filter(pa.array(sent.value.score(features(data, offsets)) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs, learned from labels (doc_id, quality, ...)."""
    model = fit(docs, labels.where(~held_out()).select("doc_id", F.col("quality").alias("label")))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
