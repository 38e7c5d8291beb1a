"""Scoring of documents by a gated recurrent language model that is trained on the corpus.

Counts of all training words come from one aggregation. The most frequent words have classes of their own, in which
the network chooses the word; all other words lie in classes by their form (last character, accents, length), in
which a word has the probability of its count. The network is trained over all training documents: tasks start a
round from the same parameters, learn from their share by truncated back-propagation, and a tree of sums averages
them by tokens. Scoring carries the state through a whole document, however long. Counts of rare words, which are
too many to send to tasks, meet the documents' rare words in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import gru
from tessera.llm.shared import SPACED, blocks, bounded_batches, find_words, read, word_hashes, written

#: Words with a class of their own: CLASSES of WORDS.
CLASSES, WORDS = 16, 64
#: Words whose counts are sent to tasks, at most: 24 bytes each.
SENT = 1 << 18
ROUNDS = 2
#: In training, a document's state starts anew after so many tokens.
STRETCH = 2048
TRAIN_BYTES, SCORE_BYTES = 12 << 20, 20 << 20
#: Stands for the end of a document.
END = 1
ENDINGS, ACCENTS, LENGTHS = 5, 4, 2
FORMS = ENDINGS * ACCENTS * LENGTHS
END_FORM = 0


def _endings() -> np.ndarray:
    t = np.full(256, 4, np.int32)
    t[97:123] = 0
    for k, group in ((1, b".,;:"), (2, b"#$%&*|"), (3, b"!?")):
        t[list(group)] = k
    return t


_ENDING = _endings()


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, forms, first token of each text): words, and END after each text."""
    low, starts, ends, first = find_words(data, offsets, SPACED)
    n_texts, n = len(offsets) - 1, len(starts)
    high = np.flatnonzero(low >= 0xC0)
    accent = np.zeros(n, np.int32)
    if len(high):
        at = high[np.minimum(np.searchsorted(high, starts), len(high) - 1)]
        has = (at >= starts) & (at < ends)
        accent[has] = 1 + (low[np.minimum(at + 1, len(low) - 1)][has] % 3)
    form = (_ENDING[low[ends - 1]] * ACCENTS + accent) * LENGTHS + (ends - starts > 5)
    place = np.arange(n) + np.repeat(np.arange(n_texts), np.diff(first))
    hashes, forms = np.full(n + n_texts, END, np.uint64), np.full(n + n_texts, END_FORM, np.int32)
    hashes[place], forms[place] = word_hashes(low, starts, ends), form
    return hashes, forms, first + np.arange(n_texts + 1)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts of words, in a few tables of bounded size."""
    parts: list[tuple] = []
    size = 0

    def merged() -> tuple:
        h, k, c = (np.concatenate(x) for x in zip(*parts))
        names, one, which = np.unique(h, return_index=True, return_inverse=True)
        return names, k[one], np.bincount(which, c, len(names)).astype(np.int64)

    def rows() -> Iterator[pa.RecordBatch]:
        h, k, c = merged()
        for a in range(0, len(h), 1 << 16):
            b = a + (1 << 16)
            yield pa.RecordBatch.from_arrays([pa.array(h[a:b].view(np.int64)), pa.array(k[a:b]), pa.array(c[a:b])], ["h", "form", "n"])

    for batch in batches:
        for _, data, offsets in blocks(batch):
            h, k, _ = tokens(data, offsets)
            names, one, n = np.unique(h, return_index=True, return_counts=True)
            parts.append((names, k[one], n))
            size += len(names)
            if size > 1 << 21:
                parts = [merged()]
                size = len(parts[0][0])
                if size > 1 << 20:
                    yield from rows()
                    parts, size = [], 0
    if parts:
        yield from rows()


class Vocabulary:
    """The words whose counts tasks know, and what each means to the network."""

    def __init__(self, hashes: np.ndarray, forms: np.ndarray, counts: np.ndarray, form_counts: np.ndarray, form_words: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, forms, self.counts = hashes[order], forms[order], counts[order]
        self.total, self.distinct = int(form_counts.sum()), int(form_words.sum())
        head = np.lexsort((self.hashes, -self.counts, self.hashes != END))[: CLASSES * WORDS]  # END first, then by count
        head = head[np.lexsort((self.hashes[head], -self.counts[head], forms[head]))]
        #: Place among the words with classes of their own, or -1.
        self.place = np.full(len(hashes), -1, np.int32)
        self.place[head] = np.arange(len(head))
        word_counts = np.zeros(CLASSES * WORDS)
        word_counts[: len(head)] = self.counts[head]
        rest, words = form_counts.astype(np.float64), form_words.astype(np.float64)
        np.subtract.at(rest, forms[head], self.counts[head])
        np.subtract.at(words, forms[head], 1)
        #: What a count and a half is divided by in each form; one unknown word stands for all.
        self.divisor = rest + 0.5 * (words + 1)
        self.shape = gru.Shape(CLASSES * WORDS + FORMS + 1, CLASSES + FORMS, CLASSES, WORDS)
        self.begin = CLASSES * WORDS + FORMS
        self.start = self.shape.start(np.concatenate((word_counts.reshape(CLASSES, WORDS).sum(1), self.divisor)), word_counts.reshape(CLASSES, WORDS))

        # A slot by the hash's low bits holds one word; those that find it taken are looked up by bisection.
        self.slots = np.full(1 << 20, -1, np.int32)
        slot = (self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)
        self.slots[slot] = np.arange(len(self.hashes), dtype=np.int32)
        self.shared = np.bincount(slot, minlength=1 << 20) > 1

    def found(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of the words, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int32)
        slot = (hashes & np.uint64((1 << 20) - 1)).astype(np.int32)
        rows = self.slots[slot]
        rows[self.hashes[rows] != hashes] = -1
        again = np.flatnonzero((rows < 0) & self.shared[slot])
        at = np.minimum(np.searchsorted(self.hashes, hashes[again]), len(self.hashes) - 1)
        rows[again] = np.where(self.hashes[at] == hashes[again], at, -1)
        return rows

    def encoded(self, rows: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(input symbols, classes, words in their class)."""
        place = np.where(rows >= 0, self.place[rows], -1) if len(self.place) else np.full(len(rows), -1, np.int32)
        own = place >= 0
        symbols = np.where(own, place, CLASSES * WORDS + forms).astype(np.int32)
        return symbols, np.where(own, place // WORDS, CLASSES + forms).astype(np.int32), np.where(own, place % WORDS, 0).astype(np.int32)


def count_words(docs: DataFrame) -> DataFrame:
    """(h, form, n) of each distinct token of docs, written."""
    counts = docs.select("text").mapInArrow(_counted, "h long, form int, n long").groupBy("h").agg(F.max("form").alias("form"), F.sum("n").alias("n"))
    return written(counts, "counts")


def vocabulary(counts: DataFrame) -> Vocabulary:
    """All words of at least some count, as low as SENT words allow."""
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    least, words = None, 0
    for r in sizes:
        words += r["words"]
        if words > SENT:
            break
        least = r["least"]
    known = counts.where((F.col("h") == END) | (F.lit(False) if least is None else F.col("n") >= least)).toArrow()
    forms, form_words = np.zeros(FORMS, np.int64), np.zeros(FORMS, np.int64)
    for r in counts.groupBy("form").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        forms[r["form"]], form_words[r["form"]] = r["n"], r["words"]
    columns = (known.column(c).to_numpy() for c in ("h", "form", "n"))
    h, k, n = columns
    return Vocabulary(h.astype(np.int64).view(np.uint64), k, n, forms, form_words)


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, hashes, forms, first token of each) of about so many bytes of text at a time."""
    held: list[tuple] = []
    size = 0

    def joined():
        shifts = np.cumsum([0, *(len(h) for _, h, _, _ in held)])
        first = np.concatenate([f[:-1] + s for (_, _, _, f), s in zip(held, shifts)] + [shifts[-1:]])
        return [d for ids, *_ in held for d in ids], np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held]), first

    for batch in batches:
        for part, data, offsets in blocks(batch):
            ids = part.column("doc_id").to_pylist()
            held.append((ids, *tokens(data, offsets)))
            size += len(data)
            if size >= most:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def train(docs: DataFrame, words: Vocabulary) -> np.ndarray:
    """Parameters learned from all of docs, each once."""
    flat = words.start
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(words)
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast(flat)

        def learn(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            v = known.value
            trainer = gru.Trainer(v.shape, sent.value, rate=gru.RATE / (1 + turn))
            for _, h, forms, first in _gathered(batches, TRAIN_BYTES):
                stretches = np.unique(np.concatenate([first, *(np.arange(a, b, STRETCH) for a, b in zip(first, first[1:]) if b - a > STRETCH)]))
                trainer.take(*v.encoded(v.found(h), forms), stretches, v.begin)
            yield pa.RecordBatch.from_arrays([pa.array([trainer.seen]), pa.array([trainer.flat.tobytes()])], ["seen", "flat"])

        share = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == turn).select("doc_id", "text")
        learned = share.mapInArrow(learn, "seen long, flat binary").rdd
        seen, total = learned.map(lambda r: (r["seen"], np.frombuffer(r["flat"], np.float32) * np.float64(r["seen"]))).treeAggregate((0, 0.0), _add, _add)
        if seen:
            flat = (total / seen).astype(np.float32)
    return flat


def _add(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1]


def scored(docs: DataFrame, counts: DataFrame, words: Vocabulary, flat: np.ndarray) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row of docs (doc_id long, text string, ...)."""
    sent = docs.sparkSession.sparkContext.broadcast((words, flat))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = sent.value
        row = TaskContext.get().partitionId() << 33
        base_divisor = np.log10(v.total + 0.5 * (v.distinct + 1))
        log_count, log_divisor = np.log10(v.counts + 0.5), np.log10(v.divisor)
        for ids, h, forms, first in _gathered(batches, SCORE_BYTES):
            rows = v.found(h)
            symbols, classes, own = v.encoded(rows, forms)
            model = gru.score(v.shape, p, symbols, classes, own, first, v.begin) / np.log(10)
            rare = rows < 0
            c = np.where(rare, 0.0, log_count[rows]) if len(log_count) else np.zeros(len(rows))
            model += np.where(classes < CLASSES, 0.0, c - log_divisor[forms])
            sums = [np.add.reduceat(x, first[:-1]) for x in (c - base_divisor, model, (~rare).astype(np.int64))]
            at = np.flatnonzero(rare)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, first).astype(np.int32)), pa.array(h[at].view(np.int64)))
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(n)), pa.array(ids, pa.int64()), pa.array(np.diff(first)), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1]), lists],
                ["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "rare"],
            )
            row += n

    fields = "row long, doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<long>"
    partly = written(docs.select("doc_id", "text").mapInArrow(score, fields), "scored")
    rare = partly.select("row", F.explode("rare").alias("h")).join(counts.select("h", "n"), "h", "left")
    rest = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.count("n").alias("found"))
    out = partly.drop("rare").join(rest, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"))


def language_scores(docs: DataFrame, skip: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs (doc_id long, text string, ...).

    Tokens are words between white space, A-Z lower-cased, and an end. Scores are log10 probabilities of whole texts:
    base_score of independent words, score of the network. skip: rows not to learn from (as held_out by default).
    Null and empty texts have the end alone. With nothing to learn from, all words are unknown, one for all. Rows that
    repeat a doc_id each get a row and count each; an empty table gives none. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    skip = held_out() if skip is None else skip
    learned = docs.where(~skip)
    counts = count_words(learned)
    words = vocabulary(counts)
    flat = train(learned, words)
    out = scored(docs, counts, words, flat)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(words.total).cast("long").alias("train_tokens"), "base_score", "score")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(read(spark, sf_dir, "documents"))
