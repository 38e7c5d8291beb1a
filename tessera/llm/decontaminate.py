"""Benchmark decontamination with a distributed positional inverted index.

Tasks index the documents in segments, once: for each word that a test item may hold (told by a bitmap of fixed size)
the places where it stands, stored as a written table of postings. Their counts over all segments give each term's
frequency. Items are cut into pieces of bounded length, and a window of an item is looked for from its rarest term:
a segment takes that term's places, moves them to where the window would begin, and keeps those that also lie in the
moved places of the next rarest term, and so on; what survives all terms is an exact occurrence. All windows of a slice
of pieces that a segment can hold are intersected together, one rank of rarity at a time. Proximity matches come from
the same lists: places of the rarest term that have each other term of the window at most `within` words away.

Slices of pieces, of a bounded number of words, are what tasks are sent; more items mean more slices over one index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import PLAIN, bitmap, blocks, bounded_batches, find_words, may_hold, read, utf8, word_hashes, written

WINDOW = 10
#: Words around the rarest term's place in which a proximity match has all terms of a window.
WITHIN = 12
SEGMENT_BYTES = 8 << 20
#: Words of the pieces that tasks are sent at once, about, and of one piece at most.
SLICE_WORDS, PIECE_WORDS = 1 << 20, 4096
#: Candidate places that a task holds at once.
PAIRS = 1 << 20
#: Bits of the bitmap of the items' words: 2 MB, whatever the items hold.
TERM_BITS = 1 << 24
#: Places in a segment; a term's number and a place make one key.
PLACE_BITS = 32

SEGMENT = "segment long, doc_ids array<long>, text_hashes array<long>, first_word array<long>, terms binary, counts array<long>, postings binary"
HITS = "segment long, ordinal int, doc_id long, text_hash long, n_words long, hit_words array<int>, items array<string>, near_items array<string>"
PIECE = "item_id string, width int, words binary"


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each text)."""
    data, offsets = utf8(texts)
    low, starts, ends, first = find_words(data, offsets, PLAIN)
    return word_hashes(low, starts, ends), first


def _pieces(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Items as pieces of at most PIECE_WORDS words; a piece overlaps the next, so each window lies in one."""
    for batch in batches:
        rows = []
        for name, text in zip(batch.column("item_id").to_pylist(), batch.column("text")):
            words, _ = text_words(pa.array([text.as_py()], pa.string()))
            width = min(window, len(words))
            step = max(PIECE_WORDS, 2 * window) - width + 1
            for at in range(0, len(words) - width + 1 if width else 0, step):
                rows.append((name, width, words[at : at + step + width - 1].tobytes()))
        columns = list(zip(*rows)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.binary()))], ["item_id", "width", "words"])


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in batch.column("words"):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(words.as_py(), np.int64)))], ["term"])


class Windows:
    """The windows of a slice of pieces: terms as numbers in the sorted vocabulary, rarest first with their offsets."""

    def __init__(self, rows: list, vocabulary: np.ndarray, frequency: np.ndarray):
        self.vocabulary = vocabulary
        names = sorted({r["item_id"] for r in rows if r["item_id"] is not None})
        number = {n: k for k, n in enumerate(names)}
        self.names = names
        self.groups = []  # by width: (item of each window, terms, offsets), rarest first
        for width in sorted({r["width"] for r in rows}):
            items, terms = [], []
            for r in rows:
                if r["width"] == width:
                    w = np.searchsorted(vocabulary, np.frombuffer(r["words"], np.uint64))
                    terms.append(np.lib.stride_tricks.sliding_window_view(w, width))
                    items.append(np.full(len(terms[-1]), number.get(r["item_id"], -1)))
            terms, items = np.concatenate(terms).astype(np.int32), np.concatenate(items)
            live = (frequency[terms] > 0).all(1)  # others occur nowhere
            terms, items = terms[live], items[live]
            both, at = np.unique(np.column_stack((items, terms)), axis=0, return_index=True)  # windows that an item repeats
            terms, items = terms[at], items[at]
            offsets = np.argsort(frequency[terms], axis=1, kind="stable").astype(np.int32)
            self.groups.append((items, np.take_along_axis(terms, offsets, 1), offsets))


def _index(batches: Iterator[pa.RecordBatch], wanted: np.ndarray, gap: int) -> Iterator[pa.RecordBatch]:
    """Segments. Places count words through a segment, with a gap between documents that no match bridges."""
    number, compress = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=1).compress
    held: list[tuple] = []
    size = 0

    def segment() -> pa.RecordBatch:
        doc_ids, text_hashes = ([x for row in held for x in row[k].to_pylist()] for k in (0, 1))
        n_words = np.concatenate([np.diff(first) for *_, first in held])
        begin = np.zeros(len(doc_ids) + 1, np.int64)
        np.cumsum(n_words + gap, out=begin[1:])
        words = np.concatenate([w for *_, w, _, _ in held])
        shift, places = 0, []
        for *_, at, first in held:
            doc = np.searchsorted(first, at, "right") - 1
            places.append(at + shift + doc * gap)
            shift += int(first[-1]) + (len(first) - 1) * gap
        places = np.concatenate(places)
        order = np.argsort(words, kind="stable")
        words, places = words[order], places[order].astype(np.int64)
        names, starts, counts = np.unique(words, return_index=True, return_counts=True)
        deltas = np.diff(places, prepend=0)
        deltas[starts] = places[starts]  # each list starts from 0
        small = np.minimum(deltas, 255).astype(np.uint8)
        packed = compress(small.tobytes() + deltas[deltas >= 255].astype("<u4").tobytes())
        columns = [pa.array([number], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([text_hashes], pa.list_(pa.int64())), pa.array([begin], pa.list_(pa.int64())), pa.array([names.tobytes()], pa.binary()), pa.array([counts], pa.list_(pa.int64())), pa.array([packed], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["segment", "doc_ids", "text_hashes", "first_word", "terms", "counts", "postings"])

    for batch in batches:
        for part, data, offsets in blocks(batch):
            low, starts, ends, first = find_words(data, offsets, PLAIN)
            h = word_hashes(low, starts, ends)
            at = np.flatnonzero(may_hold(wanted, h))
            held.append((part.column("doc_id"), part.column("text_hash"), h[at], at, first))
            size += len(data) + 64 * part.num_rows
            if size >= SEGMENT_BYTES:
                yield segment()
                number, held, size = number + 1, [], 0
    if held:
        yield segment()


class Postings:
    """The places of each term in a segment, as sorted keys (term, place)."""

    def __init__(self, row: dict, vocabulary: np.ndarray):
        counts = np.array(row["counts"], np.int64)
        raw = zstandard.ZstdDecompressor().decompress(row["postings"])
        small = np.frombuffer(raw, np.uint8, int(counts.sum()))
        deltas = small.astype(np.int64)
        deltas[small == 255] = np.frombuffer(raw, "<u4", offset=len(small))
        places = np.cumsum(deltas)
        ends = np.cumsum(counts)
        starts = ends - counts
        base = np.where(starts > 0, places[np.maximum(starts - 1, 0)], 0) if len(places) else starts
        places -= np.repeat(base, counts)
        words = np.frombuffer(row["terms"], np.uint64)
        at = np.searchsorted(vocabulary, words)
        known = vocabulary[np.minimum(at, len(vocabulary) - 1)] == words if len(vocabulary) else np.zeros(len(words), bool)
        self.counts = np.zeros(len(vocabulary) + 1, np.int64)
        self.counts[at[known]] = counts[known]
        self.starts = np.cumsum(self.counts) - self.counts
        kept = np.repeat(known, counts)
        # The words are sorted as the vocabulary is, so keys are too.
        self.keys = (np.repeat(at[known], counts[known]) << PLACE_BITS) + places[kept]

    def pairs(self, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, place) for each place of each row's term, at most PAIRS or one row's at once."""
        n = self.counts[terms]
        edges = np.append(0, np.cumsum(n))
        at = 0
        while at < len(terms):
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + PAIRS, "right")) - 1)
            rows = np.repeat(np.arange(at, to), n[at:to])
            inside = np.arange(len(rows)) - np.repeat(edges[at:to] - edges[at], n[at:to])
            yield rows, self.keys[self.starts[terms[rows]] + inside] & ((1 << PLACE_BITS) - 1)
            at = to

    def has(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether each term stands at each place."""
        asked = (terms.astype(np.int64) << PLACE_BITS) + places
        return (places >= 0) & (np.take(self.keys, np.searchsorted(self.keys, asked), mode="clip") == asked)

    def distance(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """From each place to the nearest place of each term, which stands somewhere."""
        asked = (terms.astype(np.int64) << PLACE_BITS) + places
        at = np.searchsorted(self.keys, asked)
        first, last = self.starts[terms], self.starts[terms] + self.counts[terms] - 1
        left, right = self.keys[np.clip(at - 1, first, last)], self.keys[np.clip(at, first, last)]
        return np.minimum(np.abs(asked - left), np.abs(right - asked))


def exact_matches(postings: Postings, terms: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, first place) of each occurrence of windows whose terms all stand in the segment, rarest first."""
    for rows, places in postings.pairs(terms[:, 0]):
        starts = places - offsets[rows, 0]
        for k in range(1, terms.shape[1]):
            keep = postings.has(terms[rows, k], starts + offsets[rows, k])
            rows, starts = rows[keep], starts[keep]
            if not len(rows):
                break
        yield rows, starts


def near_matches(postings: Postings, terms: np.ndarray, within: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, place) of places of a window's rarest term that have all its other terms at most so many words away."""
    for rows, places in postings.pairs(terms[:, 0]):
        for k in range(1, terms.shape[1]):
            keep = postings.distance(terms[rows, k], places) <= within
            rows, places = rows[keep], places[keep]
            if not len(rows):
                break
        yield rows, places


def _search(batches: Iterator[pa.RecordBatch], windows: Windows, within: int | None, gap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            postings, first = Postings(row, windows.vocabulary), np.array(row["first_word"], np.int64)
            n = len(row["doc_ids"])
            hits, named, near = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
            for items, terms, offsets in windows.groups:
                held = np.flatnonzero((postings.counts[terms] > 0).all(1))
                items, terms, offsets = items[held], terms[held], offsets[held]
                if not len(terms):
                    continue
                for rows, starts in exact_matches(postings, terms, offsets):
                    hits.append(np.unique((starts[:, None] + np.arange(terms.shape[1])).ravel()))
                    named.append(np.unique(np.column_stack((np.searchsorted(first, starts, "right") - 1, items[rows])), axis=0))
                for rows, places in near_matches(postings, terms, within) if within is not None else ():
                    near.append(np.unique(np.column_stack((np.searchsorted(first, places, "right") - 1, items[rows])), axis=0))
            places = np.unique(np.concatenate(hits))
            doc = np.searchsorted(first, places, "right") - 1
            words = (places - first[doc]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pa.array(words))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["segment"]] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(row["text_hashes"], pa.int64()), pa.array(np.diff(first) - gap), lists, *(_names(x, n, windows.names) for x in (named, near))],
                ["segment", "ordinal", "doc_id", "text_hash", "n_words", "hit_words", "items", "near_items"],
            )


def _names(pairs: list[np.ndarray], n: int, names: list[str]) -> pa.Array:
    """The names of the items of each document; items without one have number -1."""
    found = np.unique(np.concatenate(pairs), axis=0)
    found = found[found[:, 1] >= 0]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(found[:, 0], np.arange(n + 1)).astype(np.int32)), pa.array([names[k] for k in found[:, 1]], pa.string()))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, within: int | None = None) -> DataFrame:
    """(doc_id, text_hash, n_words, hit_words, items, near_items) of each row of docs (doc_id long, text string, ...).

    items has item_id and text. Words are runs of digits, letters a-z (A-Z are lower-cased) and characters beyond
    ASCII, told apart by 64-bit hashes. hit_words are the places of words inside any occurrence of a window of an
    item; items are the ids (strings, sorted, distinct) of those with an occurring window; near_items those with a
    proximity match: a place of a window's rarest term that has each other term of the window at most `within` words
    away, in any order (none where within is not given). An item of fewer words than a window is one window; null and
    empty texts have no words. An item without an id counts in hit_words and is not named. Rows that repeat a doc_id
    each get a row, told apart by text_hash (xxhash64 of the text). Empty tables of either kind give no hits. Items of any length and number are matched whole.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    gap = max(window, within or 0) + 1
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    pieces = written(items.mapInArrow(lambda it: _pieces(it, window), PIECE), "pieces")
    size = pieces.agg(F.sum(F.length("words"))).first()[0] or 0
    slices = max(1, -(-size // (8 * SLICE_WORDS)))
    terms = pieces.mapInArrow(_words_of, "term long")
    sent = spark.sparkContext.broadcast(bitmap(terms, TERM_BITS) if size else np.zeros(TERM_BITS // 64, np.uint64))
    index = written(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(lambda it: _index(it, sent.value, gap), SEGMENT), "postings")
    counts = written(index.select("terms", "counts").mapInArrow(_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")), "frequencies")
    found = None
    for k in range(slices):
        mine = pieces.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(slices)) == k)
        asked = mine.mapInArrow(_words_of, "term long").distinct().join(counts, "term", "left").toArrow()
        order = np.argsort(asked.column("term").to_numpy().view(np.uint64))
        vocabulary = asked.column("term").to_numpy().view(np.uint64)[order]
        frequency = asked.column("n").fill_null(0).to_numpy()[order]
        windows = spark.sparkContext.broadcast(Windows(mine.collect(), vocabulary, frequency))
        hits = index.mapInArrow(lambda it, w=windows: _search(it, w.value, within, gap), HITS)
        found = hits if found is None else found.union(hits)
    if slices > 1:
        lists = ("hit_words", "items", "near_items")
        found = found.groupBy("segment", "ordinal", "doc_id", "text_hash", "n_words").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists])
    return found.drop("segment", "ordinal")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for terms, counts in zip(batch.column("terms"), batch.column("counts")):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms.as_py(), np.int64)), pa.array(counts.values)], ["term", "n"])


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
asked AS (
  SELECT item_id, least(len(w), {WINDOW}) AS n, unnest(list_transform(range(1, len(w) - least(len(w), {WINDOW}) + 2), lambda i: array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' '))) AS x
  FROM b WHERE len(w) > 0),
widths AS (SELECT DISTINCT n FROM asked),
places AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, widths WHERE len(w) >= n),
hits AS (
  SELECT p.doc_id, p.i, p.n, a.item_id FROM places p JOIN (SELECT DISTINCT item_id, n, x FROM asked) a
  ON a.n = p.n AND a.x = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""
