"""N-gram Jaccard join: sets of word n-grams that are alike, found in size-banded tiles and told apart by bitmaps first.

Two sets can be as like as asked only if their sizes lie in the same or in neighbouring bands, and if they share one of
the few shingles that come first in both by any common order (a set of n leaves out none that it could do without: n -
ceil(0.85 n) + 1 of them). The order may be any that depends on the shingle alone. Here those come first that are known
to occur in one document only: a third of all shingles, told by their hash, is counted over all documents, and a bitmap
of fixed size tells which of these may occur twice. They fill most documents' share, and as they can bring nobody
together, they are dropped. A tile is one of the others and a pair of neighbouring bands; no link lies outside all
tiles. Tiles with the same members are one.

Each set has a bitmap, as wide as its size asks for, whose bits are the parity of the shingles that fall on them. Sets
that differ in d shingles differ in at most d bits, so the bits that differ bound the overlap from above, and most
pairs are dropped by counting bits. What is left is decided by intersection of the sorted sets.

Equal sets are one node. In a tile, members are compared with two pivots first; then only members outside its largest
component with the members of others. So copies cost one comparison each, and no link that could join two components
is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.near_dedup import SET_BITS, SET_LONGS, across, confirm, confirming, differ, labelled, linked, may_be_in, spread, text_sets
from tessera.llm.shared import bitmap, blocks, bounded_batches, drop, may_hold, mix, read, written

SHINGLE, PERCENT = 4, 85
#: One of so many shingles is counted.
COUNTED = 3
#: Bits of the bitmap of counted shingles that occur more than once: 8 MB, whatever the corpus holds.
COMMON_BITS = 1 << 26
#: Widest bitmap of a set, in bits; the narrowest has SET_BITS.
WIDEST = 1 << 15
#: Bits of the filter of shingles that several sets share: 4 MB as it is sent.
FILTER_BITS = 1 << 24

SIGNED = "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, parity array<long>, wide binary, ahead array<long>"
_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("parity", pa.list_(pa.int64())), ("wide", pa.binary()), ("ahead", pa.list_(pa.int64()))])


def is_counted(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(COUNTED) == 0


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of n must share with any that is as like as asked."""
    return (percent * n + 99) // 100


def parities(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(bitmaps of SET_BITS folded from wider ones, the wider one of each set that has more than SET_BITS / 2 shingles).

    Bitmaps of powers of two fold by parity, so any two can be compared in the width of the narrower.
    """
    folded, wide = np.zeros((len(first) - 1, SET_BITS), np.uint8), []
    for i, (at, to) in enumerate(zip(first[:-1], first[1:])):
        bits = min(WIDEST, max(SET_BITS, 1 << int(2 * (to - at) - 1).bit_length())) if to > at else SET_BITS
        odd = (np.bincount((hashes[at:to] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
        folded[i] = np.bitwise_xor.reduce(odd.reshape(-1, SET_BITS), axis=0)
        wide.append(np.packbits(odd).tobytes() if bits > SET_BITS else b"")
    return np.packbits(folded, axis=1).view(np.int64), wide


def first_by(hashes: np.ndarray, first: np.ndarray, common: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(of the shingles that come first in each set, those that another set may hold, where each set's begin).

    Counted shingles of one document come first, then those not counted, then the other counted ones; each by hash.
    """
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    rank = np.where(is_counted(hashes), np.where(may_hold(common, hashes), 2, 0), 1).astype(np.uint8)
    order = np.lexsort((hashes, rank, text))
    take = np.where(sizes > 0, sizes - needed(sizes, percent) + 1, 0)
    keep = (np.arange(len(hashes)) - np.repeat(first[:-1], sizes) < np.repeat(take, sizes)) & (rank[order] > 0)
    return hashes[order][keep], np.concatenate(([0], np.cumsum(np.bincount(text[keep], minlength=len(sizes)))))


def _counted(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in blocks(batch):
                found = text_sets(data, offsets, k)[0]
                yield pa.RecordBatch.from_arrays([pa.array(found[is_counted(found)].view(np.int64))], ["shingle"])

    return run


def common_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """A bitmap of the counted shingles that occur in more than one row of docs (text)."""
    counts = docs.select("text").mapInArrow(_counted(k), "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    return bitmap(counts.where("n > 1").select("shingle"), COMMON_BITS)


def _sign(k: int, percent: int, common: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch):
                h, first = text_sets(data, offsets, k)
                n = np.diff(first)
                full = np.flatnonzero(n)
                h1, h2 = (np.zeros(len(n), np.uint64) for _ in range(2))
                if len(full):
                    h1[full], h2[full] = (np.add.reduceat(mix(h ^ np.uint64(salt)), first[:-1][full]) for salt in (0, 0x5851F42D4C957F2D))
                parity, wide = parities(h, first)
                ahead, begins = first_by(h, first, common.value, percent)
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x)) for at, x in ((np.arange(len(n) + 1) * SET_LONGS, parity.ravel()), (begins, ahead.view(np.int64)))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists[0], pa.array(wide, pa.binary()), lists[1]], schema=_SIGNED)

    return run


def most_apart(n_a, n_b, percent: int):
    """Shingles in which two sets of these sizes differ at most if they are as like as asked."""
    both = n_a + n_b
    return both - 2 * ((percent * both + 99 + percent) // (100 + percent))


def _most_apart(percent: int) -> Column:
    return F.expr(f"n + p_n - 2 * (({percent} * (n + p_n) + {99 + percent}) div {100 + percent})")


def _bounded(percent: int):
    """Of pairs with sizes and bitmaps, those whose bits that differ still allow enough overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n_a, n_b, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "wide_a", "wide_b"))):
                if x and y:
                    p, q = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
                    differ_in = int(np.bitwise_count(p ^ np.bitwise_xor.reduce(q.reshape(-1, len(p)), axis=0)).sum())
                    keep.append(differ_in <= most_apart(n_a, n_b, percent))
                else:  # SET_BITS have told already
                    keep.append(True)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _may_be_shared(members: DataFrame, shared: DataFrame) -> DataFrame:
    """The members (shingle, ...) whose shingle may be in shared (shingle), by a bitmap of fixed size."""
    bit = F.pmod(F.xxhash64("shingle"), F.lit(FILTER_BITS))
    words = shared.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("set_bits"))
    tested = members.withColumn("bit", bit).join(F.broadcast(words), F.expr("bit div 64 = word"))
    return tested.where("getbit(set_bits, cast(bit % 64 as int)) = 1").select(members.columns)


def tiles(nodes: DataFrame, percent: int) -> DataFrame:
    """(bucket, node) of each tile of two sets or more, from nodes (node, n, ahead); tiles with the same members are one."""
    members = nodes.select("node", "n", F.explode("ahead").alias("shingle"))
    shared = written(members.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("shingle"), "shared", True)
    met_again = _may_be_shared(members, shared).join(shared, "shingle")
    # Sizes whose ratio is as asked lie one band apart at most; the band is wider by a hair than the ratio.
    band = F.floor(F.log(F.col("n")) / (math.log(100 / percent) + 1e-9))
    placed = met_again.withColumn("band", F.explode(F.array(band, band - 1))).select(F.xxhash64("shingle", "band").alias("bucket"), "node")
    placed = written(placed, "placed", True)
    sizes = placed.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("who"), F.bit_xor(F.xxhash64(F.col("node") + 1)).alias("twice"))
    one = sizes.where("low < high").groupBy("low", "high", "size", "who", "twice").agg(F.min("bucket").alias("bucket"))
    out = written(placed.join(one.select("bucket", "low", "high"), "bucket"), "tiles")
    drop(shared, placed)
    return out


def jaccard_classes(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash) of each row of docs (doc_id long, text string, ...).

    Linked are documents whose sets of k-word shingles have 100 * intersection >= percent * union; a component is named
    after its smallest doc_id. Null and empty texts and texts of white space have no shingles and are linked with
    nothing; a text of fewer than k words is one shingle. Rows are documents of their own: those that repeat a doc_id
    are linked by their texts alone, and each has a row in the result. A null doc_id stays alone, with a null
    component_id. An empty table gives no rows. Columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    signed = rows.mapInArrow(_sign(k, percent, spark.sparkContext.broadcast(common_shingles(docs, k))), SIGNED).withColumn("row", F.monotonically_increasing_id())
    signed = written(signed, "signed")
    nodes = _nodes(signed.where("n_shingles > 0 and doc_id is not null"))
    named = nodes.select("node", "row")
    buckets = tiles(signed.join(named, "row").select("node", F.col("n_shingles").alias("n"), "ahead"), percent)
    involved = nodes.join(buckets.select("node").distinct(), "node", "left_semi")
    involved = written(signed.drop("ahead").join(involved.select("row", "node"), "row"), "involved")
    where = involved.select("doc_id", "text_hash", "node")
    texts = may_be_in(rows, where).join(where, ["doc_id", "text_hash"])
    texts = written(texts.select("node", "text").dropDuplicates(["node"]), "texts")
    marks = written(involved.select("node", F.col("n_shingles").alias("n"), *spread("parity", "f", SET_LONGS)), "marks")
    wide = involved.select("node", F.col("n_shingles").alias("n"), "wide")

    def bounded(pairs: DataFrame) -> DataFrame:
        a, b = (wide.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("wide").alias(f"wide_{x}")) for x in "ab")
        return pairs.join(b, "b").join(a, "a").mapInArrow(_bounded(percent), "a long, b long")

    alike = (F.least("n", "p_n") * 100 >= F.greatest("n", "p_n") * percent) & (differ("p_f", "f", SET_LONGS) <= _most_apart(percent))
    other = marks.select(*[F.col(c).alias(f"p_{c}") for c in marks.columns])
    pivots = buckets.select("node", F.explode(F.array("low", "high")).alias("p_node")).where("node <> p_node").distinct()
    pairs = pivots.join(marks, "node").join(other, "p_node").where(alike).select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")).distinct()
    pairs = written(bounded(pairs), "pairs", True)
    comps = linked(pairs, confirming(texts, lambda it: confirm(it, percent, k)), lambda comps: bounded(across(buckets, marks, comps, alike)))
    drop(buckets, texts, marks, pairs, involved)
    return labelled(signed, nodes, comps).select("doc_id", "n_shingles", "component_id", "text_hash")


def _nodes(full: DataFrame) -> DataFrame:
    """A node for each distinct set: its smallest doc_id with the text_hash and number of a row that has it.

    Nodes are numbered along a sort by doc_id, and written, so a number stays.
    """
    n = int(full.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = full.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_hash", "row")).alias("at")).select("at.*", "h1", "h2")
    order = ["doc_id", "h1", "h2"]
    return written(one.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()), "nodes")


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  WITH RECURSIVE r(id, c) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT l.a, r.c FROM r JOIN links l ON l.b = r.id)
  SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, reach.c AS component_id
FROM sets s JOIN reach ON reach.id = s.doc_id
"""
