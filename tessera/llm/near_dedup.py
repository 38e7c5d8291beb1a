"""MinHash near-duplicate detection with odd sketches.

Each document's set of word shingles gets 128 MinHash samples. 125 of them make 25 bands of 5 rows, which
propose candidates; all 128 are folded into a parity bitmap of 512 bits (an odd sketch). The number of bits in
which two bitmaps differ tells how many samples differ, which is precise where sets are alike, so most false
candidates go without a look at their texts. What is left is confirmed on the full sets of shingles.

Documents with equal sets are one class before any pairing. In a bucket, members are first compared with two
pivots; then the components are known for most, and only members outside a bucket's largest component are
compared with the members of other components. So a group of n alike texts costs about n comparisons, and no
candidate pair that could still join two components is left out. For this last step, a second bitmap of 1024 bits
folds whole sets of shingles instead of samples: two sets that differ in d shingles differ in at most d bits, so it
tells texts that are alike but not enough.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.components import components, met
from tessera.llm.shared import SPACED, blocks, bounded_batches, distinct_in_texts, drop, find_words, mix, read, shingle_hashes, word_hashes, written

SHINGLE = 5
BANDS, ROWS, SAMPLES, BITS = 25, 5, 128, 512
LONGS = BITS // 64
#: Bits of the bitmap of a whole set.
SET_BITS = 1024
SET_LONGS = SET_BITS // 64

_rng = np.random.default_rng(20_240)
_FACTORS = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)

_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))])
SIGNED = "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, bands array<long>, sketch array<long>, parity array<long>"


def text_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of the k-word shingles of each text one after another, where each text's begin)."""
    low, starts, ends, first = find_words(data, offsets, SPACED)
    return distinct_in_texts(*shingle_hashes(word_hashes(low, starts, ends), first, k))


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SAMPLES minima of each set that is not empty, as 32-bit values."""
    out = np.empty((SAMPLES, len(first) - 1), np.uint32)
    buf, top = np.empty(len(hashes), np.uint64), np.empty(len(hashes), np.uint32)
    for i in range(SAMPLES):
        np.multiply(hashes, _FACTORS[i], out=buf)
        np.add(buf, _SHIFTS[i], out=buf)
        np.right_shift(buf, np.uint64(32), out=buf)
        top[:] = buf
        out[i] = np.minimum.reduceat(top, first[:-1])
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Bitmaps (a row of LONGS for each set): a bit is the parity of the samples that fall on it."""
    n = samples.shape[1]
    keys = mix(samples.astype(np.uint64) ^ (np.arange(SAMPLES, dtype=np.uint64)[:, None] << np.uint64(32)))
    bit = keys % np.uint64(BITS)
    out = np.zeros((n, LONGS), np.uint64)
    at = np.broadcast_to(np.arange(n), bit.shape)
    np.bitwise_xor.at(out, (at.ravel(), (bit >> np.uint64(6)).ravel().astype(np.int64)), (np.uint64(1) << (bit & np.uint64(63))).ravel())
    return out.view(np.int64)


def set_parities(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bitmaps (a row of SET_LONGS for each set): a bit is the parity of the shingles that fall on it."""
    n = len(first) - 1
    at = np.repeat(np.arange(n), np.diff(first)) * SET_BITS + (hashes & np.uint64(SET_BITS - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * SET_BITS) & 1).astype(np.uint8).reshape(n, SET_BITS)
    return np.packbits(odd, axis=1).view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    out = np.empty((samples.shape[1], BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(samples.shape[1], b + 1, np.uint64)
        for r in range(ROWS):
            key = mix(key * np.uint64(31) + samples[b * ROWS + r])
        out[:, b] = key
    return out.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in blocks(batch):
            h, first = text_sets(data, offsets)
            n = np.diff(first)
            full = np.flatnonzero(n)
            h1, h2 = (np.zeros(len(n), np.uint64) for _ in range(2))
            bands, sketch, parity = (np.zeros((len(n), k), np.int64) for k in (BANDS, LONGS, SET_LONGS))
            if len(full):
                at = np.append(first[:-1][full], len(h))
                h1[full], h2[full] = np.add.reduceat(mix(h), at[:-1]), np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), at[:-1])
                s = signatures(h, at)
                bands[full], sketch[full], parity[full] = band_keys(s), odd_sketches(s), set_parities(h, at)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (bands, sketch, parity)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), *lists], schema=_SIGNED)


def confirm(batches: Iterator[pa.RecordBatch], percent: int, k: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    """Of pairs with both texts, those whose full sets are alike, by intersection of the sorted sets."""
    for batch in batches:
        for part, data, offsets in blocks(batch, "text_a"):
            x, fx = text_sets(data, offsets, k)
            for sub, data_b, offsets_b in blocks(part.append_column("row", pa.array(range(part.num_rows))), "text_b"):
                y, fy = text_sets(data_b, offsets_b, k)
                keep = []
                for i, r in enumerate(sub.column("row").to_pylist()):
                    p, q = x[fx[r] : fx[r + 1]], y[fy[i] : fy[i + 1]]
                    both = np.concatenate((p, q))
                    both.sort()
                    inter = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * inter >= percent * (len(both) - inter))
                yield sub.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def differ(a: str, b: str, longs: int) -> Column:
    """Bits in which two bitmaps differ."""
    return sum((F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(longs)), F.lit(0))


def _most_set_bits(n_a: Column, n_b: Column, percent: int) -> Column:
    """Bits of set bitmaps that differ at most for sets as like as asked.

    Such sets differ in d shingles at most and so in d bits; where many fall on the same bits, it is the number that
    is expected and 6 standard deviations of room.
    """
    d = (n_a + n_b) * (100 - percent) / (100 + percent)
    return F.least(d, SET_BITS / 2 * (1 - F.exp(-2 * d / SET_BITS)) + 3 * SET_BITS**0.5)


def _most_bits(percent: int) -> int:
    """Bits that differ at most for sets as like as asked, with 5 standard deviations of room for the samples."""
    p = 1 - percent / 100
    wrong = SAMPLES * p + 5 * (SAMPLES * p * (1 - p)) ** 0.5
    return round(BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * wrong)) + 15)


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash, stays) of each row of docs (doc_id long, text string, ...).

    Linked are documents whose shingle sets have 100 * intersection >= percent * union; a component is named
    after its smallest doc_id, which is kept. Null and empty texts and texts of white space have no shingles and
    are linked with nothing. Rows are documents of their own: those that repeat a doc_id are linked by their texts
    alone, so two with unlike texts may lie in different components, and each row has a row in the result, told apart
    by text_hash (xxhash64 of the text). stays is true of one text of each component, one with the smallest doc_id:
    the kept ones but for further unlike texts of that doc_id. A null doc_id stays alone, with a null component_id. An empty table gives no
    rows. Columns besides doc_id and text are not read.
    """
    bounded_batches(docs.sparkSession)
    # A pair of 85 % is missed by all 25 bands with a probability of 4e-7.
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    signed = written(rows.mapInArrow(_sign, SIGNED), "signed")
    classes = _classes(signed.where("n_shingles > 0 and doc_id is not null"))
    members = classes.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    buckets = written(members.join(shared, "bucket"), "buckets")
    involved = written(classes.join(buckets.select("node").distinct(), "node", "left_semi"), "involved")
    named = involved.select("doc_id", "text_hash", "node")
    texts = may_be_in(rows, named).join(named, ["doc_id", "text_hash"])
    texts = written(texts.select("node", "text").dropDuplicates(["node"]), "texts")
    marks = written(involved.select("node", F.col("n_shingles").alias("n"), *spread("sketch", "s", LONGS), *spread("parity", "f", SET_LONGS)), "marks")

    mine = marks.select("node", "n", *[f"s{i}" for i in range(LONGS)])
    other = mine.select(*[F.col(c).alias(f"p_{c}") for c in mine.columns])
    pivots = buckets.select("node", F.explode(F.array("low", "high")).alias("p_node")).where("node <> p_node").distinct()
    near = (differ("p_s", "s", LONGS) <= _most_bits(percent)) & (F.least("n", "p_n") * 100 >= F.greatest("n", "p_n") * percent)
    pairs = written(pivots.join(mine, "node").join(other, "p_node").where(near).select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")).distinct(), "pairs", True)
    alike = (F.least("n", "p_n") * 100 >= F.greatest("n", "p_n") * percent) & (differ("p_f", "f", SET_LONGS) <= _most_set_bits(F.col("n"), F.col("p_n"), percent))
    comps = linked(pairs, confirming(texts, lambda it: confirm(it, percent)), lambda comps: across(buckets, marks, comps, alike))
    drop(buckets, texts, marks, pairs, involved)

    return labelled(signed, classes, comps)


def confirming(texts: DataFrame, check: Callable) -> Callable[[DataFrame], DataFrame]:
    """A function that gives those of pairs (a, b) of nodes whose texts (node, text) pass a check."""

    def confirmed(pairs: DataFrame) -> DataFrame:
        a, b = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        # Texts of the many ends first, so that a pivot's text meets them last; Spark splits its tasks where it has very many.
        return written(pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long"), "confirmed")

    return confirmed


def linked(pairs: DataFrame, confirmed: Callable[[DataFrame], DataFrame], others: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Components (id, component) of nodes, from candidate pairs (a, b) with pivots and what others(components) adds.

    One pair for each member is confirmed first; then only those that could still join two components.
    """
    links = confirmed(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    comps = components(links)
    ca, cb = (comps.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    open_pairs = met(pairs, ca, "a", "b", "left").join(cb, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    links = links.union(confirmed(open_pairs))
    comps = components(links)
    links = links.union(confirmed(others(comps).join(pairs, ["a", "b"], "left_anti")))
    return components(links)


def labelled(signed: DataFrame, classes: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows of signed with their component: classes (node, doc_id, text_hash, h1, h2), comps (id, component).

    Nodes are numbered in the order of their doc_id, so a component's smallest node has its smallest doc_id.
    """
    roots = comps.where("id = component").select("component").join(classes.select(F.col("node").alias("component"), F.struct("doc_id", "text_hash").alias("name")), "component")
    named = met(comps, roots, "component", "id").select(F.col("id").alias("node"), "name")
    sets = classes.join(named, "node", "left").select("h1", "h2", F.coalesce("name", F.struct("doc_id", "text_hash")).alias("first"))
    out = met(signed.where("n_shingles > 0 and doc_id is not null"), sets, "h2", "doc_id", others=["h1"])
    none = signed.where("n_shingles = 0 or doc_id is null").withColumn("first", F.struct("doc_id", "text_hash"))
    kept = F.coalesce(F.col("doc_id") == F.col("first.doc_id"), F.lit(True))
    fields = ["doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), kept.alias("kept"), "text_hash", (kept & (F.col("text_hash") == F.col("first.text_hash"))).alias("stays")]
    return out.select(*fields).union(none.select(*fields))


def _classes(full: DataFrame) -> DataFrame:
    """A node for each distinct set: its smallest doc_id, the text_hash of a row with that, and its signature.

    Copies are folded within map tasks. Nodes are numbered along a sort by doc_id, and written, so a number stays.
    """
    n = int(full.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = full.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch", "parity")])
    order = ["doc_id", "h1", "h2"]
    sets = one.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text_hash").alias("text_hash"), "h1", "h2", "n_shingles", "bands", "sketch", "parity")
    return written(sets.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()), "classes")


def spread(column: str, name: str, longs: int) -> list[Column]:
    return [F.col(column)[i].alias(f"{name}{i}") for i in range(longs)]


#: Bits of the filter below, and so 16 bytes for each 64 of them to broadcast: 4 MB, whatever the tables hold.
FILTER_BITS = 1 << 24


def may_be_in(rows: DataFrame, named: DataFrame) -> DataFrame:
    """The rows whose (doc_id, text_hash) may be in named, by a bitmap of fixed size: a join that follows moves fewer texts."""
    bit = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(FILTER_BITS))
    words = named.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("set_bits"))
    tested = rows.withColumn("bit", bit).join(F.broadcast(words), F.expr("bit div 64 = word"))
    return tested.where("getbit(set_bits, cast(bit % 64 as int)) = 1").select(rows.columns)


#: Members of a bucket outside its largest component that one task compares with the rest of the bucket, about.
APART = 256


def across(buckets: DataFrame, marks: DataFrame, comps: DataFrame, alike: Column) -> DataFrame:
    """Candidate pairs within buckets whose ends lie in different components and are alike by their marks (one end's are
    named p_...)."""
    named = buckets.select("bucket", "node").join(comps, buckets.node == comps.id, "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    sizes = named.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    most = sizes.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("m"), F.count("*").alias("parts"), F.sum("size").alias("all")).where("parts > 1")
    most = most.withColumn("shares", F.ceil((F.col("all") - F.col("m.size")) / APART))
    marked = marks.drop(*[f"s{i}" for i in range(LONGS)])
    named = met(named, most, "bucket", "node").select("bucket", "shares", "node", "component", (F.col("component") != F.col("m.component")).alias("apart")).join(marked, "node")
    named = written(named, "apart")
    # Many members apart are dealt to as many tasks as that takes; all members of the bucket go to each of these.
    few = named.where("apart").withColumn("share", F.pmod(F.xxhash64("node"), F.col("shares")))
    few = few.select(*[F.col(c).alias(c if c in ("bucket", "share") else f"p_{c}") for c in few.columns])
    every = named.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    pairs = few.join(every, ["bucket", "share"]).where((F.col("p_component") != F.col("component")) & (F.col("p_node") != F.col("node")) & alike)
    return pairs.select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")).distinct()


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
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
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, reach.c AS component_id, s.doc_id = reach.c AS kept
FROM sets s JOIN reach ON reach.id = s.doc_id
"""
