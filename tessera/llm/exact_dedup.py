"""Exact de-duplication by a distributed content sort; DataFrame functions only.

Splitters sampled by Spark deal ranges of the normalised texts out to partitions, Spark's external sort puts equal
texts side by side, and each row's full text is compared with its neighbour's: a run of equal rows is one group, whose
first row stays. The order is that of the first PREFIX characters, then of a hash, then of the whole text: what Spark
samples for splitters is small however long the texts are, and many texts with one beginning still lie in many ranges.

A text that makes up much of the table would be one run in one range. Counts of hashes, folded within map tasks, name
the few such texts (their number has a bound), and a salt of the doc_id cuts their runs into pieces that lie in ranges
of their own; what the pieces found is put together for these texts alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import read, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pieces that a text of very many copies is cut into.
SALTS = 64
#: A text has very many copies if it has more than this part of the rows that a partition holds on average.
SHARE = 0.25
PREFIX = 64


def lower_ascii(text: Column | str) -> Column:
    """A-Z lower-cased, all else as it is; null counts as empty. A text of single bytes takes the quick way."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digest(text: Column) -> Column:
    """Hexadecimal SHA-256. It is never null; said so, the join adds no filter that would compute it twice."""
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def exact_duplicates(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, text_hash) of each row of docs (doc_id long, text string, ...).

    Equal are texts identical after lower-casing A-Z; null counts as empty, and empty texts equal each other. Of a
    group, one row with the smallest (or "largest") doc_id stays; of rows that repeat that doc_id, one, of null ones
    and empty ones the null one last. A null doc_id stays only where the whole group has none. Texts of any length are
    compared whole. text_hash is xxhash64 of the text as it is. An empty table gives no rows. Other columns are not
    read.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), lower_ascii("text").alias("norm")).withColumn("hash", F.xxhash64("norm"))
    counts = rows.groupBy("hash").agg(F.count("*").alias("n"))
    # Fewer than n / SHARE texts can have so many rows.
    many = written(counts, "counts")
    total = many.agg(F.sum("n")).first()[0] or 0
    hot = many.where(F.col("n") > SHARE * total / n).where("n > 1").select("hash", F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(-1).cast("long"))
    keyed = rows.join(F.broadcast(hot), "hash", "left").select("doc_id", "text_hash", "norm", "hash", F.substring("norm", 1, PREFIX).alias("head"), salt.alias("salt"))
    order = [F.desc("doc_id") if keep == "largest" else F.asc_nulls_last("doc_id"), F.asc("text_hash")]
    run = Window.partitionBy("head", "hash", "norm", "salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = keyed.repartitionByRange(n, "head", "hash", "salt").select(
        "doc_id",
        "text_hash",
        F.first("doc_id").over(run).alias("keep_id"),
        F.count("*").over(run).alias("group_size"),
        (place == 1).alias("kept"),
        (F.col("salt") >= 0).alias("cut"),
        digest(F.col("norm")).alias("text_sha256"),
    )
    found = written(found, "groups")
    pick = {"smallest": F.min, "largest": F.max}[keep]
    whole = found.where("cut and kept").groupBy("text_sha256").agg(pick("keep_id").alias("k"), F.sum("group_size").alias("size"), F.lit(True).alias("joined"))
    # Rows of one doc_id lie in one piece, so the piece that has the chosen doc_id has the one row that stays.
    out = found.join(F.broadcast(whole), "text_sha256", "left")
    chosen = F.when(F.col("joined"), F.col("k")).otherwise(F.col("keep_id"))
    stays = F.col("kept") & F.when(F.col("joined"), F.col("doc_id").eqNullSafe(F.col("k"))).otherwise(F.lit(True))
    return out.select("doc_id", chosen.alias("keep_id"), F.coalesce("size", "group_size").alias("group_size"), stays.alias("kept"), "text_sha256", "text_hash")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(read(spark, sf_dir, "documents"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM d
"""
