"""A corpus cleaning pipeline of the corpus operators, each stage written and read again.

Rejected are documents of low quality, then all but one of each group of equal and of nearly equal texts, then those
that hold a benchmark passage; the rest is packed into sequences. A document is a row: those that repeat a doc_id are
judged by their texts, each on its own; of rows alike in both, the exact stage keeps one. A null doc_id is kept as any
other; texts that are null or empty are alike for the exact stage and have neither shingles nor passages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import contamination
from tessera.llm.exact_dedup import exact_duplicates
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import pack
from tessera.llm.quality import accepted, fit
from tessera.llm.quality import held_out as unlearned
from tessera.llm.shared import drop_since, mark, read, written

#: No SQL: the classifier is learned and tokens are packed. tests/llm checks each stage against a plain version.
ORACLE_SQL = None


#: Percentage of shingles from which on two texts are near-duplicates.
LIKE = 80


def _free(docs: DataFrame, *names: str) -> list[str]:
    """These names, made longer where the table has such a column already."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
        taken.add(name)
    return out


def _among(docs: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
    """The rows whose doc_id and text are (left_semi) or are not (left_anti) among those chosen (doc_id, text_hash)."""
    hash_, id_, text_ = _free(docs, "hash_of_text", "chosen_id", "chosen_text")
    chosen = chosen.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(text_))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(hash_) == F.col(text_))
    return docs.withColumn(hash_, F.xxhash64("text")).join(chosen, same, how).drop(hash_)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = read(spark, sf_dir, "labels").where(~unlearned()).select("doc_id", F.col("quality").alias("label"))
    return accepted(docs, fit(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id stays; of rows alike in doc_id and text, one."""
    found = exact_duplicates(docs, keep="largest").groupBy("doc_id", "text_hash").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    changed = written(found.where("not kept or n > 1"), "exact")
    (hash_,) = _free(docs, "hash_of_text")
    one = _among(docs, changed.where("kept"), "left_semi").withColumn(hash_, F.xxhash64("text")).dropDuplicates(["doc_id", hash_]).drop(hash_)
    return _among(docs, changed, "left_anti").union(one)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of texts alike by 0.8 or more, the one with the smallest doc_id stays."""
    return _among(docs, near_duplicates(docs, LIKE).where("not stays"), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return _among(docs, contamination(docs, read(spark, sf_dir, "benchmark")).where("size(hit_words) > 0"), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of one length."""
    return pack(docs)


STAGES = [("quality", quality), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, begun = read(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_since(begun, docs)  # what the stage wrote on its way, and the table of the one before
    return docs
