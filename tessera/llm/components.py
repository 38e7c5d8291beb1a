"""Connected components of links as repeated joins; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import drop, written

#: Rows that meet one id (a hub that a third of all links may lead to) are dealt to so many tasks.
SALTS = 8


def salted(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS))


def met(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner", others: list[str] = ()) -> DataFrame:
    """left joined to right (one row for each key), a key of many rows in left lying in many tasks by left's column `by`.

    others: columns of the key besides."""
    copies = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.withColumn("salt", salted(by)).join(copies, [key, *others, "salt"], how).drop("salt")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each end of links (a, b): component is the smallest id that can be reached.

    Each round takes the smallest label of the neighbours and then follows the label's own label, so the
    rounds grow with the logarithm of a chain's length. It ends when a round changes nothing.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links", True)
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component"), F.lit(True).alias("changed"))
    labels = written(labels, "labels", True)
    while True:
        near = met(both, labels.select(F.col("id").alias("b"), "component"), "b", "a").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        lower = labels.join(near, "id", "left").select("id", F.col("component").alias("was"), F.least("component", "m").alias("mid"))
        up = labels.select(F.col("id").alias("mid"), F.col("component").alias("top"))
        new = met(lower, up, "mid", "id", "left").select("id", F.least("mid", "top").alias("component"), (F.least("mid", "top") != F.col("was")).alias("changed"))
        new = written(new, "labels", True)
        drop(labels)
        labels = new
        if labels.where("changed").isEmpty():
            drop(both)
            return labels.select("id", "component")
