"""Reports on verdicts: coverage by class, rules that fire together, percentiles, and agreement with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import named
from tessera.functions.tables import kept


def coverage(verdicts: DataFrame, by: str) -> DataFrame:
    """By a column: records, with any score, flagged at least, blocked."""
    return verdicts.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(F.col("score") > 0).alias("scored"), F.count_if(F.col("true_action") != "allowed").alias("detected"), F.count_if(F.col("true_action") == "blocked").alias("blocked")
    )


def rule_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.select(F.explode(F.array_distinct("rules")).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def rule_pairs(verdicts: DataFrame) -> DataFrame:
    """Rules that fire on the same record, and on how many. A record's rules are few; records do not meet."""
    rules = F.sort_array(F.array_distinct("rules"))
    firsts = verdicts.select(rules.alias("rules")).where(F.size("rules") > 1).select("rules", F.explode("rules").alias("rule_a"))
    return firsts.select("rule_a", F.explode(F.filter("rules", lambda r: r > F.col("rule_a"))).alias("rule_b")).groupBy("rule_a", "rule_b").agg(F.count("*").alias("n"))


#: Ranges that a round tells apart, for each group and percentile.
RANGES = 1024


def percentiles(df: DataFrame, value: str, by: str, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact nearest-rank percentiles by a column, and the largest value. Null values and such that are no number are left
    out, and so is a group without others; a null group is one of its own. An empty table gives no rows.

    No group's values meet in one place. Each round counts the values that may still be a percentile in RANGES ranges,
    within map tasks first, takes the range that holds the rank, and goes on between the smallest and the largest value
    in it, until these are one. Every round leaves fewer distinct values, about a thousandth of them.
    """
    rows = df.select(named(by).alias("by"), named(value).cast("double").alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    groups = kept(rows.groupBy("by").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")))
    ranks = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.greatest(F.lit(1), F.ceil(p * F.col("n"))).alias("rank")) for k, p in enumerate(at)])).alias("r")
    targets = kept(groups.select("by", "low", "high", ranks).select("by", "low", "high", "r.k", "r.rank"))
    while not targets.where("low < high").isEmpty():
        mine = targets.where("low < high").withColumnRenamed("by", "own")
        open_rows = rows.join(mine, rows.by.eqNullSafe(mine.own) & F.col("value").between(F.col("low"), F.col("high")))
        # Halves, so that no difference overflows.
        place = F.least(F.lit(RANGES - 1), F.floor((F.col("value") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * RANGES))
        counts = open_rows.groupBy("by", "k", "rank", place.alias("place")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        upto = Window.partitionBy("by", "k").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        found = counts.withColumn("upto", F.sum("n").over(upto)).where("rank <= upto and rank > upto - n")
        targets = kept(found.select("by", "low", "high", "k", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")).union(targets.where("low = high").select("by", "low", "high", "k", "rank")))
    named_ = [F.max(F.when(F.col("k") == k, F.col("low"))).alias(f"p{round(p * 100)}") for k, p in enumerate(at)]
    tops = groups.select(F.col("by").alias("own"), F.col("high").alias("largest"))
    found = targets.groupBy("by").agg(*named_)
    return found.join(tops, found.by.eqNullSafe(tops.own)).drop("own").withColumnRenamed("by", by)


def confusion(verdicts: DataFrame, labels: DataFrame, key: str, label: str, predicted: Column) -> DataFrame:
    return verdicts.join(labels, key).groupBy(F.col(label).alias("label"), predicted.alias("predicted")).agg(F.count("*").alias("n"))
