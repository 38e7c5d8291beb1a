"""Fusion of scores, bands and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK, FLAG = 0.60, 0.20


def fused(*layers: Column) -> Column:
    """The largest score of layers, raised by a fifth where two have any and by a tenth more where three have."""
    top = F.greatest(*layers, F.lit(0.0))
    n = sum(((x > 0).cast("int") for x in layers), F.lit(0))
    two = F.when(n >= 2, F.least(F.lit(1.0), top * 1.2)).otherwise(top)
    return F.when(n >= 3, F.least(F.lit(1.0), two * 1.1)).otherwise(two)


def band(score: Column, block: float = BLOCK, flag: float = FLAG) -> Column:
    return F.when(score >= block, "block").when(score >= flag, "flag").otherwise("allow")


def true_action(band: Column) -> Column:
    """What would be done if the mode allowed it; records of events keep this."""
    return F.when(band == "block", "blocked").when(band == "flag", "flagged").otherwise("allowed")


def action(true: Column, mode: str = "block") -> Column:
    """What is done: outside block mode nothing is stopped, only flagged."""
    return true if mode == "block" else F.when(true.isin("blocked", "approval_required"), "flagged").otherwise(true)


def first_top(findings: Column) -> Column:
    """The first of the findings with the largest score; null of none."""
    top = F.array_max(F.transform(findings, lambda x: x["score"]))
    return F.get(F.filter(findings, lambda x: x["score"] == top), F.lit(0))


def category(content: Column, related: Column, fallback: Column) -> Column:
    """The category of the top relation if its score is that of the top finding at least, else of the first top
    finding, else the fallback."""
    one, two = first_top(content), first_top(related)
    by_relation = two.isNotNull() & (two["score"] >= F.coalesce(one["score"], F.lit(0.0)))
    return F.when(by_relation, two["category"]).otherwise(F.coalesce(one["category"], fallback))


def must_halt(action: Column) -> Column:
    return action.isin("blocked", "approval_required")
