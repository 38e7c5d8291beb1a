"""Sequences of turns in a conversation (an extension: the chains are declared data that nothing evaluates)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.findings import pattern
from tessera.rules.fixed import CHAINS

REFUSAL = r"(?i)\b(?:i\s+(?:can(?:not|'t)|won't|am\s+(?:not\s+able|unable))|i'm\s+(?:sorry|not\s+able|unable)|as\s+an\s+ai|cannot\s+(?:help|assist|comply))\b"


def _step(step: tuple[str, str, str], text: Column, role: Column) -> Column:
    _, who, what = step
    if what == "safe_message":
        fits = text.isNotNull()
    elif what == "refusal_response":
        fits = text.rlike(REFUSAL)
    else:
        fits = text.rlike(pattern(what))
    return F.coalesce((role == who) & fits, F.lit(False))


def chain_ends(turns: DataFrame, chain: tuple) -> DataFrame:
    """(conv_id, turn) of the turns at which a chain (name, category, score, gap, steps) is complete: its steps stand in
    order, each at most gap turns after the one before.

    A step is complete at a turn that fits it if the step before is complete within gap turns before; each is a window
    over a conversation's turns, which spills, so no conversation has to fit into memory.
    """
    _, _, _, gap, steps = chain
    out = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *[_step(s, F.col("text"), F.col("role")).alias(f"s{k}") for k, s in enumerate(steps)])
    out = out.where(reduce(lambda x, y: x | y, [F.col(f"s{k}") for k in range(len(steps))]) & F.col("turn").isNotNull())
    before = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-gap, -1)
    for k in range(1, len(steps)):
        complete = F.max(F.when(F.col(f"s{k - 1}"), F.col("turn"))).over(before).isNotNull()
        out = out.withColumn(f"s{k}", F.col(f"s{k}") & complete)
    return out.where(f"s{len(steps) - 1}").select("conv_id", "turn")


def chain_findings(turns: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(conv_id, turn, chain, category, score) of all chains, or those named, in turns (conv_id, turn, role, text)."""
    out = None
    for chain in CHAINS:
        if names is None or chain[0] in names:
            found = chain_ends(turns, chain).select("conv_id", "turn", F.lit(chain[0]).alias("chain"), F.lit(chain[1]).alias("category"), F.lit(float(chain[2])).alias("score"))
            out = found if out is None else out.union(found)
    return out
