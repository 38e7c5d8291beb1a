"""Streams of verdicts and of breaker states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.state import Limits, breaker_stream
from tessera.plans.scans import hashed, scan_inputs, scan_outputs


def verdicts(turns: DataFrame, mode: str = "block") -> DataFrame:
    """Verdicts on a stream of turns (direction input or output, text): both scans, without the text in the result."""
    keep = [c for c in turns.columns if c != "text"] + ["content_hash", "content_length", "score", "category", "rules", "true_action", "action"]
    inputs = scan_inputs(turns.where("direction = 'input'"), mode=mode)
    outputs = scan_outputs(turns.where("direction = 'output'"), mode=mode)
    return hashed(inputs).select(*keep).union(hashed(outputs).select(*keep))


def guarded(scans: DataFrame, limits: Limits, delay: float = 600.0) -> DataFrame:
    """Breaker states of a stream of verdicts (agent_id, ts, seq, kind, true_action, score)."""
    return breaker_stream(scans.withColumn("action", F.col("true_action")), limits, delay)


def counts(events: DataFrame, window: str = "5 minutes", slide: str = "1 minute", delay: str = "10 minutes", session: str | None = None) -> DataFrame:
    """Events (ts, action) by window, or by session of an agent where a gap is given, with a watermark."""
    marked = events.withWatermark("ts", delay)
    if session:
        return marked.groupBy(F.session_window("ts", session).alias("window"), "agent_id").agg(F.count("*").alias("n"))
    return marked.groupBy(F.window("ts", window, slide).alias("window"), "action").agg(F.count("*").alias("n"))
