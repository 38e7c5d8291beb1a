"""Lists of tools that change while records go by: in batch and as a stream.

A change (tool_name, ts, seq, listed) adds a tool to the list or takes it off; a call is judged by the last change of its
tool before it, in order of time and then of number, changes before calls. A tool that very many calls use is a key in
SHARES parts: each part has all of the tool's few changes and a share of its calls.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SHARES = 16
JUDGED = "tool_name string, ts timestamp, seq long, listed boolean"


def _tool() -> Column:
    """Names are told apart whatever their case; a null name is on no list."""
    return F.lower("tool_name")


def _both(calls: DataFrame, changes: DataFrame) -> DataFrame:
    made = changes.where("tool_name is not null and listed is not null").select("tool_name", "ts", "seq", "listed", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    asked = calls.select("tool_name", "ts", "seq", F.lit(None).cast("boolean").alias("listed"), F.pmod(F.xxhash64("seq"), F.lit(SHARES)).cast("int").alias("share"))
    return made.union(asked).withColumn("tool", _tool())


def listed_calls(calls: DataFrame, changes: DataFrame) -> DataFrame:
    """(tool_name, ts, seq, listed) of each of calls (tool_name, ts, seq, ...): whether its tool is listed at that time."""
    order = Window.partitionBy("tool", "share").orderBy("ts", F.col("listed").isNull(), "seq").rowsBetween(Window.unboundedPreceding, 0)
    now = F.coalesce(F.last("listed", ignorenulls=True).over(order), F.lit(False))
    return _both(calls, changes).withColumn("now", now).where("listed is null").select("tool_name", "ts", "seq", F.col("now").alias("listed"))


class _Listing(StatefulProcessor):
    """Whether a tool is listed, as one value of state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("listed", "listed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = bool(self.state.get()[0]) if self.state.exists() else False
        pdf = pd.concat(list(rows))
        pdf = pdf.assign(call=pdf["listed"].isna()).sort_values(["ts", "call", "seq"], kind="stable")
        filled = pdf["listed"].astype("boolean").ffill().fillna(now).astype(bool)
        if not pdf["call"].all():
            self.state.update((bool(filled.iloc[-1]),))
        yield pdf[["tool_name", "ts", "seq"]].assign(listed=filled)[pdf["call"]]

    def close(self) -> None:
        pass


def listed_stream(calls: DataFrame, changes: DataFrame) -> DataFrame:
    """The same over two streams: a change holds for the calls of its micro-batch that come after it, and for all later
    batches. Calls of an earlier batch are not judged again. Needs the RocksDB state store (state.use_rocksdb)."""
    return _both(calls, changes).groupBy("tool", "share").transformWithStateInPandas(_Listing(), JUDGED, "append", "None")
