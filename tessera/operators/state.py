"""Keyed state over time: circuit breakers and issued identifiers, in batch and as streams, with one function each.

A breaker's course depends on its path (counters clear when it closes, an open one stops counting), so it is a state
function by agent; events of an agent are read in order of time and then of their number. Windowed counts alone are
plain window columns.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.verdict import BLOCK

KEPT = 4096


@dataclass
class Limits:
    """Violations in a window and calls in a window that trip a breaker; None: that counter is off. cooldown None: open
    until reset."""

    violations: int | None = 5
    violation_window: float = 60.0
    calls: int | None = 100
    call_window: float = 60.0
    cooldown: float | None = 300.0
    block: bool = True

    def __post_init__(self) -> None:
        for name in ("violations", "calls"):
            n = getattr(self, name)
            if n is not None and (not isinstance(n, int) or n < 1):
                raise ValueError(f"{name} must be a positive int or None, not {n!r}")
        for name in ("violation_window", "call_window"):
            if not getattr(self, name) or getattr(self, name) < 0:
                raise ValueError(f"{name} must be positive, not {getattr(self, name)!r}")
        if self.cooldown is not None and self.cooldown < 0:
            raise ValueError(f"cooldown must not be negative, but is {self.cooldown!r}")


@dataclass
class Breaker:
    limits: Limits
    opened: float | None = None
    violations: deque = field(default_factory=deque)
    calls: deque = field(default_factory=deque)

    def is_open(self, now: float) -> bool:
        cooldown = self.limits.cooldown
        if self.opened is not None and cooldown is not None and now - self.opened >= cooldown:
            self.opened = None
            self.violations.clear()
            self.calls.clear()
        return self.opened is not None

    def _count(self, stamps: deque, now: float, window: float, most: int | None) -> bool:
        if most is None:
            return False
        stamps.append(now)
        while stamps and stamps[0] < now - window:
            stamps.popleft()
        while len(stamps) > max(KEPT, 2 * most):
            stamps.popleft()
        return len(stamps) >= most

    def step(self, now: float, kind: str, action: str, score: float) -> tuple[str, bool]:
        """(state the event met, whether it tripped the breaker). In block mode an open breaker counts nothing; a call
        that trips it is itself still let through."""
        was_open = self.is_open(now)
        if was_open and self.limits.block:
            return "open", False
        tripped = kind == "tool_call" and self._count(self.calls, now, self.limits.call_window, self.limits.calls)
        if action == "blocked" or action == "flagged" and score >= BLOCK:
            tripped |= self._count(self.violations, now, self.limits.violation_window, self.limits.violations)
        if tripped and not was_open:
            self.opened = now
            return "closed", True
        return "open" if was_open else "closed", False


BREAKER_OUT = "agent_id string, ts timestamp, seq long, state string, tripped boolean, action string"


def _seconds(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64") / 1e6


def _rows(breaker: Breaker, pdf: pd.DataFrame) -> pd.DataFrame:
    met = [breaker.step(t, k, a, s) for t, k, a, s in zip(_seconds(pdf["ts"]), pdf["kind"], pdf["action"], pdf["score"])]
    out = pdf[["agent_id", "ts", "seq"]].copy()
    out["state"], out["tripped"] = [m[0] for m in met], [m[1] for m in met]
    out["action"] = ["blocked" if m[0] == "open" and breaker.limits.block else a for m, a in zip(met, pdf["action"])]
    return out


def by_agent_in_order(rows: DataFrame, new: Callable, step: Callable, schema: str) -> DataFrame:
    """step(state, rows) over each agent's rows (agent_id, ts, seq, ...) in order of time and number; new() begins one.

    Rows come in Arrow batches of bounded size, so an agent with very many does not have to fit into memory; different
    agents run apart. Rows without agent_id are an agent of their own.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(n, "agent_id").sortWithinPartitions("agent_id", "ts", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        agent, state = object(), None
        for pdf in batches:
            for name, group in pdf.groupby("agent_id", dropna=False, sort=False):
                if state is None or not (name == agent or pd.isna(name) and pd.isna(agent)):
                    agent, state = name, new()
                yield step(state, group)

    return ordered.mapInPandas(run, schema)


def breaker_states(events: DataFrame, limits: Limits) -> DataFrame:
    """The state that each of events (agent_id, ts, seq, kind scan or tool_call, action, score) met, and trips."""
    return by_agent_in_order(events.select("agent_id", "ts", "seq", "kind", "action", "score"), lambda: Breaker(limits), _rows, BREAKER_OUT)


def use_rocksdb(spark: SparkSession) -> None:
    """Streams with states of several parts need this store; set it before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: State that a row met which came too late to be counted.
LATE = "late"


class _Breaking(StatefulProcessor):
    """A breaker for each agent, with the time of its newest row. Late rows are told by that time, and passed on.

    A timer on event time ends the state when nothing of it can matter any more.
    """

    def __init__(self, limits: Limits, delay: float) -> None:
        self.limits, self.delay = limits, delay
        windows = [limits.violation_window if limits.violations else 0, limits.call_window if limits.calls else 0]
        #: Seconds after the newest row for which state is kept; None: an open breaker stays open.
        self.keep = max(*windows, limits.cooldown or 0) + delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("breaker", "opened double, violations array<double>, calls array<double>, newest double, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        breaker, newest, timer = Breaker(self.limits), float("-inf"), None
        if self.state.exists():
            opened, violations, calls, newest, timer = self.state.get()
            breaker = Breaker(self.limits, None if opened is None or pd.isna(opened) else opened, deque(violations), deque(calls))
        # A batch's rows are kept as a few numbers and codes each until they are in order.
        pdf = pd.concat([p.astype({"kind": "category", "action": "category"}) for p in rows]).sort_values(["ts", "seq"], kind="stable")
        late = _seconds(pdf["ts"]) < newest - self.delay
        for part, met in ((pdf[late.to_numpy()], False), (pdf[~late.to_numpy()], True)):
            for at in range(0, len(part), 10_000):
                some = part.iloc[at : at + 10_000].astype({"kind": "object", "action": "object"})
                yield _rows(breaker, some) if met else some[["agent_id", "ts", "seq"]].assign(state=LATE, tripped=False, action=some["action"])
        newest = max(newest, float(_seconds(pdf["ts"]).max()))
        if timer is not None and not pd.isna(timer):
            self.handle.deleteTimer(int(timer))
        timer = None
        if breaker.opened is None or self.limits.cooldown is not None:
            timer = max(round((newest + self.keep) * 1000), timerValues.getCurrentWatermarkInMs()) + 1
            self.handle.registerTimer(timer)
        self.state.update((breaker.opened, list(breaker.violations), list(breaker.calls), newest, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def breaker_stream(events: DataFrame, limits: Limits, delay: float = 600.0, forget: str = "1 day") -> DataFrame:
    """The same over a stream. A row more than delay seconds behind the newest of its agent from earlier batches has the
    state LATE: it is not counted, opens nothing, and is for the caller to divert (sinks.split). Spark itself drops only
    rows that lie further back than forget, and counts them.

    A silent agent's state ends when its windows and cooldown have passed in event time (forget later, as that is how far
    the watermark lags); an open breaker without a cooldown stays. Needs the RocksDB state store (use_rocksdb).
    """
    rows = events.select("agent_id", "ts", "seq", "kind", "action", "score").withWatermark("ts", forget)
    return rows.groupBy("agent_id").transformWithStateInPandas(_Breaking(limits, delay), BREAKER_OUT, "append", "EventTime")


def sliding_counts(events: DataFrame, seconds: int, by: str = "agent_id") -> DataFrame:
    """events (ts, seq, ...) with n, the events of the same key in the seconds before, the bound and itself included.

    Of events at the same moment, those with a larger number are not counted.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    upto = Window.partitionBy(by).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(by).orderBy("us").rangeBetween(Window.unboundedPreceding, -seconds * 1_000_000 - 1)
    counted = events.withColumn("us", micros).withColumns({"all": F.count("*").over(upto), "gone": F.count("*").over(before)})
    return counted.withColumn("n", F.col("all") - F.col("gone")).drop("us", "all", "gone")


TTL, MOST_IDS = 3600, 10_000


def issued_status(issued: DataFrame, checked: DataFrame, ttl: int = TTL) -> DataFrame:
    """checked (agent_id, ref, ts, kind task or context, has_method) with status known, expired or unknown and a score.

    issued has agent_id, ref and ts; a later issue renews an identifier. The last issue before a check decides, found
    by a window over both, sorted by time, so neither side is multiplied. An identifier of a hot agent is a key of its
    own.
    """
    cols = ["agent_id", "ref", "ts", "kind", "has_method"]
    issued, checked = (x.withColumn("ts", F.col("ts").cast("timestamp")) for x in (issued, checked))
    both = issued.select("agent_id", "ref", "ts", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("boolean").alias("has_method"), F.col("ts").alias("at"), F.lit(0).alias("order")).union(
        checked.select(*cols, F.lit(None).cast("timestamp").alias("at"), F.lit(1).alias("order"))
    )
    last = F.last("at", ignorenulls=True).over(Window.partitionBy("agent_id", "ref").orderBy("ts", "order").rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumn("issued_at", last).where("order = 1")
    age = F.unix_micros("ts") - F.unix_micros("issued_at")
    status = F.when(F.col("issued_at").isNull(), "unknown").when(age < ttl * 1_000_000, "known").otherwise("expired")
    unknown = F.when(F.col("kind") == "context", 0.40).when(F.col("has_method"), 0.45).otherwise(0.25)
    out = met.withColumn("status", status)
    score = F.when(F.col("status") == "known", 0.0).when(F.col("status") == "expired", 0.20).otherwise(unknown)
    signal = F.when(F.col("status") == "expired", F.concat(F.lit("expired_"), "kind", F.lit("_reference"))).when((F.col("status") == "unknown") & (F.col("kind") == "context"), "context_id_smuggling").when((F.col("status") == "unknown") & F.col("has_method"), "task_id_smuggling").when(F.col("status") == "unknown", "unverified_task_reference")
    return out.select(*cols, "status", score.alias("score"), signal.alias("signal"))


def kept_ids(issued: DataFrame, most: int = MOST_IDS, ttl: int = TTL) -> DataFrame:
    """Of each agent's identifiers, the most that expire last; each once with its expiry."""
    expiry = issued.groupBy("agent_id", "ref").agg((F.max(F.unix_seconds(F.col("ts").cast("timestamp"))) + ttl).alias("expires"))
    place = F.row_number().over(Window.partitionBy("agent_id").orderBy(F.desc("expires"), "ref"))
    return expiry.withColumn("place", place).where(F.col("place") <= most).drop("place")
