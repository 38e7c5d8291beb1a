"""Identifiers that peers issued to an agent, and messages that refer to ones they did not: in batch and as a stream.

Both run the same Tracker over an agent's messages in order of time and number. An identifier is known until its expiry;
a later issue renews it. Messages purge what has expired, so the first message behind an expiry still learns that its
identifier had been known, and later ones do not. Of each kind an agent keeps MOST identifiers: those that expire last.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from tessera.functions.columns import named, packed, unpacked
from tessera.operators.envelopes import _is, _items
from tessera.operators.state import by_agent_in_order

TTL, MOST = 3600.0, 10_000
MICROS = 1_000_000
# Signals and their scores.
SIGNALS = {"expired_task_reference": 0.20, "task_id_smuggling": 0.45, "unverified_task_reference": 0.25, "expired_context_reference": 0.20, "context_id_smuggling": 0.40}
IDS = "issued_tasks", "issued_contexts", "task_id", "context_id", "has_method"


def _text(tree: Column, path: str) -> Column:
    """A string at a path of a VARIANT; null where it is none or empty."""
    return F.when(_is(tree, path, "STRING"), F.nullif(F.try_variant_get(tree, path, "string"), F.lit("")))


def message_ids(df: DataFrame, body: str = "body") -> DataFrame:
    """df with the identifiers in a message: issued_tasks and issued_contexts of a response (its result, the status, task
    and artifacts in it, and params of an update), task_id and context_id that a request refers to, and has_method.

    An artifact's own id is no task's. What is no JSON object has null in all of these. Columns of df stay.
    """
    out = packed(df, tree=F.try_parse_json(named(body)))
    tree = F.col("tree")
    holders = ["$.result", "$.result.status", "$.result.task"]
    artifacts = _items(tree, "$.result.artifacts")

    def all_of(key: str, paths: list[str]) -> Column:
        own = F.array(*[_text(tree, p) for p in paths])
        return F.array_distinct(F.array_compact(F.concat(own, F.transform(artifacts, lambda a: _text(a, f"$.{key}")))))

    tasks = all_of("taskId", [f"{h}.{k}" for h in holders for k in ("taskId", "id")] + ["$.params.taskId"])
    contexts = all_of("contextId", [f"{h}.contextId" for h in holders] + ["$.params.contextId"])
    refers = {f"{k}_id": F.coalesce(_text(tree, f"$.params.message.{k}Id"), _text(tree, f"$.params.{k}Id")) for k in ("task", "context")}
    found = {"issued_tasks": tasks, "issued_contexts": contexts, **refers, "has_method": _is(tree, "$.method", "STRING")}
    whole = _is(tree, "$", "OBJECT")
    return unpacked(out.withColumns({k: F.when(whole, c) for k, c in found.items()}), *IDS)


class _Store:
    """Expiries by identifier, and a heap of them: what was renewed or dropped meanwhile is skipped when it comes up."""

    def __init__(self, expiries: dict[str, int]) -> None:
        self.expiries = expiries
        self.heap = [(e, i) for i, e in expiries.items()]
        heapq.heapify(self.heap)

    def issue(self, name: str, expiry: int) -> None:
        self.expiries[name] = expiry
        heapq.heappush(self.heap, (expiry, name))

    def _drop(self) -> None:
        expiry, name = heapq.heappop(self.heap)
        if self.expiries.get(name) == expiry:
            del self.expiries[name]

    def purge(self, now: int) -> None:
        while self.heap and self.heap[0][0] <= now:
            self._drop()

    def cap(self, most: int) -> None:
        while len(self.expiries) > most:
            self._drop()

    def status(self, name: str, now: int) -> str:
        expiry = self.expiries.get(name)
        return "unknown" if expiry is None else "expired" if expiry <= now else "known"


class Tracker:
    def __init__(self, ttl: float = TTL, most: int = MOST, tasks: dict[str, int] | None = None, contexts: dict[str, int] | None = None) -> None:
        if ttl < 0 or most < 1:
            raise ValueError(f"ttl must not be negative and most must be positive, not {ttl!r} and {most!r}")
        self.ttl, self.most = round(ttl * MICROS), most
        self.stores = {"task": _Store(tasks or {}), "context": _Store(contexts or {})}

    def received(self, now: int, tasks: list[str], contexts: list[str]) -> None:
        if len(tasks) or len(contexts):
            for kind, names in (("task", tasks), ("context", contexts)):
                self.stores[kind].purge(now)
                for name in names:
                    self.stores[kind].issue(name, now + self.ttl)
                self.stores[kind].cap(self.most)

    def sent(self, now: int, task: str | None, context: str | None, has_method: bool) -> list[str]:
        """Signals of a message that refers to identifiers; one that names no task may begin one."""
        out = []
        for kind, name in (("task", task), ("context", context)):
            status = self.stores[kind].status(name, now) if name else "known"
            if status == "expired":
                out.append(f"expired_{kind}_reference")
            elif status == "unknown":
                out.append("context_id_smuggling" if kind == "context" else "task_id_smuggling" if has_method else "unverified_task_reference")
        for store in self.stores.values():
            store.purge(now)
        return out


TRACKED = "agent_id string, ts timestamp, seq long, score double, signals array<string>"
_COLUMNS = ["agent_id", "ts", "seq", "received", *IDS]


def _micros(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64")


def _tracked(tracker: Tracker, pdf: pd.DataFrame) -> pd.DataFrame:
    found = []
    for now, received, tasks, contexts, task, context, method in zip(_micros(pdf["ts"]), *(pdf[c] for c in _COLUMNS[3:])):
        if method is None or pd.isna(method):  # no message
            found.append([])
        elif received:
            tracker.received(now, tasks, contexts)
            found.append([])
        else:
            found.append(tracker.sent(now, task, context, method))
    out = pdf[["agent_id", "ts", "seq"]].copy()
    out["score"], out["signals"] = [max((SIGNALS[s] for s in f), default=0.0) for f in found], found
    return out


def tracked_ids(messages: DataFrame, ttl: float = TTL, most: int = MOST) -> DataFrame:
    """(agent_id, ts, seq, score, signals) of each of messages (agent_id, ts, seq, received, and the columns that
    message_ids gives): a message received issues identifiers and has no signals, one sent refers to them.

    An agent's messages go by in order of time and number, in batches of bounded size; agents run apart. Rows without an
    agent_id are an agent of their own. What is no message has no signals and purges nothing.
    """
    return by_agent_in_order(messages.select(*_COLUMNS), lambda: Tracker(ttl, most), _tracked, TRACKED)


class _Tracking(StatefulProcessor):
    """Expiries as map states by identifier, which end with the last of them: a timer on event time clears an agent's."""

    def __init__(self, ttl: float, most: int) -> None:
        self.ttl, self.most = ttl, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        name, expiry = StructType([StructField("id", StringType())]), "expiry long"
        self.kept = {kind: handle.getMapState(f"{kind}s", name, expiry) for kind in ("task", "context")}
        self.timer = handle.getValueState("timer", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = {kind: {k[0]: v[0] for k, v in state.iterator()} for kind, state in self.kept.items()}
        tracker = Tracker(self.ttl, self.most, *(dict(before[k]) for k in ("task", "context")))
        pdf = pd.concat(list(rows))[_COLUMNS].sort_values(["ts", "seq"], kind="stable")
        for at in range(0, len(pdf), 10_000):
            yield _tracked(tracker, pdf.iloc[at : at + 10_000])
        last = 0
        for kind, state in self.kept.items():
            after = tracker.stores[kind].expiries
            for name in before[kind].keys() - after.keys():
                state.removeKey((name,))
            for name, expiry in after.items():
                if before[kind].get(name) != expiry:
                    state.updateValue((name,), (expiry,))
            last = max(last, max(after.values(), default=0))
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if last:
            # An expired identifier is told apart from an unknown one for another ttl.
            at = max(last // 1000 + round(self.ttl * 1000), timerValues.getCurrentWatermarkInMs()) + 1
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (*self.kept.values(), self.timer):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def tracked_stream(messages: DataFrame, ttl: float = TTL, most: int = MOST, delay: str = "10 minutes") -> DataFrame:
    """The same over a stream, with the identifiers of each agent as state. Messages behind the watermark (delay) are
    dropped by Spark, which counts them; an agent's messages of one micro-batch go by in order.

    Needs the RocksDB state store (state.use_rocksdb).
    """
    by_agent = messages.select(*_COLUMNS).withWatermark("ts", delay).groupBy("agent_id")
    return by_agent.transformWithStateInPandas(_Tracking(ttl, most), TRACKED, "append", "EventTime")
