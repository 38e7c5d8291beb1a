"""Sinks for events. Each takes a frame of events; several run one after another over a kept frame, and one that fails
does not keep others from running."""

from __future__ import annotations

import json
import logging
import urllib.request
from collections.abc import Callable
from itertools import islice

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.events import as_json, mapped

log = logging.getLogger(__name__)
Sink = Callable[[DataFrame], None]


def json_lines(path: str) -> Sink:
    return lambda events: as_json(events).write.mode("append").text(path)


def parquet(path: str) -> Sink:
    return lambda events: mapped(events).write.mode("append").parquet(path)


def console(rows: int = 20) -> Sink:
    return lambda events: as_json(events).show(rows, truncate=False)


def _as_log_records(events: list[dict]) -> dict:
    """Events as a request of the OpenTelemetry protocol for logs, JSON over HTTP."""

    def value(v) -> dict:
        if isinstance(v, bool):
            return {"boolValue": v}
        if isinstance(v, int):
            return {"intValue": str(v)}
        if isinstance(v, float):
            return {"doubleValue": v}
        return {"arrayValue": {"values": [value(x) for x in v]}} if isinstance(v, list) else {"stringValue": str(v)}

    at = "gen_ai.security.detection."
    levels = {"info": 9, "medium": 13, "high": 17, "critical": 21}
    records = [
        {"severityText": e.get(at + "severity", "info"), "severityNumber": levels.get(e.get(at + "severity"), 9), "body": value(e.get(at + "message", "")), "attributes": [{"key": k, "value": value(v)} for k, v in e.items()]}
        for e in events
    ]
    return {"resourceLogs": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "tessera"}}]}, "scopeLogs": [{"scope": {"name": "tessera"}, "logRecords": records}]}]}


def otlp(url: str, batch: int = 50, timeout: float = 5.0) -> Sink:
    """Posts log records of the OpenTelemetry protocol (the collector's /v1/logs), as webhook does."""
    return webhook(url, batch, timeout, _as_log_records)


def webhook(url: str, batch: int = 50, timeout: float = 5.0, shape: Callable[[list], dict] = lambda events: {"events": events}) -> Sink:
    """Posts {"events": [...]} from the tasks, batch by batch; a post that fails is left out, as delivery is not vital."""

    def post(rows) -> None:
        held: list = []

        def send() -> None:
            if held:
                try:
                    request = urllib.request.Request(url, json.dumps(shape(held)).encode(), {"Content-Type": "application/json"})
                    urllib.request.urlopen(request, timeout=timeout).close()
                except OSError as e:
                    log.warning("webhook: %s", e)
                held.clear()

        for row in rows:
            held.append(json.loads(row["value"]))
            if len(held) == batch:
                send()
        send()

    return lambda events: as_json(events).foreachPartition(post)


def fan_out(*sinks: Sink) -> Sink:
    def run(events: DataFrame) -> None:
        kept = events.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for sink in sinks:
                try:
                    sink(kept)
                except Exception as e:  # noqa: BLE001 - the other sinks still get the events
                    log.warning("sink failed: %s", e)
        finally:
            kept.unpersist()

    return run


def split(condition: str, yes: Sink, no: Sink) -> Sink:
    """Rows that meet a condition go to one sink, the others to another: split("state = 'late'", aside, states)."""

    def run(rows: DataFrame) -> None:
        kept = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yes(kept.where(condition))
            no(kept.where(f"not coalesce({condition}, false)"))
        finally:
            kept.unpersist()

    return run


def deliver(events: DataFrame, sink: Sink, checkpoint: str, every: str = "5 seconds", available_now: bool = False) -> StreamingQuery:
    """Runs a sink on each micro-batch of a stream. Where the sink is slow the stream waits; nothing is dropped."""
    writer = events.writeStream.foreachBatch(lambda batch, _: sink(batch)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def _is_there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def once(path: str, shape: Callable[[DataFrame], DataFrame] = mapped) -> Callable[[DataFrame, int], None]:
    """A sink of Parquet files that takes each micro-batch once: its folder is named after the batch's number.

    Spark's mark of success in a folder is the ledger. A batch that is run again after a failure is skipped if its folder
    has the mark, and replaces what lies there if not, so a reader of marked folders (delivered) sees no row twice. One
    folder belongs to one query and its checkpoint.
    """

    def run(events: DataFrame, number: int) -> None:
        folder = f"{path}/batch={number}"
        if not _is_there(events.sparkSession, f"{folder}/_SUCCESS"):
            shape(events).write.mode("overwrite").parquet(folder)

    return run


def delivered(spark: SparkSession, path: str) -> DataFrame:
    """What once() has delivered, with the number of its batch; folders without a mark are left out."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    folders = [str(x.getPath()) for x in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]
    return spark.read.option("basePath", path).parquet(*[f for f in folders if _is_there(spark, f"{f}/_SUCCESS")])


def deliver_once(events: DataFrame, path: str, checkpoint: str, every: str = "5 seconds", available_now: bool = False, shape: Callable[[DataFrame], DataFrame] = mapped) -> StreamingQuery:
    """Runs once() on each micro-batch of a stream."""
    writer = events.writeStream.foreachBatch(once(path, shape)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


#: Trips that a handler is given in one call, at most.
AT_ONCE = 1000


def on_trip(handler: Callable[[list], None]) -> Sink:
    """Hands the trips of breakers (rows with tripped) to a function, once each, at most AT_ONCE in a call.

    They come to the driver partition by partition, however many there are.
    """

    def run(states: DataFrame) -> None:
        trips = states.where("tripped").toLocalIterator()
        while some := list(islice(trips, AT_ONCE)):
            try:
                handler(some)
            except Exception as e:  # noqa: BLE001 - a handler does not stop the stream
                log.warning("on_trip failed: %s", e)

    return run
