import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import lists, state, tracking
from tessera.streaming import pipelines, sinks

EVENTS = [("a", dt.datetime(2024, 1, 1, 0, 0, i), i, "scan", "blocked", 1.0) for i in range(8)] + [("b", dt.datetime(2024, 1, 1, 0, 0, i), 100 + i, "tool_call", "allowed", 0.0) for i in range(3)]
FIELDS = "agent_id string, ts timestamp, seq long, kind string, action string, score double"
LIMITS = state.Limits(violations=3, calls=2, cooldown=4)


def test_breaker_trips_and_closes(spark):
    got = {(r.agent_id, r.seq): (r.state, r.tripped) for r in state.breaker_states(spark.createDataFrame(EVENTS, FIELDS), LIMITS).collect()}
    assert [got["a", k] for k in range(8)] == [("closed", False), ("closed", False), ("closed", True), ("open", False), ("open", False), ("open", False), ("closed", False), ("closed", False)]
    assert [got["b", 100 + k] for k in range(3)] == [("closed", False), ("closed", True), ("open", False)]


def test_stream_agrees_with_batch(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, FIELDS)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FIELDS).parquet(str(tmp_path / "in"))
    state.use_rocksdb(spark)
    q = state.breaker_stream(stream, LIMITS).writeStream.format("memory").queryName("breaker").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = lambda d: sorted((r.agent_id, r.seq, r.state, r.tripped, r.action) for r in d.collect())
    assert rows(spark.table("breaker")) == rows(state.breaker_states(df, LIMITS))


def test_sinks_are_apart(spark, tmp_path):
    events = spark.createDataFrame([("input", "blocked", 0.97, "jailbreak", ["r1", "r2"], "a1")], "direction string, action string, score double, category string, rules array<string>, agent_id string")

    def broken(_):
        raise RuntimeError("no")

    sinks.fan_out(broken, sinks.json_lines(str(tmp_path / "lines")))(events)
    line = spark.read.json(str(tmp_path / "lines")).first().asDict()
    assert line["gen_ai.security.detection.message"] == "blocked jailbreak on a1 via r1 (+1 more)"
    assert line["gen_ai.security.detection.severity"] == "critical"


def test_window_counts(spark, tmp_path):
    spark.createDataFrame(EVENTS, FIELDS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FIELDS).parquet(str(tmp_path / "in"))
    q = pipelines.counts(stream, "1 minute", "1 minute").writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counted").agg(F.sum("n")).first()[0] == len(EVENTS)


def stream_of(spark, tmp_path, batches, fields, name):
    """A stream with one micro-batch for each list of rows."""
    state.use_rocksdb(spark)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, fields).coalesce(1).write.mode("append").parquet(str(tmp_path / name / f"{k}"))
    return spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / name))


def run(df, tmp_path, name, sink=None):
    out = df.writeStream.option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True)
    out = out.foreachBatch(lambda d, _: sink(d)) if sink else out.format("memory").queryName(name)
    q = out.start()
    q.awaitTermination(240)
    return q


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_late_rows_open_nothing_and_are_set_aside(spark, tmp_path):
    hours = 36_000
    batches = [
        [("a", at(hours + i), i, "scan", "blocked", 1.0) for i in range(2)],
        [("a", at(1), 50, "scan", "blocked", 1.0), ("a", at(hours + 5), 51, "scan", "allowed", 0.0)],
        [("a", at(hours + 6), 60, "scan", "allowed", 0.0), ("b", at(hours), 61, "scan", "allowed", 0.0)],
    ]
    aside, rest = [], []
    run(state.breaker_stream(stream_of(spark, tmp_path, batches, FIELDS, "late"), LIMITS), tmp_path, "late", sinks.split("state = 'late'", lambda d: aside.extend(d.collect()), lambda d: rest.extend(d.collect())))
    assert [(r.agent_id, r.seq, r.tripped) for r in aside] == [("a", 50, False)]
    assert {r.seq: (r.state, r.tripped) for r in rest} == {k: ("closed", False) for k in (0, 1, 51, 60, 61)}


def test_state_of_a_silent_agent_ends(spark, tmp_path):
    batches = [[("a", at(0), 0, "scan", "blocked", 1.0)], *[[("b", at(200_000 * k), k, "scan", "allowed", 0.0)] for k in range(1, 5)]]
    run(state.breaker_stream(stream_of(spark, tmp_path, batches, FIELDS, "silent"), LIMITS, 60.0), tmp_path, "silent")
    left = spark.read.format("statestore").option("path", str(tmp_path / "silent-cp")).option("stateVarName", "breaker").load()
    assert [r.key.agent_id for r in left.collect()] == ["b"]


MESSAGE = "agent_id string, ts timestamp, seq long, received boolean, body string"


def messages():
    """Issues and references of a few agents at random times, with renewals, expiries and more identifiers than are kept."""
    rng, out = random.Random(5), []
    for k in range(400):
        ref, ctx = f"t{rng.randrange(12)}", f"c{rng.randrange(5)}"
        body = rng.choice([
            {"result": {"taskId": ref, "contextId": ctx, "artifacts": [{"id": "not a task", "taskId": ref + "x"}]}}, {"result": {"id": ref, "status": {"contextId": ctx}}}, {"params": {"taskId": ref}}, {"result": {"task": {"id": 7, "taskId": ""}}},
            {"method": "message/send", "params": {"message": {"taskId": ref}}}, {"params": {"message": {"taskId": ref, "contextId": ctx}}}, {"method": "x", "params": {"contextId": ctx, "message": {}}}, [1], {"params": {"message": {"parts": []}}},
        ])
        out.append((rng.choice(["a", "b", None]), at(k * 7 + rng.randrange(3)), k, rng.random() < 0.5, rng.choice([json.dumps(body)] * 9 + [None])))
    return out


def plain_tracking(rows, ttl, most):
    """Plain dictionaries, purged and capped at each message."""
    kept, out = {}, {}
    for agent, ts, seq, received, body in sorted(rows, key=lambda r: (r[1], r[2])):
        tree = json.loads(body) if body else None
        out[seq] = []
        if not isinstance(tree, dict):
            continue
        stores = kept.setdefault(agent, ({}, {}))
        text = lambda d, k: d.get(k) if isinstance(d, dict) and isinstance(d.get(k), str) and d.get(k) else None
        now, result, params = ts.timestamp(), tree.get("result") or {}, tree.get("params") or {}
        if received:
            holders = [result, result.get("status"), result.get("task")]
            found = [{text(h, k) for h in holders for k in ("taskId", "id")} | {text(params, "taskId")}, {text(h, "contextId") for h in [*holders, params]}]
            for a in result.get("artifacts") or []:
                found[0].add(text(a, "taskId"))
                found[1].add(text(a, "contextId"))
            found = [f - {None} for f in found]
            if not any(found):
                continue
        else:
            for kind, key, store in ((0, "taskId", stores[0]), (1, "contextId", stores[1])):
                name = text(params.get("message"), key) or text(params, key)
                if name and name not in store:
                    out[seq].append("context_id_smuggling" if kind else "task_id_smuggling" if isinstance(tree.get("method"), str) else "unverified_task_reference")
                elif name and store[name] <= now:
                    out[seq].append("expired_context_reference" if kind else "expired_task_reference")
        for store in stores:
            for k in [k for k, e in store.items() if e <= now]:
                del store[k]
        if received:
            for store, names in zip(stores, found):
                store.update({k: now + ttl for k in names})
                for k in sorted(store, key=lambda k: (store[k], k))[: max(0, len(store) - most)]:  # noqa: B023
                    del store[k]
    return out


@pytest.mark.parametrize(("ttl", "most"), [(100.0, 10_000), (300.0, 6), (0.0, 3)])
def test_tracked_ids_agree_with_plain_dictionaries(spark, ttl, most):
    rows = messages()
    df = tracking.message_ids(spark.createDataFrame(rows, MESSAGE))
    got = {r.seq: r for r in tracking.tracked_ids(df, ttl, most).collect()}
    want = plain_tracking(rows, ttl, most)
    assert {k: list(r.signals) for k, r in got.items()} == want
    assert all(got[k].score == max((tracking.SIGNALS[s] for s in w), default=0.0) for k, w in want.items())
    assert ttl != 100.0 or {s for w in want.values() for s in w} == set(tracking.SIGNALS)


def test_tracked_stream_agrees_with_batch(spark, tmp_path):
    rows = messages()
    stream = stream_of(spark, tmp_path, [rows[:150], rows[150:160], rows[160:]], MESSAGE, "ids")
    run(tracking.tracked_stream(tracking.message_ids(stream), 100.0, 6), tmp_path, "ids")
    batch = tracking.tracked_ids(tracking.message_ids(spark.createDataFrame(rows, MESSAGE)), 100.0, 6)
    as_rows = lambda d: sorted((r.seq, r.score, tuple(r.signals)) for r in d.collect())
    assert as_rows(spark.table("ids")) == as_rows(batch)


def test_a_batch_that_runs_again_is_delivered_once(spark, tmp_path):
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "once-cp")
    stream = stream_of(spark, tmp_path, [[("a", at(k), k, "scan", "allowed", 0.0)] for k in range(3)], FIELDS, "once")

    def deliver():
        sinks.deliver_once(stream, path, checkpoint, available_now=True, shape=lambda d: d.select("agent_id", "seq")).awaitTermination(120)

    deliver()
    # Killed between the write and Spark's commit: the last batch's commit is missing when the query starts again.
    last = max((tmp_path / "once-cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for file in (last, last.with_name(f".{last.name}.crc")):
        file.unlink(missing_ok=True)
    deliver()
    assert sorted(r.seq for r in sinks.delivered(spark, path).collect()) == [0, 1, 2]
    # Killed within the write: the folder has rows and no mark.
    for file in (last, last.with_name(f".{last.name}.crc")):
        file.unlink(missing_ok=True)
    (tmp_path / "out" / f"batch={last.name}" / "_SUCCESS").unlink()
    assert len(sinks.delivered(spark, path).collect()) == 2
    deliver()
    assert sorted(r.seq for r in sinks.delivered(spark, path).collect()) == [0, 1, 2]


CALL, CHANGE = "tool_name string, ts timestamp, seq long", "tool_name string, ts timestamp, seq long, listed boolean"


def test_a_list_that_changes_while_a_stream_runs(spark, tmp_path):
    calls = [[("shell", at(10), 1), ("Mail", at(10), 2), (None, at(10), 3)], [("SHELL", at(20), 4), ("mail", at(20), 5)], [("shell", at(30), 6), ("shell", at(41), 7), ("mail", at(41), 8)]]
    changes = [[("Shell", at(15), 100, True)], [("mail", at(19), 101, True), (None, at(1), 102, True), ("x", at(1), 103, None)], [("shell", at(40), 104, False)]]
    stream = lists.listed_stream(stream_of(spark, tmp_path, calls, CALL, "calls"), stream_of(spark, tmp_path, changes, CHANGE, "changes"))
    run(stream, tmp_path, "listed")
    want = {1: False, 2: False, 3: False, 4: True, 5: True, 6: True, 7: False, 8: True}
    assert {r.seq: r.listed for r in spark.table("listed").collect()} == want
    flat = lambda rows, fields: spark.createDataFrame([r for b in rows for r in b], fields)
    assert {r.seq: r.listed for r in lists.listed_calls(flat(calls, CALL), flat(changes, CHANGE)).collect()} == want
