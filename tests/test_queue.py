"""The queue's state machine, rule by rule, and its stream across a restart."""

import json

import pytest

from lodestone.operators import queue


def item(id_, **more):
    return {"id": id_, "status": "queued", "createdAt": 0, "file": {"name": f"{id_}.gcode", "sub": "", "sizeBytes": 100, "sha256": f"hash-{id_}"}, "queuedBy": "alice", **more}


def at(state, current=None, waiting=(), **more):
    return {**queue.empty(state), "current": current and item(current, status="there"), "queue": [item(i) for i in waiting], **more}


def asked(reason, current="a", waiting=("b",), **more):
    return at(queue.ATTENTION, current, waiting, reason=reason, detail={"code": "x"}, **more)


ON = {"online": True, "state": "printing"}
LIFE = [  # queue, event, state, reason, current, waiting
    (at("idle", None, "ab"), {"kind": "claim"}, "dispatching", None, "a", "b"),
    (at("dispatching", "a"), {"kind": "dispatched", "id": "a"}, "printing", None, "a", ""),
    (at("dispatching", "a"), {"kind": "dispatch_failed", "id": "a"}, queue.ATTENTION, "dispatch-failed", "a", ""),
    (at("dispatching", "a", "b"), {"kind": "deferred", "id": "a"}, "idle", None, None, "ab"),
    (at("dispatching", "a"), {"kind": "file_missing", "id": "a"}, queue.ATTENTION, "file-missing", "a", ""),
    (at("dispatching", "a"), {"kind": "file_changed", "id": "a"}, queue.ATTENTION, "file-changed", "a", ""),
    (at("printing", "a"), {"kind": "completed"}, "awaiting_bed_clear", None, "a", ""),
    (at("printing", "a"), {"kind": "failed"}, queue.ATTENTION, "print-failed", "a", ""),
    (at("printing", "a"), {"kind": "cancelled"}, queue.ATTENTION, "print-failed", "a", ""),
    (at("awaiting_bed_clear", "a"), {"kind": "bed_clear_started"}, "bed_clear_running", None, "a", ""),
    (at("awaiting_bed_clear", "a"), {"kind": "bed_confirmed"}, "idle", None, None, ""),
    (at("bed_clear_running", "a"), {"kind": "bed_cleared"}, "idle", None, None, ""),
    (at("bed_clear_running", "a"), {"kind": "bed_clear_failed"}, queue.ATTENTION, "bed-clear-failed", "a", ""),
    (asked("print-failed"), {"kind": "resolve", "answer": "resume"}, "printing", None, "a", "b"),
    (asked("print-failed"), {"kind": "resolve", "answer": "retry"}, "awaiting_bed_clear", None, "a", ["a+retry", "b"]),
    (asked("print-failed"), {"kind": "resolve", "answer": "skip"}, "awaiting_bed_clear", None, "a", "b"),
    (asked("dispatch-failed"), {"kind": "resolve", "answer": "retry"}, "idle", None, None, ["a+retry", "b"]),
    (asked("file-missing"), {"kind": "resolve", "answer": "skip"}, "idle", None, None, "b"),
    (asked("print-failed"), {"kind": "resolve", "answer": "stop"}, queue.ATTENTION, "print-failed", "a", "b"),
    (asked("bed-clear-failed"), {"kind": "resolve", "answer": "retry-bed-clear"}, "awaiting_bed_clear", None, "a", "b"),
    (asked("bed-clear-failed"), {"kind": "resolve", "answer": "skip-bed-clear"}, "idle", None, None, "b"),
    (asked("recovery-mismatch"), {"kind": "resolve", "answer": "acknowledge"}, "idle", None, None, "b"),
    (asked("pool-invalid"), {"kind": "pool_reassigned"}, "idle", None, "a", "b"),
    (asked("print-failed"), {"kind": "pool_reassigned"}, queue.ATTENTION, "print-failed", "a", "b"),
    (asked("file-changed"), {"kind": "accept_file", "sha256": "new", "sizeBytes": 7}, "idle", None, None, "ab"),
    (asked("print-failed"), {"kind": "clear"}, "idle", None, None, ""),
    (at("idle"), {"kind": "clear"}, "idle", None, None, ""),
    (at("printing", "a", "b"), {"kind": "pause"}, "printing", None, "a", "b"),
    (at("printing", "a", "b"), {"kind": "stop"}, "printing", None, "a", "b"),
    (at("dispatching", "a"), {"kind": "restart", "probe": {**ON, "filename": "a.gcode"}}, "printing", None, "a", ""),
    (at("dispatching", "a"), {"kind": "restart", "probe": {**ON, "filename": "z.gcode"}}, queue.ATTENTION, "recovery-mismatch", "a", ""),
    (at("dispatching", "a"), {"kind": "restart", "probe": {"online": True, "state": "idle"}}, queue.ATTENTION, "recovery-interrupted", "a", ""),
    (at("printing", "a"), {"kind": "restart", "probe": {"online": True, "state": "idle"}}, queue.ATTENTION, "recovery-unknown-outcome", "a", ""),
    (at("printing", "a"), {"kind": "restart", "probe": {**ON, "filename": "a.gcode"}}, "printing", None, "a", ""),
    (at("printing", "a"), {"kind": "restart", "probe": {"online": False, "state": "printing"}}, queue.ATTENTION, "recovery-unknown-outcome", "a", ""),
    (at("bed_clear_running", "a"), {"kind": "restart", "probe": ON}, queue.ATTENTION, "bed-clear-failed", "a", ""),
    (at("awaiting_bed_clear", "a"), {"kind": "restart", "probe": ON}, "awaiting_bed_clear", None, "a", ""),
    (asked("print-failed"), {"kind": "restart", "probe": ON}, queue.ATTENTION, "print-failed", "a", "b"),
    (at("printing", "a", stopped=True), {"kind": "start", "probe": {"online": True, "state": "idle"}}, queue.ATTENTION, "recovery-unknown-outcome", "a", ""),
    (at("unmanaged"), {"kind": "assigned"}, "idle", None, None, ""),
]
REFUSED = [
    (at("printing", "a", "b"), {"kind": "claim"}),
    (at("idle", None, "a", paused=True), {"kind": "claim"}),
    (at("idle", None, "a", stopped=True), {"kind": "claim"}),
    (at("idle"), {"kind": "claim"}),
    (at("dispatching", "a"), {"kind": "dispatched", "id": "b"}),
    (at("dispatching", "a"), {"kind": "dispatch_failed", "id": "b"}),
    (at("idle"), {"kind": "completed"}),
    (at("idle"), {"kind": "bed_confirmed"}),
    (asked("dispatch-failed"), {"kind": "resolve", "answer": "resume"}),
    (asked("file-missing"), {"kind": "resolve", "answer": "use-current-file"}),
    (asked("bed-clear-failed"), {"kind": "resolve", "answer": "retry"}),
    (asked("file-missing"), {"kind": "accept_file", "sha256": "n", "sizeBytes": 1}),
    (at("idle"), {"kind": "nothing known"}),
]


@pytest.mark.parametrize("q, event, state, reason, current, waiting", LIFE)
def test_each_event(q, event, state, reason, current, waiting):
    before = json.dumps(q)
    got = queue.step(q, event)
    assert json.dumps(q) == before
    assert (got["state"], got["reason"], got["current"] and got["current"]["id"], [i["id"] for i in got["queue"]]) == (state, reason, current, list(waiting))
    assert (got["detail"] is None) == (reason is None)
    assert got["state"] in queue.STATES


@pytest.mark.parametrize("q, event", REFUSED)
def test_what_does_not_fit_is_refused(q, event):
    assert queue.step(q, event) is q


def test_history_details_and_files():
    done = queue.step(at("printing", "a"), {"kind": "completed", "at": 9})
    assert [(i["id"], i["status"], i["finishedAt"]) for i in done["history"]] == [("a", "completed", 9)]
    assert queue.step(at("printing", "a"), {"kind": "failed", "resumable": True})["detail"]["resumable"] is True
    gone = queue.step(at("printing", "a", "bc", paused=True, stopped=True), {"kind": "clear", "at": 3})
    assert [(i["id"], i["status"]) for i in gone["history"]] == [("a", "cancelled"), ("b", "removed"), ("c", "removed")]
    assert gone["paused"] and gone["stopped"]
    assert len(queue.step(at("idle", None, [str(i) for i in range(30)]), {"kind": "clear"})["history"]) == queue.HISTORY_MOST
    taken = queue.step(asked("file-changed", current=None) | {"current": item("a", library={"model": "m", "modelName": "M", "x": 1})}, {"kind": "accept_file", "sha256": "n1", "sizeBytes": 7, "by": "eve", "at": 4})["queue"][0]
    assert "library" not in taken and taken["libraryReplaced"] == {"model": "m", "modelName": "M"}
    assert (taken["file"]["originallyExpectedSha256"], taken["file"]["sha256"], taken["file"]["replacementAcceptedBy"]) == ("hash-a", "n1", "eve")
    twice = queue.step({**asked("file-changed"), "current": taken}, {"kind": "accept_file", "sha256": "n2", "sizeBytes": 8})["queue"][0]
    assert twice["file"]["originallyExpectedSha256"] == "hash-a"
    again = queue.retry_of(item("a", library={"model": "m"}, dispatchedAt=5, map={"0": 1}) | {"file": {**taken["file"], "root": "r"}}, 8)
    assert again == {"id": "a+retry", "status": "queued", "createdAt": 8, "retryOfItemId": "a", "library": {"model": "m"}, "map": {"0": 1}, "queuedBy": "alice", "file": {"name": "a.gcode", "sub": "", "root": "r", "sizeBytes": 7, "sha256": "n1"}}
    assert queue.step(asked("recovery-mismatch", stopped=True), {"kind": "resolve", "answer": "stop"})["reason"] == "recovery-mismatch"
    assert queue.step(at("dispatching", "a"), {"kind": "restart", "probe": {**ON, "filename": "z"}})["detail"]["filename"] == "z"


SCHEMA = "printer_id string, at bigint, event_id bigint, event string"


def test_stream_carries_on_after_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    first = [{"kind": "add", "id": "a"}, {"kind": "add", "id": "b"}, {"kind": "claim"}, {"kind": "dispatched", "id": "a"}]
    then = [{"kind": "restart", "probe": {"online": False}}, {"kind": "resolve", "answer": "skip"}, {"kind": "bed_confirmed", "by": "eve"}, {"kind": "claim"}, {"kind": "claim"}]

    def run(events, n):
        rows = [(p, n + i, n + i, json.dumps(e)) for p in "pq" for i, e in enumerate(events)]
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        done = queue.run_queues(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        done.awaitTermination()

    try:
        run(first, 0)
        run(then, 10)  # a new query from the checkpoint
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("printer_id", "event_id").collect()
    states = ["idle", "idle", "dispatching", "printing", queue.ATTENTION, "awaiting_bed_clear", "idle", "dispatching", "dispatching"]
    for p in "pq":
        rows = [r for r in got if r.printer_id == p]
        assert [r.state for r in rows] == states
        assert [r.waiting for r in rows] == [1, 2, 1, 1, 1, 1, 1, 0, 0]
        assert [r.refused for r in rows] == [False] * 8 + [True]
        assert json.loads(rows[6].audit)["followedItem"] == {"id": "a", "file": None, "status": "skipped"}


def test_a_table_gives_the_same_rows(spark):
    events = [(k, n, json.dumps(e)) for k in ("x", "y") for n, e in enumerate([{"kind": "add", "id": "a"}, {"kind": "claim"}, {"kind": "deferred", "id": "a"}, {"kind": "pause"}, {"kind": "claim"}])]
    rows = spark.createDataFrame([(k, n, n, e) for k, n, e in events], SCHEMA)
    got = {(r.printer_id, r.event_id): (r.state, r.waiting, r.refused) for r in queue.run_queues(rows).collect()}
    want = {}
    for key in ("x", "y"):
        q = queue.empty()
        for k, n, e in events:
            if k == key:
                after = queue.step(q, json.loads(e))
                want[k, n] = (after["state"], len(after["queue"]), after is q)
                q = after
    assert got == want
    assert queue.run_queues(rows.limit(0)).count() == 0
