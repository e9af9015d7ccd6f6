"""Printer queues: a keyed state machine, its stream, and load balancing."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HISTORY_MOST = 20
ATTENTION = "queue_attention_required"

#: States of a queue.
STATES = ("unmanaged", "idle", "dispatching", "printing", "awaiting_bed_clear", "bed_clear_running", ATTENTION)

#: Why a person is asked, and what may be answered.
ANSWERS = {
    "print-failed": ("resume", "retry", "skip", "stop"),
    "dispatch-failed": ("retry", "skip", "stop"),
    "bed-clear-failed": ("retry-bed-clear", "skip-bed-clear", "stop"),
    "file-missing": ("skip", "stop"),
    "file-changed": ("skip", "stop"),
    "pool-invalid": ("stop",),
    "recovery-mismatch": ("acknowledge", "stop"),
    "recovery-interrupted": ("retry", "skip", "stop"),
    "recovery-unknown-outcome": ("resume", "retry", "skip", "stop"),
}

#: Reasons after which the bed is as it was, so it need not be cleared.
BED_UNTOUCHED = ("dispatch-failed", "file-missing", "file-changed")

#: What a retry takes over from an item, and from its file.
_OF_ITEM = ("library", "map", "prefs", "queuedBy")
_OF_FILE = ("name", "sub", "root", "sizeBytes", "sha256")


def empty(state: str = "idle") -> dict:
    return {"state": state, "paused": False, "stopped": False, "reason": None, "detail": None, "queue": [], "current": None, "history": []}


def _kept(history: list, *items: dict) -> list:
    return [*history, *items][-HISTORY_MOST:]


def _ends(q: dict, status: str, at: int, **more) -> dict:
    item = {**q["current"], "status": status, "finishedAt": at}
    return {**q, "current": item, "history": _kept(q["history"], item), **more}


def _asks(q: dict, reason: str, **detail) -> dict:
    return {**q, "state": ATTENTION, "reason": reason, "detail": {k: v for k, v in detail.items() if v is not None}}


def _answered(q: dict, state: str, **more) -> dict:
    return {**q, "state": state, "reason": None, "detail": None, **more}


def _file_name(q: dict) -> str | None:
    return ((q["current"] or {}).get("file") or {}).get("name")


def _claim(q: dict, e: dict) -> dict:
    if q["paused"] or q["stopped"] or not q["queue"]:
        return q
    return {**q, "state": "dispatching", "current": {**q["queue"][0], "status": "dispatching"}, "queue": q["queue"][1:]}


def _dispatched(q: dict, e: dict) -> dict:
    return {**q, "state": "printing", "current": {**q["current"], "status": "printing", "dispatchedAt": e.get("at", 0)}}


def _dispatch_failed(q: dict, e: dict) -> dict:
    return _asks(_ends(q, "failed", e.get("at", 0)), "dispatch-failed", code=e.get("code", "dispatch-error"), resumable=False)


def _deferred(q: dict, e: dict) -> dict:
    """The file could not be looked at: nothing is known to be wrong, so the claim is taken back."""
    return {**q, "state": "idle", "current": None, "queue": [{**q["current"], "status": "queued"}, *q["queue"]]}


def _print_failed(q: dict, e: dict) -> dict:
    return _asks(_ends(q, "failed", e.get("at", 0)), "print-failed", code=e.get("code", "print-failed"), resumable=bool(e.get("resumable")))


def retry_of(item: dict, at: int) -> dict:
    """A new item for the same work. Its id follows from the old one's, so that a batch run again names it alike."""
    again = {k: item[k] for k in _OF_ITEM if k in item}
    if item.get("file"):
        again["file"] = {k: item["file"][k] for k in _OF_FILE if k in item["file"]}
    return {**again, "id": f"{item['id']}+retry", "status": "queued", "createdAt": at, "retryOfItemId": item["id"]}


def _resolve(q: dict, e: dict) -> dict:
    answer, reason, item, at = e.get("answer"), q["reason"], q["current"], e.get("at", 0)
    if answer not in ANSWERS.get(reason, ()):
        return q
    if answer == "stop":  # what went wrong stays to be answered
        return {**q, "stopped": True}
    if answer == "resume":
        return _answered(q, "printing")
    if answer == "retry-bed-clear":
        return _answered(q, "awaiting_bed_clear")
    if answer in ("acknowledge", "skip-bed-clear"):
        return _answered(q, "idle", current=None)
    more: dict = {}
    if item and answer == "retry":
        more["queue"] = [retry_of(item, at), *q["queue"]]
    elif item:
        item = {**item, "status": "skipped", "finishedAt": at}
        more["history"] = _kept(q["history"], item)
    clean = reason in BED_UNTOUCHED
    return _answered(q, "idle" if clean else "awaiting_bed_clear", current=None if clean else item, **more)


def _accept_file(q: dict, e: dict) -> dict:
    """The changed file is printed instead: other content, so no longer the catalogued one; what was expected is kept."""
    if q["reason"] != "file-changed":
        return q
    item = {**q["current"], "status": "queued"}
    was = item.pop("library", None)
    if was:
        item["libraryReplaced"] = {k: was.get(k) for k in ("model", "modelName")}
    file = item.get("file") or {}
    item["file"] = {**file, "originallyExpectedSha256": file.get("originallyExpectedSha256") or file.get("sha256"), "sizeBytes": e.get("sizeBytes"), "sha256": e.get("sha256"), "replacementAcceptedBy": e.get("by"), "replacementAcceptedAt": e.get("at", 0)}
    return _answered(q, "idle", current=None, queue=[item, *q["queue"]])


def _clear(q: dict, e: dict) -> dict:
    at = e.get("at", 0)
    gone = [{**q["current"], "status": "cancelled", "finishedAt": at}] if q["current"] else []
    gone += [{**i, "status": "removed", "finishedAt": at} for i in q["queue"]]
    return _answered(q, "idle", queue=[], current=None, history=_kept(q["history"], *gone))


def reconciled(q: dict, probe: dict) -> dict:
    """The queue after a restart, by what the printer says: probe has online, state, filename.

    What was under way is only believed if the printer confirms it; a person is
    asked otherwise.
    """
    said = probe.get("state") if probe.get("online") else None
    file = probe.get("filename")
    if q["state"] == "dispatching":
        if said != "printing":
            return _asks(q, "recovery-interrupted", code="recovery-interrupted")
        if file and file == _file_name(q):
            return {**q, "state": "printing"}
        return _asks(q, "recovery-mismatch", code="recovery-mismatch", filename=file)
    if q["state"] == "printing" and not (said in ("printing", "paused") and (not file or file == _file_name(q))):
        return _asks(q, "recovery-unknown-outcome", code="recovery-unknown-outcome", resumable=said == "paused")
    if q["state"] == "bed_clear_running":
        return _asks(q, "bed-clear-failed", code="recovery-interrupted")
    return {**q}


#: (state, kind of event) → the queue after it. Events of the first group name the item they are about.
_ABOUT_ITEM: dict[tuple[str, str], Callable[[dict, dict], dict]] = {
    ("dispatching", "dispatched"): _dispatched,
    ("dispatching", "dispatch_failed"): _dispatch_failed,
    ("dispatching", "deferred"): _deferred,
    ("dispatching", "file_missing"): lambda q, e: _asks(q, "file-missing", **e.get("detail", {})),
    ("dispatching", "file_changed"): lambda q, e: _asks(q, "file-changed", **e.get("detail", {})),
}
_IN_STATE: dict[tuple[str, str], Callable[[dict, dict], dict]] = {
    ("unmanaged", "assigned"): lambda q, e: {**q, "state": "idle"},
    ("idle", "unassigned"): lambda q, e: {**q, "state": "unmanaged"},
    ("idle", "claim"): _claim,
    ("printing", "completed"): lambda q, e: _ends(q, "completed", e.get("at", 0), state="awaiting_bed_clear"),
    ("printing", "failed"): _print_failed,
    ("printing", "cancelled"): _print_failed,
    ("awaiting_bed_clear", "bed_clear_started"): lambda q, e: {**q, "state": "bed_clear_running"},
    ("awaiting_bed_clear", "bed_confirmed"): lambda q, e: {**q, "state": "idle", "current": None},
    ("bed_clear_running", "bed_cleared"): lambda q, e: {**q, "state": "idle", "current": None},
    ("bed_clear_running", "bed_clear_failed"): lambda q, e: _asks(q, "bed-clear-failed", code=e.get("code", "bed-clear-error"), resumable=False),
    (ATTENTION, "resolve"): _resolve,
    (ATTENTION, "accept_file"): _accept_file,
}
_ANYWHERE: dict[str, Callable[[dict, dict], dict]] = {
    "add": lambda q, e: {**q, "queue": [*q["queue"], {"id": e["id"], "status": "queued", "createdAt": e.get("at", 0), **{k: e[k] for k in ("file", *_OF_ITEM) if k in e}}]},
    "remove": lambda q, e: {**q, "queue": [i for i in q["queue"] if i["id"] != e["id"]]} if any(i["id"] == e["id"] for i in q["queue"]) else q,
    "pause": lambda q, e: {**q, "paused": True},
    "resume": lambda q, e: {**q, "paused": False},
    "stop": lambda q, e: {**q, "stopped": True},
    "start": lambda q, e: {**reconciled(q, e.get("probe", {})), "stopped": False},
    "restart": lambda q, e: reconciled(q, e.get("probe", {})),
    "clear": _clear,
    "pool_invalid": lambda q, e: _asks(q, "pool-invalid"),
    "pool_reassigned": lambda q, e: _answered(q, "idle") if q["state"] == ATTENTION and q["reason"] == "pool-invalid" else {**q},
}


def step(q: dict, event: dict) -> dict:
    """The queue after an event. One that does not fit is refused: the very same dict comes back."""
    at = (q["state"], event["kind"])
    if at in _ABOUT_ITEM:
        about = event.get("id")
        return _ABOUT_ITEM[at](q, event) if q["current"] and q["current"]["id"] == about else q
    rule = _IN_STATE.get(at) or _ANYWHERE.get(event["kind"])
    return rule(q, event) if rule else q


_TOLD = "printer_id string, event_id bigint, state string, reason string, waiting int, current string, refused boolean, audit string"


class Queues(StatefulProcessor):
    """State by printer: the items that wait in a list, all else (bounded) in a value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "q string")
        self.waiting = handle.getListState("waiting", "item string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "event_id"], kind="stable")
        head = self.head.get()  # each call to the store is a round trip to the JVM
        q = json.loads(head[0]) if head else empty()
        before = [i[0] for i in self.waiting.get()] if head else []
        q["queue"] = [json.loads(i) for i in before]
        told = []
        for event_id, at, text in zip(events["event_id"], events["at"], events["event"], strict=True):
            event = {"at": int(at), **json.loads(text)}
            after = step(q, event)
            audit = None
            if event["kind"] == "bed_confirmed" and after is not q:
                followed = q["current"] and {"id": q["current"]["id"], "file": _file_name(q), "status": q["current"]["status"]}
                audit = json.dumps({"event": "manual-bed-clear-confirmed", "by": event.get("by"), "followedItem": followed, "queuePausedAtConfirmation": q["paused"]})
            told.append((str(key[0]), event_id, after["state"], after["reason"], len(after["queue"]), after["current"]["id"] if after["current"] else None, after is q, audit))
            q = after
        now = [json.dumps(i) for i in q.pop("queue")]
        self.head.update((json.dumps(q),))
        if now != before:
            if now:
                self.waiting.put([(i,) for i in now])
            else:
                self.waiting.clear()
        yield pd.DataFrame(told, columns=[c.split()[0] for c in _TOLD.split(", ")])

    def close(self) -> None:
        pass


def run_queues(events: DataFrame) -> DataFrame:
    """The state after each event of (printer_id, at, event_id, event JSON), a table or a stream.

    Within a micro-batch a printer's events are taken by (at, event_id). A
    stream's session needs the state store that keeps lists (RocksDB).
    """
    if not events.isStreaming:
        events.sparkSession.streams  # noqa: B018  state over a table needs the coordinator that comes with the first look at streams
    return events.groupBy("printer_id").transformWithStateInPandas(Queues(), _TOLD, "append", "none")


def balanced(printers: DataFrame) -> DataFrame:
    """(item, from_printer, to_printer): idle empty printers take the oldest item of the longest queue of their connector.

    printers: pool, printer_id, connector, idle, queue array<string> (oldest
    first). Recipients are served by id and do not give in the same round.
    """

    def share(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("printer_id")
        queues = {p: list(q) for p, q in zip(group["printer_id"], group["queue"], strict=True)}
        connector = dict(zip(group["printer_id"], group["connector"], strict=True))
        takers = [p for p, idle in zip(group["printer_id"], group["idle"], strict=True) if idle and not queues[p]]
        moved = []
        for taker in takers:
            donors = [p for p in queues if p not in takers and connector[p] == connector[taker] and queues[p]]
            if donors:
                donor = max(donors, key=lambda p: (len(queues[p]), [-ord(c) for c in p]))
                moved.append((queues[donor].pop(0), donor, taker))
        return pd.DataFrame(moved, columns=["item", "from_printer", "to_printer"])

    return printers.groupBy("pool").applyInPandas(share, "item string, from_printer string, to_printer string")


def claims(printers: DataFrame) -> DataFrame:
    """(printer_id, item): the item each printer's queue hands out in a round, at most one and only if it may.

    printers: printer_id, state, paused, stopped, queue array<string> (oldest
    first). A printer has one row, so two claims of an item cannot both win.
    """
    may = (F.col("state") == "idle") & ~F.col("paused") & ~F.col("stopped") & (F.size("queue") > 0)
    return printers.where(may).select("printer_id", F.col("queue")[0].alias("item"))


def bulk_applied(queues: DataFrame, wanted: DataFrame) -> DataFrame:
    """queues after one transaction over several printers: all of ``wanted`` (printer_id, queue) or, if one of them is unknown or busy, none."""
    known = queues.where("state <> 'dispatching'").select("printer_id")
    refused = wanted.join(known, "printer_id", "left_anti").agg((F.count("*") > 0).alias("_no"))
    new = wanted.select("printer_id", F.col("queue").alias("_q"))
    rows = queues.join(new, "printer_id", "left").crossJoin(F.broadcast(refused))  # one row
    return rows.withColumn("queue", F.when(~F.col("_no") & F.col("_q").isNotNull(), F.col("_q")).otherwise(F.col("queue"))).drop("_q", "_no")
