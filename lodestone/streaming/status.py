"""Stateful streams of printer status: merged deltas, transitions, milestones.

State is kept per printer by ``applyInPandasWithState``; within a micro-batch
rows are taken in the order (us, event_id), so a stream over a bounded source
gives what the batch operators give.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.storage import shared_folder

_EVENTS = "printer_id bigint, event_id bigint, us bigint, event string"
_STATE = "state string, filename string, milestones string"
#: States in which a job goes on, and the events of the states that end one.
_RUNNING = ("printing", "paused")
_ENDS = {"complete": "print-completed", "error": "print-error", "cancelled": "print-cancelled"}


def step(previous: tuple[str, str] | None, state: str, filename: str) -> str | None:
    """The event that a report brings; None on the first one, which only seeds."""
    if previous is None:
        return None
    if state == "printing":
        return "print-started" if previous[0] not in _RUNNING or previous[1] != filename else None
    return _ENDS.get(state) if previous[0] != state else None


def _detect(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values(["us", "event_id"], kind="stable")
    previous = state.get[:2] if state.exists else None
    out = []
    for event_id, us, now, filename in zip(rows["event_id"], rows["us"], rows["state"], rows["filename"], strict=True):
        event = step(previous, now, filename)
        if event:
            out.append((key[0], event_id, us, event))
        previous = (now, filename)
    state.update((*previous, "[]"))
    yield pd.DataFrame(out, columns=["printer_id", "event_id", "us", "event"])


def detect(status: DataFrame) -> DataFrame:
    """Job events of a stream of (printer_id, us, event_id, state, filename)."""
    return status.groupBy("printer_id").applyInPandasWithState(_detect, _EVENTS, _STATE, "append", GroupStateTimeout.NoTimeout)


def detect_in_batches(status: DataFrame) -> DataFrame:
    """Run the stream over a bounded table until it has read all, and return what it wrote."""
    spark = status.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    status.write.parquet(f"{folder}/in")
    source = spark.readStream.schema(status.schema).parquet(f"{folder}/in")
    run = detect(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/marks").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(_EVENTS).parquet(f"{folder}/out")


def merged(old, new):
    """A partial report laid over the last one.

    Objects merge key by key. Lists whose items have an id merge by it, an item
    that is only an id resets what was known of it; other lists and values are
    replaced.
    """
    if isinstance(old, dict) and isinstance(new, dict):
        return {**old, **{k: merged(old[k], v) if k in old else v for k, v in new.items()}}
    if isinstance(new, list) and new and all(isinstance(x, dict) and "id" in x for x in new) and isinstance(old, list):
        known = {x["id"]: x for x in old if isinstance(x, dict) and "id" in x}
        for item in new:
            known[item["id"]] = item if len(item) == 1 or item["id"] not in known else merged(known[item["id"]], item)
        return list(known.values())
    return new


def _merge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values(["us", "event_id"], kind="stable")
    report = json.loads(state.get[0]) if state.exists else None
    out = []
    for event_id, us, kind, payload in zip(rows["event_id"], rows["us"], rows["kind"], rows["payload"], strict=True):
        if kind == "reset":  # the connection was lost: wait for a new baseline
            report = None
        elif kind == "baseline":
            report = json.loads(payload)
        elif report is not None:
            report = merged(report, json.loads(payload))
        if report is not None:
            out.append((key[0], event_id, us, json.dumps(report, sort_keys=True)))
    state.update((json.dumps(report),))
    yield pd.DataFrame(out, columns=["printer_id", "event_id", "us", "report"])


def merge_reports(deltas: DataFrame) -> DataFrame:
    """Whole reports of a stream of (printer_id, us, event_id, kind, payload); kind: baseline, delta or reset."""
    return deltas.groupBy("printer_id").applyInPandasWithState(_merge, "printer_id bigint, event_id bigint, us bigint, report string", "report string", "append", GroupStateTimeout.NoTimeout)


def _reach(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values(["us", "event_id"], kind="stable")
    filename, done = (state.get[1], json.loads(state.get[2])) if state.exists else (None, None)
    out = []
    for us, name, progress in zip(rows["us"], rows["filename"], rows["progress"], strict=True):
        passed = [m for m in (25, 50, 75) if progress >= m]
        if done is None:  # first sight: what was passed before is not news
            filename, done = name, passed
        elif name != filename:
            filename, done = name, []
        for m in passed:
            if m not in done:
                out.append((key[0], name, m, us))
        done = sorted({*done, *passed})
    state.update(("", filename, json.dumps(done)))
    yield pd.DataFrame(out, columns=["printer_id", "filename", "milestone", "us"])


def milestones(status: DataFrame) -> DataFrame:
    """Each mark of a job's progress once, from (printer_id, us, event_id, filename, progress)."""
    return status.groupBy("printer_id").applyInPandasWithState(_reach, "printer_id bigint, filename string, milestone bigint, us bigint", _STATE, "append", GroupStateTimeout.NoTimeout)
