"""Ordered operators over keyed events: nearest, open and last rows, transitions, debounce, sessions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], within: int, left_id: str, left_at: str, right_id: str, right_at: str) -> DataFrame:
    """Each left row's nearest right row of the same keys, at most ``within`` away; ties to the smaller id.

    Rows meet by time bucket, each left row with its bucket and both neighbours, so no key's rows are all paired.
    """
    bucket = lambda x: F.floor(F.col(x) / within)
    a = left.withColumn("_b", F.explode(F.array(*[bucket(left_at) + d for d in (-1, 0, 1)])))
    b = right.withColumn("_b", bucket(right_at))
    apart = F.abs(F.col(left_at) - F.col(right_at))
    near = a.join(b, [*keys, "_b"]).where(apart <= within).withColumn("apart", apart)
    return near.groupBy(left_id).agg(F.min(F.struct("apart", right_id)).alias("m")).select(left_id, F.col(f"m.{right_id}").alias(right_id), F.col("m.apart").alias("apart"))


def open_start(events: DataFrame, key: str, order: list[str], is_start: Column, value: str) -> DataFrame:
    """Adds ``open_value``: the latest start's value before or at each row, null after none."""
    window = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("open_value", F.last(F.when(is_start, F.col(value)), ignorenulls=True).over(window))


def transitions(rows: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Rows whose state differs from the one before, with ``previous``; the first row of a key only seeds."""
    window = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("previous", F.lag(state).over(window)).where(F.col("previous").isNotNull() & (F.col("previous") != F.col(state)))


#: States in which a job goes on.
RUNNING = ("printing", "paused")


def job_events(rows: DataFrame, key: str, order: list[str], state: str, filename: str) -> DataFrame:
    """print-started, -completed, -error or -cancelled at the rows where they happen.

    A start is printing entered from neither printing nor paused, or under
    another file name. The first row of a key only seeds.
    """
    window = Window.partitionBy(key).orderBy(*order)
    seen = rows.withColumn("_s", F.lag(state).over(window)).withColumn("_f", F.lag(filename).over(window))
    now, before = F.col(state), F.col("_s")
    started = (now == "printing") & (~before.isin(*RUNNING) | ~F.col(filename).eqNullSafe(F.col("_f")))
    event = F.when(started, "print-started")
    for end, name in (("complete", "print-completed"), ("error", "print-error"), ("cancelled", "print-cancelled")):
        event = event.when((now == end) & (before != end), name)
    return seen.withColumn("event", event).where(before.isNotNull() & F.col("event").isNotNull()).drop("_s", "_f")


def islands(rows: DataFrame, key: str, order: list[str], inside: Column) -> DataFrame:
    """Adds ``island``: numbers runs of rows that are inside; null outside."""
    window = Window.partitionBy(key).orderBy(*order)
    rows = rows.withColumn("_in", inside)
    begins = F.when(F.col("_in") & ~F.coalesce(F.lag("_in").over(window), F.lit(False)), 1).otherwise(0)
    number = F.sum("_b").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_b", begins).withColumn("island", F.when(F.col("_in"), number)).drop("_in", "_b")


def entered_at(rows: DataFrame, key: str, order: list[str], at: str, inside: Column) -> DataFrame:
    """Adds ``since``: when the current run inside began; cleared outside."""
    runs = islands(rows, key, order, inside)
    return runs.withColumn("since", F.when(F.col("island").isNotNull(), F.min(at).over(Window.partitionBy(key, "island")))).drop("island")


def twice_running(rows: DataFrame, key: str, order: list[str], bad: Column) -> DataFrame:
    """Adds ``flagged``: bad on this and the check before."""
    window = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_bad", bad).withColumn("flagged", F.col("_bad") & F.coalesce(F.lag("_bad").over(window), F.lit(False))).drop("_bad")


def heater_state(rows: DataFrame, key: str, order: list[str], at_seconds: str, temp: str, target: str, band: float = 3, settle: int = 30) -> DataFrame:
    """Adds ``heater``: idle, heating, cooling, settling, or stable once within the band for ``settle`` seconds."""
    inside = (F.col(target) > 0) & (F.abs(F.col(temp) - F.col(target)) <= band)
    rows = entered_at(rows, key, order, at_seconds, inside)
    held = F.col(at_seconds) - F.col("since") >= settle
    state = F.when(F.col(target) <= 0, "idle").when(inside & held, "stable").when(inside, "settling").when(F.col(temp) < F.col(target), "heating").otherwise("cooling")
    return rows.withColumn("heater", state).drop("since")


def milestones(rows: DataFrame, job: list[str], at: str, progress: str, marks: tuple[float, ...]) -> DataFrame:
    """(job, milestone, at): when a job's progress first reached each mark."""
    each = rows.withColumn("milestone", F.explode(F.array(*[F.lit(m) for m in marks]))).where(F.col(progress) >= F.col("milestone"))
    return each.groupBy(*job, "milestone").agg(F.min(at).alias(at))


def latest_known(deltas: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Each field's last value that is not null up to every row: one-level merging of partial reports."""
    window = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return deltas.select(key, *order, *[F.last(f, ignorenulls=True).over(window).alias(f) for f in fields])


def debounced(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Adds ``shown``: a change of more than one shows at once, a smaller one when it comes twice running."""
    schema = T.StructType([*rows.schema.fields, T.StructField("shown", T.DoubleType())])

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        shown, waiting, out = None, None, []
        for x in group[value].tolist():
            if x is None or x != x:
                out.append(shown)
                continue
            if shown is None or abs(x - shown) > 1:
                shown, waiting = x, None
            elif x == shown:
                waiting = None
            elif waiting == x:
                shown, waiting = x, None
            else:
                waiting = x
            out.append(shown)
        group["shown"] = pd.Series(out, index=group.index, dtype="float64")
        return group

    return rows.groupBy(key).applyInPandas(fold, schema)


#: The events that begin a job, and what those that end one mean.
STARTS = ("print-started", "queue-print-started")
OUTCOMES = {"print-completed": "completed", "print-error": "failed", "print-cancelled": "cancelled"}
TRUST_MS = 3 * 86_400_000


def jobs(events: DataFrame, now_ms: int) -> DataFrame:
    """Events (id, ts in ms, event, printer_id, file, elapsed_sec) folded into jobs.

    A start opens a job and ends an earlier open one unseen (unknown). An
    outcome closes the open job if the names agree or it began less than three
    days before; else it is a job whose start is not known. A printer's last
    start without an outcome is still printing if it is recent, else unknown.
    """
    order = Window.partitionBy("printer_id").orderBy("ts", "id")
    start = F.col("event").isin(*STARTS)
    outcome = F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair])
    name = F.lower(F.regexp_replace(F.regexp_replace("file", r"^.*[\\/]", ""), r"(?i)(\.gcode)?\.(gcode|gco|g|3mf|bgcode)$", ""))
    rows = events.where(start | F.col("event").isin(*OUTCOMES)).where("printer_id IS NOT NULL").withColumn("start", start).withColumn("name", F.coalesce(name, F.lit("")))
    # An outcome meets an open job exactly if the row before it is a start: any outcome closes or clears what was open.
    before = lambda c: F.lag(c).over(order)
    rows = rows.withColumn("opens", F.coalesce(before("start"), F.lit(False))).withColumn("o_ts", before("ts")).withColumn("o_name", before("name"))
    rows = rows.withColumn("closes", ~F.col("start") & F.col("opens") & ((F.col("o_name") == F.col("name")) | (F.col("ts") - F.col("o_ts") < TRUST_MS)))
    after = lambda c: F.lead(c).over(order)
    rows = rows.withColumn("n_closes", F.coalesce(after("closes"), F.lit(False))).withColumn("n_ts", after("ts")).withColumn("n_event", after("event")).withColumn("n_sec", after("elapsed_sec"))
    later_start = F.coalesce(F.max(F.when(F.col("start"), 1)).over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)) == 1
    any_after = F.col("n_ts").isNotNull()
    open_ = F.when(~later_start & ~any_after & (F.lit(now_ms) - F.col("ts") < TRUST_MS), "printing").otherwise("unknown")
    started = rows.where("start").select(
        F.concat(F.lit("audit:"), "id").alias("job_key"), "printer_id", "file", F.col("ts").alias("started_at"),
        F.when(F.col("n_closes"), F.col("n_ts")).alias("ended_at"), F.when(F.col("n_closes"), F.try_element_at(outcome, F.col("n_event"))).otherwise(open_).alias("outcome"),
        F.when(F.col("n_closes"), F.col("n_sec")).alias("elapsed_sec"),
    )
    orphan = rows.where("NOT start AND NOT closes").select(
        F.concat(F.lit("audit:"), "id").alias("job_key"), "printer_id", "file", F.lit(None).cast("bigint").alias("started_at"), F.col("ts").alias("ended_at"), F.try_element_at(outcome, F.col("event")).alias("outcome"), "elapsed_sec"
    )
    return started.unionByName(orphan)
