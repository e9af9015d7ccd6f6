"""Temporal queries: nearest and open rows, transitions, milestones, jobs, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..operators import temporal
from .registry import query
from .tables import table

#: Event types stand for a printer's states.
_STATE = "CASE event_type WHEN 'purchase' THEN 'printing' WHEN 'view' THEN 'paused' WHEN 'click' THEN 'complete' WHEN 'error' THEN 'error' ELSE 'idle' END"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("us", temporal.micros("ts"))


def status_rows(events: DataFrame) -> DataFrame:
    """Events read as status reports: printer_id, us, event_id, state, filename."""
    return events.select(F.col("user_id").alias("printer_id"), "us", "event_id", F.expr(_STATE).alias("state"), F.concat(F.lit("job"), F.floor(F.col("value") / 25).cast("string"), F.lit(".gcode")).alias("filename"))


@query("asof_nearest_event", """
WITH q AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'click'), e AS (SELECT event_id AS other, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'view'),
m AS (SELECT q.event_id, e.other, abs(q.us - e.us) AS apart, row_number() OVER (PARTITION BY q.event_id ORDER BY abs(q.us - e.us), e.other) AS r FROM q JOIN e ON q.user_id = e.user_id AND abs(q.us - e.us) <= 7200000000)
SELECT event_id, other, apart FROM m WHERE r = 1""")
def asof_nearest_event(spark, sf_dir):
    rows = _events(spark, sf_dir)
    left = rows.where("event_type = 'click'").select("event_id", "user_id", "us")
    right = rows.where("event_type = 'view'").select(F.col("event_id").alias("other"), "user_id", F.col("us").alias("other_us"))
    return temporal.nearest(left, right, ["user_id"], 7_200_000_000, "event_id", "us", "other", "other_us")


@query("open_job_outcome_pairing", """
SELECT event_id, start_id FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS start_id FROM events) WHERE event_type = 'error' AND start_id IS NOT NULL""")
def open_job_outcome_pairing(spark, sf_dir):
    rows = temporal.open_start(_events(spark, sf_dir), "user_id", ["us", "event_id"], F.col("event_type") == "purchase", "event_id")
    return rows.where("event_type = 'error' AND open_value IS NOT NULL").select("event_id", F.col("open_value").alias("start_id"))


@query("event_transitions", """
SELECT event_id, previous, event_type FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE previous <> event_type""")
def event_transitions(spark, sf_dir):
    return temporal.transitions(_events(spark, sf_dir), "user_id", ["us", "event_id"], "event_type").select("event_id", "previous", "event_type")


_JOB_EVENTS = f"""
WITH s AS (SELECT event_id, user_id, ts, {_STATE} AS state, 'job' || CAST(floor(value / 25) AS BIGINT) || '.gcode' AS filename FROM events),
p AS (SELECT *, lag(state) OVER w AS s0, lag(filename) OVER w AS f0 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS (SELECT event_id, CASE WHEN state = 'printing' AND (s0 NOT IN ('printing', 'paused') OR filename IS DISTINCT FROM f0) THEN 'print-started'
  WHEN state = 'complete' AND s0 <> 'complete' THEN 'print-completed' WHEN state = 'error' AND s0 <> 'error' THEN 'print-error' END AS event FROM p WHERE s0 IS NOT NULL)
SELECT event_id, event FROM e WHERE event IS NOT NULL"""


@query("status_job_events", _JOB_EVENTS)
def status_job_events(spark, sf_dir):
    return temporal.job_events(status_rows(_events(spark, sf_dir)), "printer_id", ["us", "event_id"], "state", "filename").select("event_id", "event")


@query("stream_transitions", _JOB_EVENTS)
def stream_transitions(spark, sf_dir):
    """The streaming detector over the same rows; equals the batch query."""
    from ..streaming.status import detect_in_batches

    return detect_in_batches(status_rows(_events(spark, sf_dir))).select("event_id", "event")


@query("event_milestones", """
SELECT user_id, event_type, m AS milestone, min(epoch_us(ts)) AS us FROM events, (SELECT unnest([25.0, 50.0, 75.0])::DOUBLE AS m) x WHERE value >= m GROUP BY 1, 2, 3""")
def event_milestones(spark, sf_dir):
    return temporal.milestones(_events(spark, sf_dir), ["user_id", "event_type"], "us", "value", (25.0, 50.0, 75.0))


@query("completion_stamp", """
WITH a AS (SELECT *, event_type IN ('click', 'view') AS i FROM events), b AS (SELECT *, CASE WHEN i AND NOT coalesce(lag(i) OVER w, false) THEN 1 ELSE 0 END AS st FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM b)
SELECT event_id, min(epoch_us(ts)) OVER (PARTITION BY user_id, g, i) AS since FROM c WHERE i""")
def completion_stamp(spark, sf_dir):
    inside = F.col("event_type").isin("click", "view")
    return temporal.entered_at(_events(spark, sf_dir), "user_id", ["us", "event_id"], "us", inside).where("since IS NOT NULL").select("event_id", "since")


@query("last_start_per_user", "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def last_start_per_user(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("flag_seen_twice", """
SELECT event_id, b AND coalesce(p, false) AS flagged FROM (SELECT event_id, value > 60 AS b, lag(value > 60) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)""")
def flag_seen_twice(spark, sf_dir):
    return temporal.twice_running(_events(spark, sf_dir), "user_id", ["us", "event_id"], F.col("value") > 60).select("event_id", "flagged")


@query("heater_states", """
WITH a AS (SELECT event_id, user_id, ts, epoch_us(ts) // 1000000 AS s, value, user_id % 3 * 20.0 AS target FROM events), i AS (SELECT *, target > 0 AND abs(value - target) <= 15 AS n FROM a),
b AS (SELECT *, CASE WHEN n AND NOT coalesce(lag(n) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) THEN 1 ELSE 0 END AS st FROM i),
c AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM b), d AS (SELECT *, CASE WHEN n THEN min(s) OVER (PARTITION BY user_id, g, n) END AS since FROM c)
SELECT event_id, CASE WHEN target <= 0 THEN 'idle' WHEN n AND s - since >= 3600 THEN 'stable' WHEN n THEN 'settling' WHEN value < target THEN 'heating' ELSE 'cooling' END AS heater FROM d""")
def heater_states(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("s", F.floor(F.col("us") / 1000000)).withColumn("target", F.col("user_id") % 3 * F.lit(20.0))
    return temporal.heater_state(rows, "user_id", ["us", "event_id"], "s", "value", "target", 15, 3600).select("event_id", "heater")


@query("event_sessions_jobs", """
WITH e AS (SELECT event_id, user_id, ts, epoch_us(ts) // 1000 AS ms, event_type = 'purchase' AS st, 'job' || CAST(floor(value / 25) AS BIGINT) AS f,
  CASE event_type WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'cancelled' END AS oc FROM events WHERE event_type <> 'signup'),
b AS (SELECT *, coalesce(lag(st) OVER w, false) AS ps, lag(ms) OVER w AS pm, lag(f) OVER w AS pf FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
c AS (SELECT *, NOT st AND ps AND (pf = f OR ms - pm < 259200000) AS cl FROM b),
d AS (SELECT *, coalesce(lead(cl) OVER w, false) AS nc, lead(ms) OVER w AS nm, lead(oc) OVER w AS noc FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id))
SELECT 'audit:' || event_id AS job_key, user_id AS printer_id, coalesce(CASE WHEN st THEN ms END, -1) AS started_at, coalesce(CASE WHEN NOT st THEN ms WHEN nc THEN nm END, -1) AS ended_at,
  CASE WHEN NOT st THEN oc WHEN nc THEN noc WHEN nm IS NULL AND 1706659200000 - ms < 259200000 THEN 'printing' ELSE 'unknown' END AS outcome FROM d WHERE st OR NOT cl""")
def event_sessions_jobs(spark, sf_dir):
    rows = _events(spark, sf_dir).where("event_type <> 'signup'")
    event = F.expr("CASE event_type WHEN 'purchase' THEN 'print-started' WHEN 'click' THEN 'print-completed' WHEN 'error' THEN 'print-error' ELSE 'print-cancelled' END")
    log = rows.select(F.col("event_id").alias("id"), F.floor(F.col("us") / 1000).alias("ts"), event.alias("event"), F.col("user_id").alias("printer_id"), F.concat(F.lit("job"), F.floor(F.col("value") / 25).cast("string"), F.lit(".gcode")).alias("file"), F.col("value").alias("elapsed_sec"))
    found = temporal.jobs(log, 1_706_659_200_000)
    return found.select("job_key", "printer_id", F.coalesce("started_at", F.lit(-1)).alias("started_at"), F.coalesce("ended_at", F.lit(-1)).alias("ended_at"), "outcome")


@query("job_stats_per_user", "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE value > 20) AS confirmed, max(event_id) AS last FROM events WHERE event_type = 'purchase' GROUP BY 1")
def job_stats_per_user(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 20).alias("confirmed"), F.max("event_id").alias("last"))


@query("latest_known_fields", """
SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS bed, last_value(CASE WHEN event_type = 'view' THEN props END IGNORE NULLS) OVER w AS message
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def latest_known_fields(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("bed", F.expr("CASE WHEN event_type = 'click' THEN value END")).withColumn("message", F.expr("CASE WHEN event_type = 'view' THEN props END"))
    return temporal.latest_known(rows, "user_id", ["us", "event_id"], ["bed", "message"]).select("event_id", "bed", "message")


@query("conversation_fold", """
SELECT conv_id, max(turn) AS last_turn, arg_max(text, turn) FILTER (WHERE role = 'user') AS user_text, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS assistant_text FROM conversations GROUP BY 1""")
def conversation_fold(spark, sf_dir):
    of = lambda role: F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), of("user").alias("user_text"), of("assistant").alias("assistant_text"))


@query("turn_history_bounded", """
SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4""")
def turn_history_bounded(spark, sf_dir):
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf_dir, "conversations").withColumn("r", F.row_number().over(last)).where("r <= 4").select("conv_id", "turn")


@query("turn_gaps", "SELECT conv_id, turn, gap FROM (SELECT conv_id, turn, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS gap FROM conversations) WHERE gap IS NOT NULL")
def turn_gaps(spark, sf_dir):
    gap = F.col("turn") - F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", gap.alias("gap")).where("gap IS NOT NULL")


@query("debounced_values")
def debounced_values(spark, sf_dir):
    """An ordered fold without SQL form; tests hold it against a plain loop."""
    return temporal.debounced(_events(spark, sf_dir).select("event_id", "user_id", "us", "value"), "user_id", ["us", "event_id"], "value").select("event_id", "shown")


@query("remaining_and_state", """
SELECT event_id, CASE WHEN value > 0 AND value <= 100 THEN 60 * (1 / (value / 100) - 1) END AS remaining, CASE event_type WHEN 'purchase' THEN 'printing' WHEN 'view' THEN 'paused' ELSE 'unknown' END AS state FROM events""")
def remaining_and_state(spark, sf_dir):
    dialect = F.expr("CASE event_type WHEN 'purchase' THEN 'RUNNING' WHEN 'view' THEN 'PAUSE' ELSE 'other' END")
    return table(spark, sf_dir, "events").select("event_id", codes.remaining(F.lit(60), F.col("value") / 100).alias("remaining"), codes.common_state(dialect).alias("state"))
