"""Status reports of several dialects in one schema; a machine's fault beats the state of its job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where each dialect's report holds a field, and what its states are called.
PATHS = {
    "moonraker": {
        "state": "$.print_stats.state", "message": "$.print_stats.message", "filename": "$.print_stats.filename", "elapsed": "$.print_stats.print_duration", "filament": "$.print_stats.filament_used",
        "progress": "$.virtual_sdcard.progress", "bed": "$.heater_bed.temperature", "hotend": "$.extruder.temperature", "layer": "$.print_stats.info.current_layer", "layers": "$.print_stats.info.total_layer", "fan": "$.fan.speed",
    },
    "bambu": {"state": "$.gcode_state", "filename": "$.subtask_name", "progress": "$.mc_percent", "bed": "$.bed_temper", "hotend": "$.nozzle_temper", "layer": "$.layer_num", "layers": "$.total_layer_num", "remaining": "$.mc_remaining_time", "fan": "$.cooling_fan_speed"},
    "flashforge": {"state": "$.status", "message": "$.errorMessage", "filename": "$.printFileName", "progress": "$.printProgress", "elapsed": "$.printDuration", "bed": "$.platTemp", "hotend": "$.rightTemp", "layer": "$.printLayer", "layers": "$.targetPrintLayer", "fan": "$.coolingFanSpeed"},
    "creality": {"state": "$.state", "filename": "$.printFileName", "progress": "$.printProgress", "elapsed": "$.printJobTime", "bed": "$.bedTemp0", "hotend": "$.nozzleTemp", "layer": "$.layer", "layers": "$.TotalLayer", "fan": "$.modelFanPct"},
}
STATES = {
    "moonraker": {"standby": "standby", "printing": "printing", "paused": "paused", "complete": "complete", "error": "error", "cancelled": "cancelled"},
    "bambu": {"IDLE": "standby", "PREPARE": "printing", "SLICING": "printing", "RUNNING": "printing", "PAUSE": "paused", "FINISH": "complete", "FAILED": "error"},
    "flashforge": {"ready": "standby", "heating": "printing", "printing": "printing", "pause": "paused", "completed": "complete", "cancel": "cancelled", "error": "error"},
    "creality": {"0": "standby", "1": "printing", "2": "complete", "3": "error", "4": "cancelled", "5": "paused"},
}
#: A job that ends in FAILED with this code, or none, was cancelled.
CANCELLED = 0x0300_400C
#: What a full fan and a whole job are in each dialect.
FULL_FAN = {"moonraker": 1.0, "bambu": 15.0, "flashforge": 100.0, "creality": 100.0}
WHOLE_JOB = {"moonraker": 1.0, "bambu": 100.0, "flashforge": 1.0, "creality": 100.0}


def rounded(x: Column) -> Column:
    """Half up, as a whole number."""
    return F.floor(x + 0.5).cast("bigint")


def fault(report: Column) -> Column:
    """(code, message) where the machine itself is down or in error, else null."""
    state = F.get_json_object(report, "$.webhooks.state")
    message = F.trim(F.coalesce(F.get_json_object(report, "$.webhooks.state_message"), F.lit("")))
    item = lambda code: F.struct(F.lit(code).alias("code"), message.alias("message"))
    return F.when(state == "shutdown", item("KLIPPER_SHUTDOWN")).when(state == "error", item("KLIPPER_ERROR"))


def normalised(report: Column, dialect: str) -> Column:
    """(state, message, error_code, filename, progress, elapsed, remaining, filament, bed, hotend, layer, layers, fan) of a JSON report.

    Progress, layers and the time that remains count for a job that runs: other
    states keep the values of the last one. What a report lacks is null, progress zero.
    """
    paths = PATHS[dialect]
    text = lambda f: F.get_json_object(report, paths[f]) if f in paths else F.lit(None).cast("string")
    number = lambda f: text(f).try_cast("double")
    table = F.create_map(*[F.lit(v) for pair in STATES[dialect].items() for v in pair])
    own = F.coalesce(F.try_element_at(table, text("state")), F.lit("unknown") if dialect == "bambu" else text("state"), F.lit("unknown"))
    if dialect == "bambu":
        code = F.coalesce(F.get_json_object(report, "$.print_error").try_cast("bigint"), F.lit(0))
        own = F.when((text("state") == "FAILED") & code.isin(0, CANCELLED), "cancelled").otherwise(own)
    broken = fault(report)
    state = F.when(broken.isNotNull(), "error").otherwise(own)
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number("progress"), F.lit(0.0)) / WHOLE_JOB[dialect]))
    busy = own.isin("printing", "paused")
    if dialect == "bambu":
        part = F.when(own == "complete", 1.0).when(text("state").isin("RUNNING", "PAUSE", "FAILED"), part).otherwise(0.0)
    in_job = lambda c: F.when(busy, c) if dialect == "bambu" else c
    fan = rounded(F.greatest(F.lit(0.0), F.least(F.lit(FULL_FAN[dialect]), number("fan"))) / FULL_FAN[dialect] * 100)
    return F.struct(
        state.alias("state"),
        F.coalesce(broken["message"], F.when(state == "error", text("message")), F.lit("")).alias("message"),
        F.coalesce(broken["code"], F.lit("")).alias("error_code"),
        F.coalesce(text("filename"), F.lit("")).alias("filename"),
        part.alias("progress"),
        number("elapsed").alias("elapsed"),
        F.when(busy & (number("remaining") >= 0), rounded(number("remaining") * 60)).alias("remaining"),
        number("filament").alias("filament"),
        rounded(number("bed")).alias("bed"),
        rounded(number("hotend")).alias("hotend"),
        in_job(number("layer").cast("int")).alias("layer"),
        in_job(number("layers").cast("int")).alias("layers"),
        F.when(number("fan").isNotNull(), fan).alias("fan"),
    )
