"""Decisions of people as a log: superseding, undo, history, links of prints, differences of settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .browse import first_by


def superseded(log: DataFrame) -> DataFrame:
    """Adds superseded_by: the next decision of the same subject and relation that is not withdrawn."""
    alive = F.when(F.col("withdrawn_at").isNull(), F.col("id"))
    later = Window.partitionBy("subject_key", "relation").orderBy("id").rowsBetween(1, Window.unboundedFollowing)
    return log.withColumn("superseded_by", F.first(alive, ignorenulls=True).over(later))


def undoable(actions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Actions with ``undoable``: not yet undone, and no later action decided on any of its subjects.

    actions: id, undone; decisions: action_id, subject_key.
    """
    last = decisions.join(actions.where("NOT undone").select(F.col("id").alias("action_id")), "action_id").withColumn("_last", F.max("action_id").over(Window.partitionBy("subject_key")))
    blocked = last.where("_last > action_id").select(F.col("action_id").alias("id")).distinct().withColumn("_blocked", F.lit(True))
    return actions.join(blocked, "id", "left").withColumn("undoable", ~F.col("undone") & F.col("_blocked").isNull()).drop("_blocked")


def undone(decisions: DataFrame, action: int, now: int) -> DataFrame:
    """The log after an action is undone: its decisions are withdrawn, nothing is deleted."""
    return decisions.withColumn("withdrawn_at", F.when((F.col("action_id") == action) & F.col("withdrawn_at").isNull(), now).otherwise(F.col("withdrawn_at")))


def linked_prints(prints: DataFrame, files: DataFrame) -> DataFrame:
    """(id, content_key, method, confidence): what was printed, by hash, else by place and stat, else by name.

    prints: id, sha256, root_id, rel_path, size, mtime_ms, name; files:
    content_key, sha256, root_id, rel_path, size, mtime_ms, name, state,
    generic. A name links only if it is one content's and says something.
    """
    order = [F.col("state") != "present", F.col("root_id"), F.col("rel_path")]
    f = files.withColumn("name", F.lower("name"))
    by_hash = first_by(prints.select("id", "sha256").join(f, "sha256"), ["id"], order).select("id", "content_key", F.lit("sha256").alias("method"), F.lit("exact").alias("confidence"), F.lit(0).alias("p"))
    spot = prints.select("id", "root_id", "rel_path", F.col("size").alias("s"), F.col("mtime_ms").alias("m")).join(f, ["root_id", "rel_path"]).where((F.col("s") == F.col("size")) & (F.abs(F.col("m") - F.col("mtime_ms")) < 1))
    by_spot = spot.select("id", "content_key", F.lit("location"), F.lit("high"), F.lit(1))
    names = f.where("NOT generic").groupBy("name").agg(F.count_distinct("content_key").alias("n"), F.min("content_key").alias("content_key"))
    by_name = prints.select("id", F.lower("name").alias("name")).join(names, "name").select("id", F.when(F.col("n") == 1, F.col("content_key")).alias("content_key"), F.lit("name"), F.when(F.col("n") == 1, "medium").otherwise("low"), F.lit(2))
    best = first_by(by_hash.union(by_spot).union(by_name), ["id"], [F.col("p"), F.col("content_key")]).drop("p")
    return prints.select("id").join(best, "id", "left").select("id", "content_key", F.coalesce("method", F.lit("none")).alias("method"), F.coalesce("confidence", F.lit("none")).alias("confidence"))


def print_stats(links: DataFrame) -> DataFrame:
    """(model_id, n, confirmed, by_name, last) of links that count: model_id, confidence, by_decision, ended_at."""
    sure = F.col("by_decision") | F.col("confidence").isin("exact", "high")
    counted = links.where(F.col("model_id").isNotNull() & (sure | (F.col("confidence") == "medium")))
    return counted.groupBy("model_id").agg(F.count("*").alias("n"), F.count_if(sure).alias("confirmed"), F.count_if(~sure).alias("by_name"), F.max("ended_at").alias("last"))


def refreshed_stats(old: DataFrame, links: DataFrame, touched: DataFrame) -> DataFrame:
    """Statistics with only the touched models counted anew; equals a full recount."""
    fresh = print_stats(links.join(touched, "model_id", "left_semi"))
    return old.join(touched, "model_id", "left_anti").unionByName(fresh)


def settings_diff(a: DataFrame, b: DataFrame, ignored: list[str], secret: Column) -> DataFrame:
    """(name, a, b) of settings that differ, over the keys of both; secret values are masked."""
    both = a.select("name", F.col("value").alias("a")).join(b.select("name", F.col("value").alias("b")), "name", "full_outer")
    rows = both.where(~F.col("name").isin(ignored) & ~F.col("a").eqNullSafe(F.col("b")))
    mask = lambda c: F.when(secret & F.col(c).isNotNull(), "•••").otherwise(F.col(c)).alias(c)
    return rows.select("name", mask("a"), mask("b"))


def disposition(exists: Column, same: Column, replace: Column, printing: Column) -> Column:
    """What to do with an upload."""
    return F.when(~exists, "write").when(same, "keep").when(printing, "refuse").when(replace, "replace").otherwise("ask")


def dispatch_idle(state: Column) -> Column:
    """Only states known to be idle are; an unknown one never is."""
    return F.coalesce(state.isin("idle", "complete", "cancelled"), F.lit(False))


def nearest_colour(rows: DataFrame, hex_: str, palette: list[tuple[str, str]]) -> DataFrame:
    """Adds ``colour``: the palette's name at the least squared distance, the first of equals."""
    part = lambda c, i: F.conv(F.substring(c, 2 + 2 * i, 2), 16, 10).cast("int")
    far = [sum(((part(F.col(hex_), i) - int(code[1 + 2 * i : 3 + 2 * i], 16)) ** 2 for i in range(3)), F.lit(0)) for _, code in palette]
    best = F.array_min(F.array(*[F.struct(d.cast("double").alias("d"), F.lit(n).alias("n"), F.lit(name).alias("name")) for n, (d, (name, _)) in enumerate(zip(far, palette, strict=True))]))
    return rows.withColumn("colour", best["name"])


def tray_list(slots: DataFrame, key: str, most: int = 64) -> DataFrame:
    """(key, trays): materials by 1-based slot up to the highest used, gaps null. slots: key, slot, material."""
    used = slots.where(F.col("slot").between(1, most))
    by = used.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "material"))).alias("m"), F.max("slot").alias("n"))
    return by.select(key, F.transform(F.sequence(F.lit(1), "n"), lambda i: F.try_element_at("m", i)).alias("trays"))


def decoded_boxes(rows: DataFrame, key: str) -> DataFrame:
    """(key, slot, material, hex) over boxes array<struct<serial, materials array<struct<type, color>>>>.

    Boxes without a serial are place-holders and go if some box has one; a colour is its last six digits.
    """
    some = F.exists("boxes", lambda b: F.coalesce(b["serial"], F.lit("")) != "")
    kept = F.when(some, F.filter("boxes", lambda b: F.coalesce(b["serial"], F.lit("")) != "")).otherwise(F.col("boxes"))
    each = rows.select(key, F.posexplode(F.flatten(F.transform(kept, lambda b: b["materials"]))).alias("slot", "x"))
    return each.select(key, "slot", F.col("x.type").alias("material"), F.concat(F.lit("#"), F.upper(F.right("x.color", F.lit(6)))).alias("hex"))


def health(rows: DataFrame) -> DataFrame:
    """(printer_id, issue) of status rows: throttled, disk_percent, fault, fan_flagged."""
    rules = [("throttled", F.col("throttled")), ("disk", F.col("disk_percent") >= 90), ("fault", F.col("fault").isNotNull()), ("fan", F.col("fan_flagged"))]
    return rows.select("printer_id", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))).alias("issue"))
