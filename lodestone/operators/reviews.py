"""Review items: who makes them, which models they are about, and how urgent they are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .browse import LEVELS, first_by, ranked

_FIELDS = ("kind", "subject_key", "content_key", "location", "model", "confidence", "priority")


def worst_levels(items: DataFrame, model: str = "model") -> DataFrame:
    """(model, level): the most urgent level of each model's items."""
    worst = F.min(ranked(F.col("level"), *LEVELS))
    return items.groupBy(model).agg(worst.alias("_l")).select(model, F.get(F.array(*[F.lit(x) for x in LEVELS]), F.col("_l")).alias("level"))


def availability(state: Column, root_enabled: Column, root_status: Column) -> Column:
    """ok, offline, missing or unreadable: a location out of reach is never a missing file."""
    offline = F.coalesce(~root_enabled | (root_status == "offline"), F.lit(False))
    return F.when(offline, "offline").when(state == "present", "ok").otherwise(state)


def item(rows: DataFrame, kind: str, subject: Column, priority: int, **fields: Column) -> DataFrame:
    """Rows as review items; fields that are not given are null."""
    given = {"kind": F.lit(kind), "subject_key": subject, "priority": F.lit(priority), **fields}
    return rows.select(*[given.get(f, F.lit(None)).cast("int" if f == "priority" else "string").alias(f) for f in _FIELDS])


def wanted(*producers: DataFrame) -> DataFrame:
    """All producers' items, one a subject: the one of the earliest producer."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("_n", F.lit(n)) for n, p in enumerate(producers)])
    return first_by(rows, ["subject_key"], [F.col("_n"), F.col("kind"), F.col("location"), F.col("content_key")]).drop("_n")


def file_items(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Missing files of locations within reach, unreadable files, and locations out of reach.

    files: root_id, rel_path, content_key, state, no entries; roots: id, status.
    """
    place = F.concat_ws(":", "root_id", "rel_path")
    known = files.join(roots.select(F.col("id").alias("root_id"), F.col("status").alias("root_status")), "root_id", "left")
    missing = item(known.where("state = 'missing' AND root_status IS NOT NULL AND root_status <> 'offline'"), "missing_file", F.concat(F.lit("missing:"), place), 3, content_key=F.col("content_key"), location=place)
    unreadable = item(known.where("state = 'unreadable'"), "unreadable_file", F.concat(F.lit("unreadable:"), place), 3, content_key=F.col("content_key"), location=place)
    offline = item(roots.where("status = 'offline'"), "source_offline", F.concat(F.lit("offline:"), "id"), 1, location=F.col("id"))
    return missing.unionByName(unreadable).unionByName(offline)


def decision_items(decisions: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """Decisions whose file changed in place or is gone; nothing is told while a location is unseen or an identity pending.

    decisions: id, subject_key, subject_hint (root:path where it was last seen);
    files: root_id, rel_path, content_key, sha256, state, no entries; roots: id,
    status, enabled, indexed, full_hash.
    """
    of_root = roots.select(F.col("id").alias("root_id"), "status", "enabled", "indexed", "full_hash")
    whole = roots.agg(F.coalesce(F.min((~F.col("enabled") | (F.col("status") == "offline") | F.col("indexed")).cast("int")), F.lit(1)).alias("whole"))
    there = files.where("state = 'present'").withColumn("place", F.concat_ws(":", "root_id", "rel_path"))
    pending = there.join(of_root, "root_id").where("sha256 IS NULL AND content_key LIKE 'q:%' AND full_hash = 'idle' AND enabled").agg((F.count("*") > 0).alias("pending"))
    gone = decisions.withColumn("key", F.substring_index("subject_key", "#", 1)).join(there.select(F.col("content_key").alias("key")).distinct(), "key", "left_anti")
    gone = gone.withColumn("root_id", F.when(F.contains("subject_hint", F.lit(":")), F.substring_index("subject_hint", ":", 1))).join(of_root, "root_id", "left")
    gone = gone.where("status IS NULL OR (status <> 'offline' AND indexed)").crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(pending)).where("whole = 1")  # one row each
    now = there.select(F.col("place").alias("subject_hint"), F.col("content_key").alias("now_key"), F.col("sha256").alias("now_hash"))
    rows = gone.join(now, "subject_hint", "left")
    verified = ~F.col("key").startswith("q:")
    changed = F.col("now_key").isNotNull()
    rows = rows.where(~(changed & F.col("now_hash").isNull() & verified) & ~(~changed & verified & F.col("pending")))
    id_ = F.col("id").cast("string")
    told = item(rows.where(changed), "file_changed", F.concat(F.lit("changed:"), id_), 2, content_key=F.col("now_key"), location=F.col("subject_hint"))
    return told.unionByName(item(rows.where(~changed), "decision_unmatched", F.concat(F.lit("decision:"), id_), 1, content_key=F.col("key"), location=F.col("subject_hint")))


def unresolved_sources(objects: DataFrame, files: DataFrame, claims: DataFrame) -> DataFrame:
    """(content_key, raw_name) of source references of files for which no source was found."""
    found = claims.where("relation = 'source_of'").select(F.col("object").alias("content_key")).distinct()
    rows = objects.where("origin = 'source_file'").join(files.select(F.col("id").alias("file_id"), "content_key"), "file_id")
    return rows.join(found, "content_key", "left_anti").select("content_key", "raw_name")


def empty_models(models: DataFrame, members: DataFrame) -> DataFrame:
    """Models in use that hold no file: neither hidden nor merged into another."""
    rows = models.where("NOT hidden AND merged_into IS NULL").join(members.select("model").distinct(), "model", "left_anti")
    return item(rows, "empty_model", F.concat(F.lit("empty:"), F.col("model").cast("string")), 3, model=F.col("model"))


def models_of(items: DataFrame, files: DataFrame, listed: DataFrame) -> DataFrame:
    """(subject_key, model): the models that an item is about, by itself, by its content, by its place, or by the files its evidence lists.

    items: subject_key, model, content_key, location; files: root_id, rel_path,
    content_key, model; listed: subject_key, location. Each way is an equi join.
    """
    at = files.where("model IS NOT NULL").select(F.concat_ws(":", "root_id", "rel_path").alias("location"), "content_key", "model")
    own = items.where("model IS NOT NULL").select("subject_key", "model")
    by_key = items.where("content_key IS NOT NULL").select("subject_key", "content_key").join(at.select("content_key", "model").distinct(), "content_key")
    by_place = items.where("location IS NOT NULL").select("subject_key", "location").unionByName(listed.select("subject_key", "location")).distinct().join(at.select("location", "model"), "location")
    kind = dict(files.dtypes)["model"]
    return own.select("subject_key", F.col("model").cast(kind).alias("model")).unionByName(by_key.select("subject_key", "model")).unionByName(by_place.select("subject_key", "model")).distinct()
