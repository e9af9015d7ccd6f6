"""Comparing listings with what is known: changes, moves, missing files, orphans, sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changes(listing: DataFrame, known: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """(key, change): new, vanished, changed or unchanged."""
    a, b = listing.select(F.col(key).alias("ka"), F.struct(*compared).alias("va")), known.select(F.col(key).alias("kb"), F.struct(*compared).alias("vb"))
    both = a.join(b, F.col("ka") == F.col("kb"), "full_outer")
    change = F.when(F.col("kb").isNull(), "new").when(F.col("ka").isNull(), "vanished").when(F.col("va").eqNullSafe(F.col("vb")), "unchanged").otherwise("changed")
    return both.select(F.coalesce("ka", "kb").alias(key), change.alias("change"))


def unique_by(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where("_n = 1").drop("_n")


def moves(vanished: DataFrame, new: DataFrame, print_: str, place: str) -> DataFrame:
    """(old, new) places of one fingerprint, only where each side has it once."""
    a = unique_by(vanished, print_).select(print_, F.col(place).alias("old_place"))
    return a.join(unique_by(new, print_).select(print_, F.col(place).alias("new_place")), print_)


def after_scan(files: DataFrame, seen: DataFrame, complete: bool, now: Column, grace_days: int = 30, key: str = "rel_path") -> DataFrame:
    """State after a scan: what a complete scan missed is missing; long missing files go."""
    if not complete:
        return files
    found = seen.select(key, F.lit(True).alias("_seen"))
    out = files.join(found, key, "left").withColumn("state", F.when(F.col("_seen"), "present").otherwise("missing")).drop("_seen")
    return out.where((F.col("state") == "present") | (F.col("last_seen") >= now - grace_days * 86_400_000))


def orphans(candidates: DataFrame, key: str, *used: DataFrame) -> DataFrame:
    for table in used:
        candidates = candidates.join(table.select(key), key, "left_anti")
    return candidates


def to_download(remote: DataFrame, synced: DataFrame, key: list[str]) -> DataFrame:
    """Remote files that no valid copy stands for: none yet, failed, or of another size or time."""
    done = synced.where("status = 'synced'").select(*key, F.col("remoteSize").alias("_s"), F.col("remoteModified").alias("_m"))
    joined = remote.join(done, key, "left")
    return joined.where(~(F.col("_s").eqNullSafe(F.col("size")) & F.col("_m").eqNullSafe(F.col("modified"))) | F.col("_s").isNull()).drop("_s", "_m")


def may_delete(remote: DataFrame, synced: DataFrame, key: list[str], cutoff: Column) -> DataFrame:
    """Remote files that were downloaded, whose local copy is verified, and that are older than the cutoff."""
    return remote.where(F.col("modified") < cutoff).join(synced.where("status = 'synced' AND local_verified").select(*key), key, "left_semi")


def identical(size_a: Column, size_b: Column, windows_a: Column, windows_b: Column) -> Column:
    """Same size and same windows; what cannot be verified is not identical."""
    return F.coalesce((size_a == size_b) & (F.size(windows_a) > 0) & (windows_a == windows_b), F.lit(False))


def evenly_spaced(size: Column, window: int, n: int) -> Column:
    """Starts of n windows spread over a file."""
    last = F.greatest(size - window, F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(last * i / max(n - 1, 1)).cast("bigint")))


def with_container_state(files: DataFrame) -> DataFrame:
    """Entries of an archive take the archive's state."""
    outer = files.select(F.col("id").alias("container_id"), F.col("state").alias("_outer"))
    return files.join(outer, "container_id", "left").withColumn("state", F.coalesce("_outer", "state")).drop("_outer")


def prefixes(path: Column) -> Column:
    """All folders above a path, the nearest last."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def in_folders(files: DataFrame, folders: DataFrame, by: tuple[str, ...] = (), path: str = "rel_path") -> DataFrame:
    """Every (file, classified folder above it), of the same ``by`` columns such as the root."""
    each = files.withColumn("folder", F.explode(prefixes(F.col(path))))
    return each.join(folders.select(*by, F.col("rel_path").alias("folder"), "class"), [*by, "folder"])


def follow_merges(models: DataFrame, hops: int = 10) -> DataFrame:
    """(id, target): where a chain of merges ends; null for a broken or longer chain."""
    step = models.select(F.col("id").alias("at"), F.col("merged_into").alias("next"))
    out = models.select("id", F.col("id").alias("at"))
    for _ in range(hops):
        out = out.join(step, "at", "left").select("id", F.coalesce("next", "at").alias("at"))
    ends = step.where("next IS NULL").select("at", F.col("at").alias("target"))
    return out.join(ends, "at", "left").select("id", "target")


def canonical(rows: DataFrame, aliases: DataFrame, key: str = "content_key") -> DataFrame:
    """Quick keys replaced by the full hashes that became known for them."""
    known = aliases.select(F.col("alias").alias(key), F.col("content_key").alias("_full"))
    return rows.join(known, key, "left").withColumn(key, F.coalesce("_full", key)).drop("_full")
