"""Queries over an append-only event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matching(events: DataFrame, equals: dict | None = None, since=None, until=None, text: str | None = None, text_columns: tuple[str, ...] = (), ts: str = "ts") -> DataFrame:
    """Rows that meet all given conditions; a condition that is None is not asked for.

    Free text is found in any of the columns whatever its case; % and _ in it are wildcards.
    """
    for column, value in (equals or {}).items():
        if value is not None:
            events = events.where(F.col(column) == value)
    if since is not None:
        events = events.where(F.col(ts) >= since)
    if until is not None:
        events = events.where(F.col(ts) <= until)
    if text is not None:
        found = F.lit(False)
        for column in text_columns:
            found = found | F.ilike(F.col(column), F.lit(f"%{text}%"))
        events = events.where(found)
    return events


def newest_page(events: DataFrame, limit: int, offset: int = 0, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """One page, newest first, ties by key; at most 500 rows."""
    return events.orderBy(F.desc(ts), F.desc(key)).offset(max(0, offset)).limit(min(500, max(1, limit)))


def retained(events: DataFrame, now: Column, days: int, ts: str = "ts") -> DataFrame:
    return events.where(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def histogram(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def capability(grants: DataFrame) -> DataFrame:
    """(user_id, capability, allowed): a user's own grant, else the groups' (deny wins), else the role's, else no.

    grants: user_id, capability, level (user, group or role), allowed.
    """
    of = lambda level: F.when(F.col("level") == level, F.col("allowed"))
    return grants.groupBy("user_id", "capability").agg(F.coalesce(F.bool_and(of("user")), F.bool_and(of("group")), F.bool_and(of("role")), F.lit(False)).alias("allowed"))


def visible(rows: DataFrame, groups: list[str], admin: bool = False, column: str = "allowed_groups", default: str = "default") -> DataFrame:
    """Rows that share a group with the user; rows without groups belong to the default one. Admins see all."""
    if admin:
        return rows
    return rows.where(F.arrays_overlap(F.coalesce(F.col(column), F.array(F.lit(default))), F.array(*[F.lit(g) for g in groups]) if groups else F.array().cast("array<string>")))


def diagnostics(rows: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """One row: the number of rows, a map of counts for each key (null as (none)), and how many rows meet each flag.

    All histograms come from one pass: rows are counted by (key, value) before they meet.
    """
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(F.col(k).cast("string"), F.lit("(none)")).alias("v")) for k in keys])).alias("x"))
    counted = each.groupBy("x.k", "x.v").agg(F.count("*").alias("n"))
    one = lambda k: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("k") == k, F.struct("v", "n"))))).alias(k)
    flagged = rows.agg(F.count("*").alias("rows"), *[F.count_if(c).alias(name) for name, c in flags.items()])
    return counted.agg(*[one(k) for k in keys]).crossJoin(F.broadcast(flagged))  # one row each


def idle_since(probes: DataFrame, key: str, at: str, now: Column, limit: Column) -> DataFrame:
    """Keys whose last probe is longer ago than the limit: connections to drop."""
    return probes.groupBy(key).agg(F.max(at).alias(at)).where(now - F.col(at) > limit)
