"""Listing: keyset paging, facets, top rows by priority, decoration after the limit."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written


def keyset_page(rows: DataFrame, sort: str, key: str, size: int, after: tuple | None = None, descending: bool = False) -> DataFrame:
    """The ``size`` rows after (sort, key), and one more, by which the caller knows that there is a next page."""
    order = [F.desc(sort), F.desc(key)] if descending else [F.asc(sort), F.asc(key)]
    if after is not None:
        here, there = F.struct(sort, key), F.struct(F.lit(after[0]).alias(sort), F.lit(after[1]).alias(key))
        rows = rows.where(here < there if descending else here > there)
    return rows.orderBy(*order).limit(size + 1)


def cursor(sort_value, key_value) -> str:
    return base64.urlsafe_b64encode(json.dumps([sort_value, key_value]).encode()).decode().rstrip("=")


def from_cursor(text: str) -> tuple:
    return tuple(json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))))


def facet(rows: DataFrame, value: str, item: str) -> DataFrame:
    """Exact number of distinct items for each value."""
    return rows.groupBy(value).agg(F.count_distinct(item).alias("n"))


def first_by(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group; the order must be total for a stable result."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_r = 1").drop("_r")


def top_within(rows: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def ranked(column: Column, *values: str) -> Column:
    """Place of a value in a list of descending worth; values not in it come last."""
    out = F.lit(len(values))
    for i, v in reversed(list(enumerate(values))):
        out = F.when(column == v, i).otherwise(out)
    return out


def best_claim(claims: DataFrame) -> DataFrame:
    """One claim a subject: by state, then by confidence, then by key."""
    return first_by(claims, ["subject_key"], [ranked(F.col("state"), "confirmed", "applied", "suggested", "recorded"), ranked(F.col("confidence"), "exact", "high", "medium", "low"), F.col("claim_key")])


def standing(decisions: DataFrame, subject: str = "subject_key") -> DataFrame:
    """The latest decision of each subject that is neither superseded nor withdrawn."""
    return first_by(decisions.where("superseded_by IS NULL AND withdrawn_at IS NULL"), [subject], [F.desc("id")])


# Kinds of review items that ask for an action, and those that ask for a look.
ACTION_KINDS = ("decision_unmatched", "file_changed", "unreadable_file")
REVIEW_KINDS = ("suggested_match", "unknown_printer", "missing_file", "source_offline", "source_may_match")
LEVELS = ("action", "review", "info")


def attention_level(kind: Column, subject_key: Column, confidence: Column) -> Column:
    """action, review or info for a review item.

    An ambiguous grouping is only told if it comes from a generic name or a
    nested folder, a print without a link if nothing is known of it.
    """
    quiet = (kind == "ambiguous_grouping") & F.coalesce(subject_key.rlike("^ambiguous:(generic|nested):"), F.lit(False)) | (kind == "unlinked_print") & F.coalesce(confidence == "none", F.lit(False))
    asks = kind.isin(*REVIEW_KINDS, "ambiguous_grouping", "unlinked_print")
    return F.when(kind.isin(*ACTION_KINDS), "action").when(asks & ~quiet, "review").otherwise("info")


def overridden(automatic: DataFrame, decided: DataFrame, key: str, value: str) -> DataFrame:
    """A person's value beats the automatic one; ``by_decision`` tells."""
    person = decided.select(key, F.col(value).alias("_p"))
    return automatic.join(person, key, "left").withColumn("by_decision", F.col("_p").isNotNull()).withColumn(value, F.coalesce("_p", value)).drop("_p")


def most_common(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Each group's most frequent value, ties to the smallest."""
    return first_by(rows.groupBy(group, value).agg(F.count("*").alias("n")), [group], [F.desc("n"), F.col(value)])


def floor_percentiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, n, a column for each share, most): the element floor(share * n) of a group's sorted values, the last at most.

    Values are counted, dealt to tasks by range and written; sums by range tell
    where a rank lies, so no group is sorted by one task. Nulls do not count.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    ranged = written(counted.repartitionByRange(group, value).withColumn("_range", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy(group, "_range").agg(F.sum("c").alias("_c"))
    before = Window.partitionBy(group).orderBy("_range")  # a row a range
    sums = sums.select(group, "_range", (F.sum("_c").over(before) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy(group)).alias("n"))
    upto = F.sum("c").over(Window.partitionBy(group, "_range").orderBy(value))
    placed = ranged.withColumn("_upto", upto).join(sums, [group, "_range"])
    at = lambda p: F.min(F.when(F.col("_before") + F.col("_upto") > F.least(F.floor(F.col("n") * p), F.col("n") - 1), F.col(value)))
    return placed.groupBy(group).agg(F.max("n").alias("n"), *[at(p).alias(name) for name, p in shares.items()], F.max(value).alias("most"))
