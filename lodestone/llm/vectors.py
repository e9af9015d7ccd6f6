"""Helpers for tables of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def width_of(vectors: DataFrame, column: str) -> int:
    """The longest vector's length; shorter ones are taken as filled up with zeros."""
    return vectors.agg(F.max(F.size(column))).first()[0] or 0


def filled(vector: Column, width: int) -> Column:
    return F.concat(vector, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(vector)))


def matrix(column, width: int) -> np.ndarray:
    """Rows of a list column whose lists are all ``width`` long."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), width)


def dealt(rows: DataFrame, group: str, key: str, most: int, name: str) -> tuple[DataFrame, dict[int, int]]:
    """Add column ``name``: each group's rows dealt by a hash of ``key`` into blocks of about ``most``; also the groups' numbers of blocks.

    ``group`` takes a bounded number of values.
    """
    blocks = {r[0]: -(-r[1] // most) for r in rows.groupBy(group).count().collect()}
    number = F.get(F.array(*[F.lit(blocks.get(g, 1)) for g in range(max(blocks, default=0) + 1)]), F.col(group))
    return rows.withColumn(name, F.pmod(F.xxhash64(key), number).cast("int")), blocks


def to_all_blocks(rows: DataFrame, group: str, blocks: dict[int, int], name: str) -> DataFrame:
    """Each row once for every block of its group; rows of a group without blocks go."""
    number = F.get(F.array(*[F.lit(blocks.get(g, 0)) for g in range(max(blocks, default=0) + 1)]), F.col(group))
    rows = rows.withColumn("_n", F.coalesce(number, F.lit(0))).where("_n > 0")
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
