"""Whitening of vectors by hierarchical SVD merging.

Every partition keeps its rows' number, sums, singular values and right singular
vectors, all of them; two such summaries merge by decomposing their scaled
vectors and one row more for the difference of their means. Summaries meet a few
at a time in rounds, so no task and not the driver holds more than a few of
them, whatever the number of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import matrix, usable, width_of

#: Rows that are decomposed at a time, and summaries that meet in one task of a round.
ROWS, MEET = 4096, 8
_SUMMARY = "n bigint, sums array<bigint>, s binary, vt binary"
#: A component counts as without variance below this share of the largest eigenvalue.
FLAT = 1e-13


@dataclass
class Summary:
    """Rows' number, exact sums, singular values of the centred rows and their right vectors, full rank."""

    n: int
    sums: np.ndarray
    s: np.ndarray
    vt: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        """Of whole-numbered rows, which are centred in integers before anything is multiplied."""
        n, sums = len(x), x.sum(0)
        _, s, vt = np.linalg.svd((n * x - sums) / n, full_matrices=False)
        return cls(n, sums, s, vt)

    def merge(self, other: Summary) -> Summary:
        n = self.n + other.n
        origin = self.sums // self.n  # takes the common part off the means before they become floating point
        apart = (self.sums - self.n * origin) / self.n - (other.sums - other.n * origin) / other.n
        rows = np.vstack([self.s[:, None] * self.vt, other.s[:, None] * other.vt, np.sqrt(self.n / n * other.n) * apart[None]])
        _, s, vt = np.linalg.svd(rows, full_matrices=False)
        return Summary(n, self.sums + other.sums, s, vt)

    def row(self) -> tuple:
        return (self.n, self.sums.tolist(), self.s.tobytes(), self.vt.tobytes())

    @classmethod
    def from_row(cls, n: int, sums: list[int], s: bytes, vt: bytes) -> Summary:
        return cls(n, np.array(sums, np.int64), np.frombuffer(s), np.frombuffer(vt).reshape(-1, len(sums)))


@dataclass
class Whitening:
    """Summary of the fit list and its first components, by falling eigenvalue."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @classmethod
    def of(cls, told: Summary, most: int) -> Whitening:
        values = told.s**2 / told.n
        keep = min(most, int((values > FLAT * values.max(initial=0)).sum()))
        return cls(told.n, told.sums, values[:keep], told.vt[:keep], float(values.sum()))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n times the distance from the mean, exact; whole numbers of any size where a long might overflow."""
        if float(np.abs(x).max(initial=1)) * self.n * 2 >= 2**62:
            return x.astype(object) * self.n - self.sums.astype(object)
        return x * self.n - self.sums

    def apply(self, apart: np.ndarray) -> np.ndarray:
        return (apart / self.n).astype(float) @ self.vectors.T / np.sqrt(self.values)


def _told(parts: list[Summary]) -> pa.RecordBatch:
    rows = list(zip(*[p.row() for p in parts], strict=True)) or [()] * 4
    types = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["n", "sums", "s", "vt"])


def summarise(rows: DataFrame, width: int, column: str = "x") -> Summary | None:
    """One summary of all rows of whole-numbered lists of ``width`` entries; None if there are none."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = Summary.of(matrix(batch.column(column).slice(k, ROWS), width))
                total = part if total is None else total.merge(part)
        yield _told([] if total is None else [total])

    def meet(table: pa.Table) -> pa.Table:
        total = None
        for batch in table.to_batches(max_chunksize=1):
            part = Summary.from_row(*[batch.column(c)[0].as_py() for c in ("n", "sums", "s", "vt")])
            total = part if total is None else total.merge(part)
        return pa.Table.from_batches([_told([total])])

    told = stored(rows.select(column).mapInArrow(local, _SUMMARY), "summaries")
    left = told.count()
    while left > 1:
        groups = -(-left // MEET)
        dealt = told.withColumn("k", F.expr(f"monotonically_increasing_id() % {groups}"))
        told = stored(dealt.groupBy("k").applyInArrow(lambda t: meet(t.drop_columns("k")), _SUMMARY), "summaries")
        left = told.count()
    one = told.first()
    return None if one is None else Summary.from_row(one.n, one.sums, bytes(one.s), bytes(one.vt))


def identity_error(rows: DataFrame, whitening: Whitening, width: int, column: str = "x") -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, from a pass over the rows."""
    shared = rows.sparkSession.sparkContext.broadcast(whitening)
    most = len(whitening.values)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((most + 1, most))
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                w = shared.value.apply(shared.value.centred(matrix(batch.column(column).slice(k, ROWS), width)))
                total += np.vstack([w.T @ w, w.sum(0)[None]])
        at = np.arange(total.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "v"])

    got = rows.select(column).mapInArrow(sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((most + 1, most))
    for r in got:
        total.flat[r.at] = r.v
    mean = total[-1] / whitening.n
    return float(np.abs(total[:-1] / whitening.n - np.outer(mean, mean) - np.eye(most)).max(initial=0.0))


def whole_numbers(vector: Column, scale: float, shift: int, width: int) -> Column:
    """floor(scale * x) + shift of every component in double precision; shorter vectors are filled up with zeros first."""
    zeros = F.array_repeat(F.lit(shift).cast("bigint"), F.lit(width) - F.size(vector))
    return F.concat(F.transform(vector, lambda c: F.floor(c * F.lit(scale)).cast("bigint") + F.lit(shift)), zeros)


def whiten(vectors: DataFrame, most: int = 16, scale: float = 64.0, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component.

    The model is fitted on the distinct whole-numbered vectors, however often
    each comes up; every usable row is whitened, repeated and null ids
    included. Vectors that are null or hold null, NaN or infinity go; shorter
    ones count as filled up with zeros. Components without variance are left
    out, so equal vectors alone give no rows; nor does an empty table.
    ``deviation`` is null where it does not fit a long. Other columns are not
    read.
    """
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where(usable(F.col("v")))
    kind = vectors.schema[id_col].dataType.simpleString()
    width = width_of(rows, "v")
    items = rows.select("id", whole_numbers(F.col("v"), scale, shift, width).alias("x"))
    fit_list = stored(items.select("x").distinct(), "distinct")
    told = summarise(fit_list, width) if width else None
    schema = f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    model = Whitening.of(told, most) if told else None
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    model.identity_error = identity_error(fit_list, model, width)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Whitening = shared.value
        many = len(model.values)
        share = model.values / model.trace
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            apart, count = model.centred(matrix(batch.column("x"), width)), batch.num_rows
            if float(np.abs(apart).max(initial=0)) ** 2 * width >= 2**62:
                exact = [sum(int(v) ** 2 for v in row) for row in apart]
                deviation = pa.array([d if d < 2**63 else None for d in exact], pa.int64())
            else:
                deviation = pa.array((apart * apart).sum(1).astype(np.int64))
            each = pa.array(np.repeat(np.arange(count), many))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(each),
                    pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * many, model.n)),
                    deviation.take(each),
                    pa.array(model.apply(apart).ravel()),
                    pa.array(np.tile(share, count)),
                    pa.array(np.full(count * many, model.identity_error)),
                ],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return items.mapInArrow(run, schema)
