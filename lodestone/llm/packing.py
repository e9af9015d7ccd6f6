"""Best-fit packing of token sequences by a configuration linear program.

The program's rows are the piece lengths of the whole corpus (at most the
capacity many), its columns the ways to fill a sequence. Multiplicative
weights price the lengths, a knapsack over the capacity finds the best column
for the prices, and the fractional solution is rounded down; what is left over
is packed column by column and then best-fit. Only the histogram comes to the
driver; pieces find their place by length and rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored
from .vocab import library_encoder

Config = tuple[tuple[int, int], ...]  # (length, how many), lengths descending


def best_column(weight: np.ndarray, capacity: int) -> dict[int, int]:
    """Unbounded knapsack: the multiset of lengths of most weight that fits. weight[l] <= 0: l is not used."""
    price = np.where(weight > 0, weight, -np.inf)
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int32)
    for c in range(1, capacity + 1):
        gain = best[c - 1 :: -1] + price[1 : c + 1]
        at = int(gain.argmax())
        if gain[at] > best[c - 1]:
            best[c], pick[c] = gain[at], at + 1
        else:
            best[c] = best[c - 1]
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        if pick[c]:
            out[int(pick[c])] = out.get(int(pick[c]), 0) + 1
            c -= int(pick[c])
        else:
            c -= 1
    return out


def fractional(number: np.ndarray, capacity: int, rounds: int, step: float = 0.25) -> tuple[dict[Config, float], np.ndarray]:
    """Columns with their fractional uses, covering every length's number, and the final prices."""
    have = number > 0
    cover, use = np.zeros(len(number)), {}
    safe = np.where(have, number, 1)
    price = np.zeros(len(number))
    for _ in range(rounds):
        part = cover[have] / safe[have]
        price[:] = 0
        price[have] = np.exp(-(part - part.min()) / step) / safe[have]
        column = best_column(price, capacity)
        if not column:
            break
        amount = step * min(number[x] / k for x, k in column.items())
        key = tuple(sorted(column.items(), reverse=True))
        use[key] = use.get(key, 0.0) + amount
        for x, k in column.items():
            cover[x] += amount * k
    scale = 1 / max(float(np.median(cover[have] / number[have])), 1e-9) if have.any() else 1
    return {k: v * scale for k, v in use.items()}, price


def best_fit(left: np.ndarray, capacity: int) -> dict[Config, int]:
    """Best-fit decreasing on counts: equal sequences are handled together."""
    open_: dict[int, dict[Config, int]] = {}
    for x in np.flatnonzero(left)[::-1].tolist():
        n = int(left[x])
        for gap in sorted(g for g in open_ if g >= x):
            while n and open_.get(gap):
                config, k = open_[gap].popitem()
                take = min(k, n)
                if take < k:
                    open_[gap][config] = k - take
                n -= take
                grown = (*config[:-1], (x, config[-1][1] + 1)) if config[-1][0] == x else (*config, (x, 1))
                spot = open_.setdefault(gap - x, {})
                spot[grown] = spot.get(grown, 0) + take
            if not open_.get(gap):
                open_.pop(gap, None)
        while n:
            fit = min(capacity // x, n)
            times = n // fit
            spot = open_.setdefault(capacity - fit * x, {})
            spot[((x, fit),)] = spot.get(((x, fit),), 0) + times
            n -= fit * times
    out: dict[Config, int] = {}
    for group in open_.values():
        for config, k in group.items():
            out[config] = out.get(config, 0) + k
    return out


def plan(number: np.ndarray, capacity: int, rounds: int = 500) -> list[tuple[Config, int]]:
    """Columns and how often each is used; every length comes up exactly ``number`` times. number[0] is ignored."""
    number = number.astype(np.int64).copy()
    number[0] = 0
    full = int(number[capacity])
    number[capacity] = 0
    plain = best_fit(number, capacity)
    left, chosen = number.copy(), {}

    def take(config: Config, most: int) -> None:
        k = min([most, *(int(left[x]) // n for x, n in config)])
        if k > 0:
            chosen[config] = chosen.get(config, 0) + k
            for x, n in config:
                left[x] -= k * n

    if number.any() and len(plain) > 1:
        use, price = fractional(number, capacity, rounds)
        for config, amount in sorted(use.items(), key=lambda c: (-c[1], c[0])):
            take(config, int(amount))
        for _ in range(rounds):  # what rounding left: whole columns, those that fill best and take rare long pieces first
            total = int((left * np.arange(len(left))).sum())
            if total < 8 * capacity:
                break
            column = best_column(np.where(left > 0, np.arange(len(left)) * (1 + 0.01 * np.arange(len(left)) / capacity), 0), capacity)
            config = tuple(sorted(((x, min(n, int(left[x]))) for x, n in column.items()), reverse=True))
            if sum(x * n for x, n in config) < 0.999 * capacity:
                break
            take(config, 1 << 60)
        for config, k in best_fit(left, capacity).items():
            chosen[config] = chosen.get(config, 0) + k
    if not chosen or sum(chosen.values()) > sum(plain.values()):  # only where rounding cost more than the program gained
        chosen = plain
    out = sorted(chosen.items(), key=lambda c: (-c[1], c[0]))
    return ([(((capacity, 1),), full)] if full else []) + out


def slots(chosen: list[tuple[Config, int]], capacity: int) -> dict[int, np.ndarray]:
    """For each length, runs of ranks: (first rank, first sequence, pieces a sequence, offset of the first)."""
    runs: dict[int, list] = {}
    filled = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for config, times in chosen:
        offset = 0
        for x, n in config:
            runs.setdefault(x, []).append((filled[x], sequence, n, offset))
            filled[x] += n * times
            offset += n * x
        sequence += times
    return {x: np.array(r, np.int64).T for x, r in runs.items()}


def pack(docs: DataFrame, path: str, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and ``ids`` if ``keep_ids``.

    A document's ids are those of the library for ``path`` and then
    ``separator``; one of more than ``capacity`` ids is cut so that all its
    pieces but the first are full. A null or empty text is the separator alone;
    equal rows are packed each; an empty table gives no rows; other columns are
    not read. Pieces are cut once and written; ranks within a length are made
    from each task's counts, so no length meets in one task.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["k", "task", "rank", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = library_encoder(path), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "t"):
                ids, bounds = encoder.ids([t or "" for t in part.column("t").to_pylist()])
                rows, lists = [], []
                for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    own = np.append(ids[a:b], separator).astype("<u4")
                    begin, end, piece = 0, len(own) % capacity or capacity, 0
                    while begin < len(own):
                        size = end - begin
                        rows.append((d, seen[size], piece, begin, size, zlib.crc32(own[begin:end].tobytes())))
                        seen[size] += 1
                        if keep_ids:
                            lists.append(own[begin:end].astype(np.int32))
                        begin, end, piece = end, end + capacity, piece + 1
                d, rank, piece, begin, size, crc = np.array(rows, np.int64).T
                task = np.full(len(d), part.column("task")[0].as_py())
                columns = [part.column("k").take(pa.array(d)), *map(pa.array, (task, rank, piece.astype(np.int32), begin, size, crc))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(lists, pa.list_(pa.int32()))] * keep_ids, names)

    schema = f"k {kind}, task bigint, rank bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    source = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.spark_partition_id().cast("bigint").alias("task"))
    cuts = stored(source.mapInArrow(cut, schema), "pieces")

    tally = cuts.groupBy("task", "length").agg(F.count("*").alias("n"))
    number = np.zeros(capacity + 1, np.int64)
    for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        number[r.length] = r.n
    runs = docs.sparkSession.sparkContext.broadcast(slots(plan(number, capacity), capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = tally.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts_ = np.flatnonzero(np.diff(length[order])) + 1
            for at in np.split(order, cuts_) if len(order) else []:
                first, from_, each, begin = runs.value[int(length[at[0]])]
                run = np.searchsorted(first, rank[at], side="right") - 1
                nth = rank[at] - first[run]
                sequence[at] = from_[run] + nth // each[run]
                offset[at] = begin[run] + nth % each[run] * length[at]
            kept = [batch.column(c) for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [c for c in batch.schema.names if c != "rank"] + ["sequence_id", "offset"])

    tail = ["ids"] * keep_ids
    ranked = cuts.join(base, ["task", "length"]).select("k", "piece", "start", "length", "ids_crc32", *tail, (F.col("rank") + F.col("base")).alias("rank"))
    placed = ranked.mapInArrow(place, f"k {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids + ", sequence_id bigint, offset bigint")
    return placed.withColumnRenamed("k", id_col)
