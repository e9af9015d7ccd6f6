"""The hashing pass: fingerprints and full hashes of files by ranged reads, within a budget.

Nothing is told of a file that changed while it was read. A pass only takes what
has no hash yet, smallest first, so a pass that was cut short is carried on by
the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

#: Bytes of a fingerprint's windows, and of a full hash's reads.
WINDOW, CHUNK = 64 << 10, 4 << 20


def window_starts(size: int, window: int = WINDOW) -> list[int]:
    """Where the windows at a file's head, middle and tail begin; equal ones count once."""
    return sorted({0, max(0, size // 2 - window // 2), max(0, size - window)})


def ranged_fingerprint(read_at: Callable[[int, int], bytes], size: int, window: int = WINDOW) -> str:
    digest = hashlib.sha256(f"{size}:".encode())
    for at in window_starts(size, window):
        digest.update(read_at(at, min(window, size - at)))
    return digest.hexdigest()[:32]


def within_budget(files: DataFrame, most: int, order: list[str], size: str = "size") -> DataFrame:
    """The first files by ``order`` whose sizes together do not go beyond ``most`` bytes.

    Running sums are made within ranges and carried over from range to range, so
    no task holds all files.
    """
    ranged = written(files.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("_part").agg(F.sum(size).alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    offsets = sums.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.sum(size).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(F.broadcast(offsets), "_part").withColumn("_run", own + F.col("_before")).where(F.col("_run") <= most).drop("_part", "_before", "_run")


def _seen(system: FileSystem, place: str) -> tuple[int, int] | None:
    """(size, modified in ms) of a file, None if it is not there."""
    info = system.get_file_info(place)
    return None if info.type != FileType.File else (info.size, info.mtime_ns // 1_000_000)


def _read(row, full: bool, moment: Callable[[str], None] | None) -> dict:
    """One file's hashes, or why it has none."""
    told = {"path": row.path, "quick_fp": None, "sha256": None, "md5": None}
    try:
        system, place = FileSystem.from_uri(row.path)
        before = _seen(system, place)
        if before is None:
            return told | {"outcome": "gone"}
        if before != (row.size, row.modified_ms):
            return told | {"outcome": "changed"}  # the next listing tells more
        sha, md5 = hashlib.sha256(), hashlib.md5(usedforsecurity=False)
        with system.open_input_file(place) as file:
            told["quick_fp"] = ranged_fingerprint(lambda at, n: file.read_at(n, at), row.size)
            for at in range(0, row.size, CHUNK) if full else ():
                chunk = file.read_at(min(CHUNK, row.size - at), at)
                sha.update(chunk)
                md5.update(chunk)
        if moment:
            moment(place)
        if _seen(system, place) != before:
            return told | {"quick_fp": None, "outcome": "changed"}
        return told | ({"sha256": sha.hexdigest(), "md5": md5.hexdigest()} if full else {}) | {"outcome": "hashed"}
    except OSError as error:
        return told | {"quick_fp": None, "outcome": f"error: {error}"}


def hash_pass(files: DataFrame, done: DataFrame | None = None, most: int | None = None, full: bool = True, moment: Callable[[str], None] | None = None) -> DataFrame:
    """(path, size, modified_ms, quick_fp, sha256, md5, outcome) of files that ``done`` does not have.

    files: path, size, modified_ms, as listed; done: the same of earlier passes:
    what they told of a file as it is now is not done again, faults included.
    ``most``: bytes of this pass, smallest files first. outcome: hashed, changed
    (its size or time is not as listed, or not the same after it was read), gone
    or error. Without ``full`` only the fingerprint is made, from three windows.
    ``moment`` is called between reading a file and looking at it again.
    """
    keys = ["path", "size", "modified_ms"]
    todo = files.select(*keys).where("size IS NOT NULL")
    if done is not None:
        todo = todo.join(done.where("outcome = 'hashed' OR outcome LIKE 'error%'").select(*keys), keys, "left_anti")
    if most is not None:
        todo = within_budget(todo, most, ["size", "path"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                yield pd.DataFrame([_read(row, full, moment) | {"size": row.size, "modified_ms": row.modified_ms}])

    schema = "path string, size bigint, modified_ms bigint, quick_fp string, sha256 string, md5 string, outcome string"
    names = [c.split()[0] for c in schema.split(", ")]
    return todo.repartition(F.col("path")).mapInPandas(lambda frames: (f[names] for f in run(frames)), schema)


def listed_ms(modified: Column) -> Column:
    """A listing's time in whole milliseconds."""
    return F.unix_millis(modified)


def spread_starts(size: int, window: int, n: int) -> list[int]:
    """Where n windows begin that are spread evenly over a file; those of a small file fall together."""
    return sorted({max(0, (size - window) * k // max(n - 1, 1)) for k in range(n)})


def verified_copies(pairs: DataFrame, window: int = 1 << 20, n: int = 5) -> DataFrame:
    """(a, b, ok, reason, offset) of files that should be the same: by size first, then by n windows of both, read by ranges.

    pairs: a, b, paths. reason: size, content (``offset`` tells the first window
    that differs) or error; what cannot be read is not verified.
    """

    def compare(a: str, b: str) -> tuple:
        try:
            (one, at), (two, bt) = FileSystem.from_uri(a), FileSystem.from_uri(b)
            sizes = _seen(one, at), _seen(two, bt)
            if None in sizes:
                return (a, b, False, "error: not there", None)
            if sizes[0][0] != sizes[1][0]:
                return (a, b, False, "size", None)
            with one.open_input_file(at) as x, two.open_input_file(bt) as y:
                for start in spread_starts(sizes[0][0], window, n):
                    if x.read_at(window, start) != y.read_at(window, start):
                        return (a, b, False, "content", start)
            return (a, b, True, None, None)
        except OSError as error:
            return (a, b, False, f"error: {error}", None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = pd.DataFrame([compare(a, b) for a, b in zip(frame["a"], frame["b"], strict=True)], columns=["a", "b", "ok", "reason", "offset"])
            yield rows.astype({"offset": "Int64"})

    return pairs.select("a", "b").mapInPandas(run, "a string, b string, ok boolean, reason string, offset bigint")
