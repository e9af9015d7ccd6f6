"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of (128-bit hash, documents, largest id), partitioned and
sorted by hash. Each batch of documents merge-anti-joins the earlier runs: the
keys that none of them holds are fresh and enter the run as keys, the others
only as additions to a key that an earlier run brought. A level with too many
runs is compacted into one run of the next. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, dropped, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HASH = ["h1", "h2"]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; all-ASCII strings take the faster function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


class LineRuns:
    """Levels of sorted runs. A key is fresh in exactly one run; later runs hold additions to it."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, holders: DataFrame) -> DataFrame:
        """Add a batch of (h1, h2, id), distinct, of ids in no other batch. Returns its run; ``fresh`` marks keys that no earlier run holds.

        The run may be compacted, and its own files deleted, when the next batch is added.
        """
        self._compact()
        own = holders.groupBy(*_HASH).agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper"))
        own = own.withColumn("fresh", F.lit(True))
        if self.runs():
            own = stored(own, "batch")
            held = self._keys().hint("merge")
            fresh = own.join(held, _HASH, "left_anti")
            known = own.join(held, _HASH, "left_semi").withColumn("fresh", F.lit(False))
            run = stored(fresh.unionByName(known).sortWithinPartitions(*_HASH), "run")
            dropped(own)
        else:
            run = stored(own.sortWithinPartitions(*_HASH), "run")
        self.levels[0].append(run)
        return run

    def _keys(self) -> DataFrame:
        """The keys of all runs; each is fresh in one of them, so none comes up twice."""
        return _united(self.runs()).where("fresh").select(*_HASH)

    def _compact(self) -> None:
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                old, self.levels[k] = self.levels[k], []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                # A key that one of these runs brought stays fresh; additions to keys of other levels stay additions.
                merged = _united(old).groupBy(*_HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"), F.max("fresh").alias("fresh"))
                self.levels[k + 1].append(stored(merged.sortWithinPartitions(*_HASH), "run"))
                for run in old:
                    dropped(run)

    def totals(self) -> DataFrame:
        """(h1, h2, n_docs, keeper) of every key: what its fresh row brought and what was added since."""
        every = _united(self.runs())
        added = every.where("NOT fresh").groupBy(*_HASH).agg(F.sum("n_docs").alias("more"), F.max("keeper").alias("later"))
        keys = every.where("fresh").join(added, _HASH, "left")
        return keys.select(*_HASH, (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("keeper", "later").alias("keeper"))


def _united(runs: list[DataFrame]) -> DataFrame:
    union = runs[0]
    for run in runs[1:]:
        union = union.unionByName(run)
    return union


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, kept, n_lines, n_dropped) for every row of ``docs``.

    ``row`` is the whole input row as a struct, so no column name can clash.
    Lines end at \\n. A key of at least ``min_chars`` code points that at least
    ``min_docs`` ids hold loses its lines in all rows but those of the largest
    id; ``kept`` is the other lines joined by \\n. A null or empty text is one
    empty line, which is too short to drop. A null id holds no key: its lines
    stay. Rows that repeat an id count as one holder and are each returned. An
    empty table gives no rows.
    """
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    source = source.withColumn("print", F.xxhash64("text"))
    each = source.where("id IS NOT NULL").select("id", "print", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = each.where(F.char_length("line") >= min_chars).select("id", "print", "pos", line_key(F.col("line")).alias("key"))
    keyed = keyed.where(F.char_length("key") >= min_chars)
    lines = stored(keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "id", "print", "pos"), "lines")

    runs = LineRuns(docs.sparkSession)
    for k in range(batches):
        # Ids are dealt to batches whole, so a key's documents add up over runs.
        runs.add(lines.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == k).select(*_HASH, "id").distinct())
    # Stored, so that its measured size decides on a broadcast; else the join splits a hot key's partition.
    common = stored(runs.totals().where(F.col("n_docs") >= min_docs), "common")
    lost = lines.join(common, _HASH).where("id <> keeper").groupBy("id", "print").agg(F.collect_set("pos").alias("lost"))

    out = source.join(lost.hint("shuffle_hash"), ["id", "print"], "left")
    split = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("lost"))
    kept = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n"))
    return out.select("row", kept.alias("kept"), F.size(split).cast("bigint").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("bigint").alias("n_dropped"))
