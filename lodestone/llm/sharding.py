"""Extendible hashing of rows into shards of at most so many bytes.

A row's address is a string of hash bits: of its key, then of its text, then
of its place, so that repeated keys and even equal rows can be told apart. The
directory starts with one bucket; one that is too large is split on its next
bit, the others stay as shallow as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Bits that one round of the directory looks at, and rounds: 48 bits of key, text and place each.
STEP, ROUNDS = 16, 9


def assign_shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, shard, depth, n_bytes, shard_bytes) for every row of ``docs``.

    ``shard`` is the bits of the bucket's prefix, ``depth`` of them; every
    shard's texts hold at most ``limit`` bytes unless it is a single row that
    alone holds more. A null text has no bytes; a null key hashes as empty. Equal
    rows are told apart by their place, so a key with any share of the rows is
    still split. An empty table gives no rows.
    """
    text = F.coalesce(text_col, F.lit(""))
    words = [F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.md5(text), F.md5(F.monotonically_increasing_id().cast("string"))]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.concat(*[F.substring(w, 1, 12) for w in words]).alias("address"))
    # Written once: places must not change between the rounds, which read sizes and addresses only.
    rows = stored(rows, "addresses").withColumn("path", F.lit(""))
    done = None
    for k in range(ROUNDS):
        rows = rows.withColumn("chunk", F.conv(F.substring("address", k * STEP // 4 + 1, STEP // 4), 16, 10).cast("bigint"))
        directory = stored(_split(rows, limit, last=k == ROUNDS - 1), "directory")
        placed = rows.join(directory, ["path", "chunk"])
        closed = placed.where("bits IS NOT NULL").select("row", F.concat("path", "bits").alias("shard"), "n_bytes", "shard_bytes")
        done = closed if done is None else done.unionByName(closed)
        if directory.where("bits IS NULL").isEmpty():
            break
        rows = placed.where("bits IS NULL").select("row", "n_bytes", "address", F.concat("path", F.lpad(F.conv("chunk", 10, 2), STEP, "0")).alias("path"))
    return done.select("row", "shard", F.length("shard").alias("depth"), "n_bytes", "shard_bytes")


def _split(rows: DataFrame, limit: int, last: bool) -> DataFrame:
    """(path, chunk, bits, shard_bytes): the fewest of a chunk's bits whose bucket fits; null bits if none do."""
    cells = rows.groupBy("path", "chunk").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
    each = cells.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(STEP)))).withColumn("prefix", F.expr(f"shiftright(chunk, {STEP} - d)"))
    sums = each.groupBy("path", "d", "prefix").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    fit = sums.where((F.col("b") <= limit) | (F.col("n") == 1) | (F.lit(last) & (F.col("d") == STEP)))
    least = each.select("path", "chunk", "d", "prefix").join(fit, ["path", "d", "prefix"]).groupBy("path", "chunk").agg(F.min(F.struct("d", "prefix", "b")).alias("m"))
    bits = F.when(F.col("m.d") == 0, F.lit("")).otherwise(F.expr("lpad(conv(m.prefix, 10, 2), m.d, '0')"))
    return cells.select("path", "chunk").join(least, ["path", "chunk"], "left").select("path", "chunk", F.when(F.col("m").isNotNull(), bits).alias("bits"), F.col("m.b").alias("shard_bytes"))


def write_shards(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every shard as a folder of Parquet files named by its bits (``root`` for none); returns the assignment.

    The folders' column is ``_shard``, with further underscores where ``docs`` has such a column.
    """
    found = stored(assign_shards(docs, limit, id_col, text_col), "shards")
    folder = "_shard"
    while folder in docs.columns:
        folder = "_" + folder
    named = found.select("row.*", F.when(F.col("shard") == "", "root").otherwise(F.concat(F.lit("b"), "shard")).alias(folder))
    named.repartition(folder).write.partitionBy(folder).parquet(path)
    return found
