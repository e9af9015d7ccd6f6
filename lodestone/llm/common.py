"""Shared storage, batching and graph helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words and is stripped from lines.
ASCII_SPACE = "\x09\x0a\x0b\x0c\x0d\x20"
#: Paths of the tables that each application's operators wrote.
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share; set here only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_table(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    path = f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_tables(spark: SparkSession) -> None:
    """Delete all tables that operators of this application left in the shared folder; call it once their results are read."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back; a lost executor costs no recomputation of what is before."""
    spark = df.sparkSession
    path = new_table(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote, once nothing reads it any more."""
    path = getattr(df, "_lodestone_path", None)
    if path:
        _delete(df.sparkSession, path)


def slices(batch: pa.RecordBatch, column: str, chars: int = 2_000_000, field: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice hold about so many characters; one longer text makes a slice alone. ``field``: the texts are in that field of a struct column."""
    start, total = 0, 0
    texts = batch.column(column) if field is None else pc.struct_field(batch.column(column), field)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for i, n in enumerate(sizes):
        if i > start and total + n > chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def partitions_for(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; component is the smallest node reachable.

    Alternating large-star and small-star rounds; each round is written to
    the shared folder. Self links and repeats are harmless, a null end drops
    the link, an empty table gives an empty result. Minima combine on the map
    side; they are stored before they meet the links again, so that join reads
    two plain tables and AQE can broadcast the minima or split a hub's links.
    """
    edges = stored(
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "links",
    )
    seen = _mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "large")
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.unionByName(near.select("u", F.col("m").alias("v"))).distinct(), "links")
        mark = _mark(after)
        for table in (edges, large, low):
            dropped(table)
        edges, done, seen = after, mark == seen, mark
        if done:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return (row[0], row[1])
