"""Tables in the shared folder, and upserts on plain Parquet."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; set here only where it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodestone-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which ends its lineage."""
    path = f"{shared_folder(df.sparkSession)}/table-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def removed(*tables: DataFrame) -> None:
    """Delete tables that ``written`` wrote, once nothing reads them any more."""
    for table in tables:
        path = getattr(table, "_lodestone_path", None)
        if path:
            at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def first_wins(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Insert or ignore: rows of ``old`` stay, of equal new ones the first by ``order`` is added."""
    fresh = new.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")
    return old.unionByName(fresh.join(old.select(*key), key, "left_anti"))


def last_wins(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Insert or replace: the last new row by ``order`` takes the place of an old one."""
    fresh = new.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*[c.desc() for c in order]))).where("_r = 1").drop("_r")
    return old.join(fresh.select(*key), key, "left_anti").unionByName(fresh)


def blobs(rows: DataFrame, content: str) -> DataFrame:
    """(key, content): each distinct content once under a key made from it."""
    return rows.select(F.concat(F.lit("e"), F.substring(F.sha1(content), 1, 31)).alias("key"), content).dropDuplicates(["key"])


def stable_export(rows: DataFrame, varying: list[str], order: list[str]) -> DataFrame:
    """One JSON line a row, columns by name, without those that differ from run to run."""
    kept = sorted(c for c in rows.columns if c not in varying)
    return rows.orderBy(*order).select(F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}).alias("line"))


def read_document(spark: SparkSession, primary: str, backup: str) -> DataFrame:
    """A JSON document; the backup where the primary is missing or broken."""
    main = None
    try:
        main = spark.read.option("multiLine", True).json(primary)
        broken = "_corrupt_record" in main.columns or not main.columns
    except Exception as error:  # noqa: BLE001  only a missing file falls back
        if "PATH_NOT_FOUND" not in str(error):
            raise
        broken = True
    return spark.read.option("multiLine", True).json(backup) if broken else main


def append_events(events: DataFrame, path: str, day: Column) -> None:
    """Append rows to an event log of Parquet files in a folder for each day; ids come with the rows."""
    events.withColumn("day", day).repartition("day").write.mode("append").partitionBy("day").parquet(path)


def write_document(rows: DataFrame, folder: str, versions: int = 2) -> str:
    """Write rows as the next version of a JSON document and drop all but the last ``versions``; returns its path.

    Readers take the last version with a _SUCCESS mark, so a write that fails
    half-way leaves the one before in force.
    """
    spark = rows.sparkSession
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []
    number = int(found[-1][1:]) + 1 if found else 0
    path = f"{folder}/v{number:012d}"
    rows.write.json(path)
    whole = [n for n in [*found, path.rsplit("/", 1)[1]] if files.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    for name in whole[:-versions]:
        files.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)
    return path


def document(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The last whole version of a document; none gives no rows."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted((s.getPath().getName() for s in files.listStatus(at)), reverse=True) if files.exists(at) else []
    whole = next((n for n in names if files.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))), None)
    return spark.read.schema(schema).json(f"{folder}/{whole}") if whole else spark.createDataFrame([], schema)
