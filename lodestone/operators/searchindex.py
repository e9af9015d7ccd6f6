"""A search index that is kept between searches.

Folded terms and their keys lie in segments of Parquet, sorted by term, so a
word's prefix is a range that files, row groups and pages outside it are never
read for. Changes only add: a batch becomes a new segment and a list of its keys,
and the keys that it replaces or deletes are written down with the change's
number, which hides their older postings. Segments of a level are merged into
one of the next when there are FAN of them. What is in force is a versioned list
of segments, so readers see a change whole or not at all. One writer at a time.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import search_forms, words
from ..sources.storage import document, shared_folder, write_document

#: Segments of a level that are merged, rows of a row group and of a page; share of hidden keys from which all is merged.
FAN, GROUP_ROWS, PAGE_ROWS, HIDDEN = 4, 1 << 18, 4096, 0.125
#: After every text that begins with what stands before it.
_LAST = "\U0010ffff"
_LISTED = "kind string, path string, level int, seq bigint, rows bigint"


def _accents() -> tuple[str, str]:
    """Letters that Unicode takes apart into a letter and marks, and those letters."""
    apart = {}
    for code in range(0xC0, 0x2000):
        first, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and all(unicodedata.category(m) == "Mn" for m in marks):
            apart[chr(code)] = first
    return "".join(apart), "".join(apart.values())


_WITH, _WITHOUT = _accents()


def unaccented(text: Column) -> Column:
    """Without accents and marks, in its own case."""
    return F.regexp_replace(F.translate(text, _WITH, _WITHOUT), r"\p{Mn}", "")


def query_terms(text: str, most: int = 8) -> list[str]:
    """The words of a search, without accents and in lower case as terms are."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    return re.findall(r"[^\W_]+", bare.lower())[:most]


def postings(docs: DataFrame, key: str, text: Column, names: Column | None = None) -> DataFrame:
    """(key, term), each once: words of ``text``, and of ``names`` also words parted at capitals and neighbours joined."""
    text = unaccented(text)
    terms = words(text) if names is None else F.concat(words(text), words(unaccented(names)), search_forms(unaccented(names)))
    return docs.select(F.col(key).cast("string").alias("key"), F.explode(F.array_distinct(terms)).alias("term"))


def prefix(term: str) -> Column:
    """Postings of terms that begin so; a one-letter word must match whole."""
    if len(term) == 1:
        return F.col("term") == term
    return (F.col("term") >= term) & (F.col("term") < term + _LAST)


class SearchIndex:
    """An index in a folder of shared storage; an empty folder is an empty index."""

    def __init__(self, spark: SparkSession, folder: str, group_rows: int = GROUP_ROWS, page_rows: int = PAGE_ROWS):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.group_rows, self.page_rows = group_rows, page_rows

    def segments(self) -> list:
        """What is in force: postings, the keys they are of and hidden keys, by change."""
        return sorted(document(self.spark, f"{self.folder}/list", _LISTED).collect(), key=lambda s: s.seq)

    def add(self, docs: DataFrame, key: str, text: Column, names: Column | None = None) -> None:
        """Index a batch; a document whose key is there already takes the other's place. Null keys are left out."""
        self._change(postings(docs.where(F.col(key).isNotNull()), key, text, names), docs.select(F.col(key).cast("string").alias("key")))

    def delete(self, keys: DataFrame, key: str) -> None:
        """Hide all postings of these keys; unknown ones change nothing."""
        self._change(None, keys.select(F.col(key).cast("string").alias("key")))

    def _change(self, posts: DataFrame | None, keys: DataFrame) -> None:
        now = self.segments()
        seq = max((s.seq for s in now), default=0) + 1
        fresh = []
        keys = keys.where("key IS NOT NULL").distinct().withColumn("seq", F.lit(seq).cast("bigint"))
        there = [s.path for s in now if s.kind == "keys" and s.rows]
        if there:
            hidden = keys.join(self.spark.read.schema("key string").parquet(*there), "key", "left_semi")
            fresh.append(self._write("hidden", hidden, "key", 0, seq))
        if posts is not None:
            fresh.append(self._write("keys", keys, "key", 0, seq))
            fresh.append(self._write("postings", posts.withColumn("seq", F.lit(seq).cast("bigint")), "term", 0, seq))
        self._commit([*now, *[f for f in fresh if f[0] == "postings" or f[4]]])
        self.compact()

    def _write(self, kind: str, rows: DataFrame, by: str, level: int, seq: int) -> tuple:
        path = f"{self.folder}/{kind}-{seq:08d}-{level}-{uuid.uuid4().hex[:8]}"
        others = [c for c in ("key", "seq") if c != by and c in rows.columns]
        out = rows.repartitionByRange(by, *others).sortWithinPartitions(by, *others).write
        for option, value in (("parquet.block.row.count.limit", self.group_rows), ("parquet.page.row.count.limit", self.page_rows)):
            out = out.option(option, value)
        out.parquet(path)
        return (kind, path, level, seq, self.spark.read.parquet(path).count())

    def _commit(self, listed: list) -> None:
        before = {s.path for s in self.segments()}
        write_document(self.spark.createDataFrame([tuple(s) for s in listed], _LISTED).coalesce(1), f"{self.folder}/list")
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.folder)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        alive = {p.rsplit("/", 1)[1] for p in before | {tuple(s)[1] for s in listed}}  # those of the version before may still be read
        for status in files.listStatus(at):
            name = status.getPath().getName()
            if name != "list" and name not in alive:
                files.delete(status.getPath(), True)

    def live(self, wanted: Column | None = None, only: list | None = None) -> DataFrame:
        """(key, term, seq) of postings in force that ``wanted`` holds for, from all segments or from those given."""
        now = self.segments()
        rows = [s.path for s in (now if only is None else only) if s.kind == "postings" and s.rows]
        if not rows:
            return self.spark.createDataFrame([], "key string, term string, seq bigint")
        found = self.spark.read.schema("key string, term string, seq bigint").parquet(*rows)
        if wanted is not None:
            found = found.where(wanted)
        hidden = [s.path for s in now if s.kind == "hidden" and s.rows]
        if hidden:
            gone = self.spark.read.schema("key string, seq bigint").parquet(*hidden).groupBy("key").agg(F.max("seq").alias("until"))
            found = found.join(gone.withColumnRenamed("key", "_key"), (F.col("key") == F.col("_key")) & (F.col("seq") < F.col("until")), "left_anti")
        return found

    def search(self, text: str) -> DataFrame:
        """(key): documents with a term for every word of the search as its beginning, or for all words joined.

        A one-letter word must match whole; case and accents do not count; an
        empty search finds nothing.
        """
        terms = query_terms(text)
        if not terms:
            return self.live(only=[]).select("key")
        each = {f"t{i}": prefix(t) for i, t in enumerate(terms)}
        if len(terms) > 1:
            each["joined"] = prefix("".join(terms))
        wanted = F.lit(False)
        for test in each.values():
            wanted = wanted | test
        met = self.live(wanted).groupBy("key").agg(*[F.bool_or(test).alias(name) for name, test in each.items()])
        every = F.lit(True)
        for i in range(len(terms)):
            every = every & F.col(f"t{i}")
        return met.where(every | F.col("joined") if len(terms) > 1 else every).select("key")

    def compact(self, whole: bool = False) -> None:
        """Merge levels that have FAN segments; all of it if asked for or if many keys are hidden."""
        now = self.segments()
        posts = [s for s in now if s.kind == "postings"]
        hidden = sum(s.rows for s in now if s.kind == "hidden")
        if whole or hidden > HIDDEN * sum(s.rows for s in posts):
            merge = posts
        else:
            merge = next((of for level in sorted({s.level for s in posts}) if len(of := [s for s in posts if s.level == level]) >= FAN), [])
        if not merge or len(merge) == 1 and not hidden:
            return
        level, seq = max(s.level for s in merge) + 1, max(s.seq for s in merge)
        one = self._write("postings", self.live(only=merge), "term", level, seq)
        old_keys = [s for s in now if s.kind == "keys" and s.seq in {m.seq for m in merge}]
        keys = self.spark.read.schema("key string, seq bigint").parquet(*[s.path for s in old_keys]) if len(merge) < len(posts) else self.spark.read.parquet(one[1])
        keys = self._write("keys", keys.select("key").distinct().withColumn("seq", F.lit(seq).cast("bigint")), "key", level, seq)
        paths = {s.path for s in [*merge, *old_keys]}
        # Once every segment is merged, hidden keys have nothing left to hide.
        rest = [s for s in now if s.path not in paths and (s.kind != "hidden" or len(merge) < len(posts))]
        self._commit([*rest, one, keys])


def version_of(table: DataFrame) -> str:
    """Tells a table's files apart from what they were: a hash of their paths, lengths and times."""
    spark = table.sparkSession
    told = []
    for path in sorted(table.inputFiles()):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
        told.append(f"{path} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha1("\n".join(told).encode()).hexdigest()[:20]


def kept(docs: DataFrame, name: str, key: str, text: Column, names: Column | None = None, folder: str | None = None) -> SearchIndex:
    """The index ``name`` of a table: built when it is first asked for, and again once the table's files have changed."""
    spark = docs.sparkSession
    index = SearchIndex(spark, f"{folder or shared_folder(spark)}/search-{name}-{version_of(docs)}")
    if not index.segments():
        index.add(docs, key, text, names)
    return index
