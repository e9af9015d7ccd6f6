"""Where files come from: sliced from a project, made of a source file.

What names exactly one file is a claim with confidence; what names several is
recorded with little.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written

# Where the object names of sliced files come from.
SLICED_ORIGINS = ("exclude_object", "printing_object", "m486")


def named_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(id, name, hit, hits): the files whose name is a wanted name but for its case, never the row itself; ``hits``: how many.

    wanted and files: id, name.
    """
    there = files.select(F.col("id").alias("hit"), F.lower("name").alias("_k"))
    rows = wanted.select("id", "name", F.lower("name").alias("_k")).join(there, "_k").where("id <> hit")
    return rows.withColumn("hits", F.count("*").over(Window.partitionBy("id", "name"))).drop("_k")


def by_plate_hash(files: DataFrame, plates: DataFrame) -> DataFrame:
    """(subject, object) of sliced files whose MD5 a plate of another file records.

    files: id, content_key, md5; plates: file_id, gcode_md5.
    """
    owner = plates.where("gcode_md5 IS NOT NULL").join(files.select(F.col("id").alias("file_id"), F.col("content_key").alias("object")), "file_id")
    own = files.where("md5 IS NOT NULL").select("id", F.col("content_key").alias("subject"), F.col("md5").alias("gcode_md5"))
    return own.join(owner, "gcode_md5").where("id <> file_id").select("subject", "object").distinct()


def by_object_set(objects: DataFrame, plates: DataFrame, besides: DataFrame | None = None) -> DataFrame:
    """(subject, object, hits) of sliced files whose set of object names is that of a plate; ``hits``: projects that fit.

    objects: content_key, name; plates: content_key, plate_no, names (array);
    besides: distinct (subject, object) that are neither told nor counted. Hits
    are counted a set of names, since pairs may be as many as the square of the
    files that share one; a pair is written where it is joined. Only the pairs of
    subjects that have some of ``besides`` among theirs are shuffled.
    """
    key = lambda names: F.array_join(F.array_sort(F.array_distinct(names)), "|")
    own = objects.where("content_key IS NOT NULL").groupBy(F.col("content_key").alias("subject")).agg(key(F.collect_set("name")).alias("_k"))
    there = plates.where("size(names) > 0 AND content_key IS NOT NULL").select(F.col("content_key").alias("object"), key(F.col("names")).alias("_k")).distinct()
    number = there.groupBy("_k").agg(F.count("*").alias("_n"))
    itself = there.select(F.col("object").alias("subject"), "_k", F.lit(1).alias("_self"))
    rows = own.join(number, "_k").join(itself, ["subject", "_k"], "left").withColumn("hits", F.col("_n") - F.coalesce("_self", F.lit(0)))
    paired = lambda some: some.join(there, "_k").where("subject <> object").select("subject", "object", "hits")
    if besides is None:
        return paired(rows)
    known = besides.where("subject <> object").join(own, "subject").join(there, ["object", "_k"]).select("subject", "object")
    rows = rows.join(known.groupBy("subject").agg(F.count("*").alias("_known")), "subject", "left").withColumn("hits", F.col("hits") - F.coalesce("_known", F.lit(0)))
    rows = written(rows, "object-sets")
    return paired(rows.where("_known IS NULL")).unionByName(paired(rows.where("_known IS NOT NULL")).join(known, ["subject", "object"], "left_anti"))


def lineage(files: DataFrame, plates: DataFrame, objects: DataFrame) -> DataFrame:
    """Claims (subject, relation, object, method, confidence, state, hits) between content keys.

    files: id, content_key, name, role, md5, present ones that are no entries;
    plates: file_id, plate_no, gcode_md5, names (array of what is no generic
    name); objects: file_id, origin, raw_name, name_norm, generic. A sliced file
    that is a plate's own by its hash is not told again by its objects.
    """
    key_of = files.select(F.col("id").alias("file_id"), "content_key")
    exact = by_plate_hash(files, plates)
    named = objects.where(F.col("origin").isin(*SLICED_ORIGINS) & ~F.col("generic")).join(key_of, "file_id")
    named = named.join(plates.select("file_id").distinct(), "file_id", "left_anti")
    sets = by_object_set(named.select("content_key", F.col("name_norm").alias("name")), plates.join(key_of, "file_id"), exact)
    told = objects.where("origin = 'source_file'").select(F.col("file_id").alias("id"), F.col("raw_name").alias("name")).distinct()
    sources = named_files(told, files)
    meshes = named_files(named.select(F.col("file_id").alias("id"), F.col("raw_name").alias("name")).distinct(), files.where("role = 'source'")).where("hits = 1")
    to_keys = lambda rows: rows.join(key_of.select(F.col("file_id").alias("id"), F.col("content_key").alias("object")), "id").join(key_of.select(F.col("file_id").alias("hit"), F.col("content_key").alias("subject")), "hit")
    one = F.col("hits") == 1

    # Several files of one content may name the same.
    strongest = lambda rows: rows.groupBy("subject", "object").agg(F.max("hits").alias("hits"))

    def claims(rows: DataFrame, relation: str, method: str, confidence, state) -> DataFrame:
        return rows.select("subject", F.lit(relation).alias("relation"), "object", F.lit(method).alias("method"), confidence.alias("confidence"), state.alias("state"), "hits")

    parts = [
        claims(exact.withColumn("hits", F.lit(1).cast("bigint")), "sliced_from", "plate_md5", F.lit("exact"), F.lit("applied")),
        claims(sets, "sliced_from", "object_names", F.when(one, "medium").otherwise("low"), F.when(one, "suggested").otherwise("recorded")),
        claims(strongest(to_keys(sources)), "source_of", "source_file_meta", F.when(one, "high").otherwise("low"), F.when(one, "applied").otherwise("recorded")),
        claims(strongest(to_keys(meshes)), "source_of", "object_name", F.lit("medium"), F.lit("suggested")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def lineage_pairs(claims: DataFrame) -> DataFrame:
    """(a, b, signal) of pairs that lineage names: plate_md5 and source_file are identities, other claims only make a pair."""
    signal = F.when(F.col("method") == "plate_md5", "plate_md5").when((F.col("method") == "source_file_meta") & (F.col("state") == "applied"), "source_file")
    return claims.where("subject <> object").select(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b"), signal.alias("signal")).distinct()
