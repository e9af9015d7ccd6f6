"""Entity resolution: blocking, evidence, policy; clusters and common names are in modules of their own.

All stages are functions of their tables, so a rebuild is running them again.
Keys are content keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import families_like
from ..functions.text import name_key
from .clusters import assigned, constrained_clusters  # noqa: F401  part of resolution
from .genericity import common_objects  # noqa: F401
from .manifest import in_folders

#: A block of more keys is common, not evidence.
BLOCK_MOST = 50
# Names of folders that tell what kind of files they hold.
FORMAT_FOLDER = (
    r"^(?:stls?|3mfs?|objs?|steps?|stps?|gcodes?|g-?codes?|bgcodes?|meshes|images?|imgs?|pics?|pictures?|photos?|renders?|previews?|thumbnails?"
    r"|(?:pre-?)?supported|unsupported|supports?|lychee|chitubox|print[\s_-]*files?|files?|sources?|cad|parts?)$"
)


def blocked_pairs(blocks: DataFrame, most: int = BLOCK_MOST) -> DataFrame:
    """(a, b, via) of keys that share a (kind, value) of at most ``most`` keys; via: the kinds, sorted.

    blocks: key, kind, value. A block's bound also bounds its pairs.
    """
    rows = blocks.where("value IS NOT NULL AND value <> ''").select("key", "kind", "value").distinct()
    rows = rows.join(rows.groupBy("kind", "value").count().where(F.col("count").between(2, most)).drop("count"), ["kind", "value"])
    left, right = rows.withColumnRenamed("key", "a"), rows.withColumnRenamed("key", "b")
    return left.join(right, ["kind", "value"]).where("a < b").groupBy("a", "b").agg(F.array_sort(F.collect_set("kind")).alias("via"))


def common_blocks(blocks: DataFrame, most: int = BLOCK_MOST) -> DataFrame:
    """The blocks that were too large, with their sizes."""
    return blocks.groupBy("kind", "value").agg(F.count_distinct("key").alias("keys")).where(F.col("keys") > most)


def nodes(files: DataFrame, titles: DataFrame, objects: DataFrame, projects: DataFrame, roots: DataFrame | None = None, folders: DataFrame | None = None) -> DataFrame:
    """One row a content key: title of its first place, non-generic objects, design ids, files, folders.

    files: id, content_key, root_id, rel_path, entry_path, role, name;
    titles: file_id, normalized, token_count, generic_score; objects: file_id,
    name_norm, generic; projects: file_id, design_model_id; roots: id, grouping;
    folders: root_id, rel_path, class. The top folder of a file in a root that is
    grouped by folders is its model folder.
    """
    own = files.where("entry_path = '' AND role IN ('sliced', 'project', 'source')").withColumn("place", F.concat_ws(":", "root_id", "rel_path"))
    titled = own.join(titles.withColumnRenamed("file_id", "id"), "id", "left")
    first = titled.groupBy("content_key").agg(
        F.min_by(F.struct("normalized", "token_count", "generic_score"), "place").alias("t"), F.array_sort(F.collect_list("place")).alias("places"), F.min("place").alias("place"), F.array_sort(F.collect_set("normalized")).alias("titles")
    )
    named = own.select("id", "content_key").join(objects.where("NOT generic").withColumnRenamed("file_id", "id"), "id").groupBy("content_key").agg(F.array_sort(F.collect_set("name_norm")).alias("objects"))
    design = own.select("id", "content_key").join(projects.withColumnRenamed("file_id", "id"), "id").where("design_model_id IS NOT NULL").groupBy("content_key").agg(F.array_sort(F.collect_set("design_model_id")).alias("designs"))
    empty = F.array().cast("array<string>")
    out = first.join(named, "content_key", "left").join(design, "content_key", "left").withColumns({"model_folders": empty, "designer_folders": empty})
    if roots is not None:
        parts = F.split("rel_path", "/")
        inside = own.join(roots.where("grouping = 'folders'").select(F.col("id").alias("root_id")), "root_id", "left_semi").where(F.size(parts) > 1)
        tops = inside.groupBy("content_key").agg(F.array_sort(F.collect_set(F.concat_ws(":", "root_id", parts[0]))).alias("_m"))
        out = out.join(tops, "content_key", "left").withColumn("model_folders", F.coalesce("_m", empty)).drop("_m")
    if folders is not None:
        by = in_folders(own.select("content_key", "root_id", "rel_path"), folders.where("class = 'designer'"), ("root_id",))
        makers = by.groupBy("content_key").agg(F.array_sort(F.collect_set(name_key(F.regexp_extract("folder", "([^/]+)$", 1)))).alias("_d"))
        out = out.join(makers, "content_key", "left").withColumn("designer_folders", F.coalesce("_d", empty)).drop("_d")
    return out.select(F.col("content_key").alias("key"), F.col("t.normalized").alias("title"), F.col("t.token_count").alias("token_count"), F.col("t.generic_score").alias("generic_score"), "titles", "places", "place", F.coalesce("objects", empty).alias("objects"), F.coalesce("designs", empty).alias("designs"), "model_folders", "designer_folders")


def blocks_of(nodes_: DataFrame) -> DataFrame:
    kind = lambda k, v: nodes_.select("key", F.lit(k).alias("kind"), v.alias("value"))
    return kind("title", F.explode("titles")).unionByName(kind("objects", F.array_join("objects", "|"))).unionByName(kind("design_model_id", F.explode("designs"))).unionByName(kind("model_folder", F.explode("model_folders")))


def with_lineage(pairs: DataFrame, lineage: DataFrame, nodes_: DataFrame) -> DataFrame:
    """Candidate pairs and those that lineage names, however many share its names; lineage: a, b."""
    known = lambda c: nodes_.select(F.col("key").alias(c))
    told = lineage.select("a", "b").distinct().join(known("a"), "a", "left_semi").join(known("b"), "b", "left_semi").select("a", "b", F.array(F.lit("lineage")).alias("via"))
    return pairs.unionByName(told).groupBy("a", "b").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("via")))).alias("via"))


def title_strength(a: Column, b: Column, tokens_a: Column, generic: Column) -> Column:
    """medium, weak or none of two normalised titles.

    Equal: none under four characters of one word, weak if generic, else
    medium. One inside the other on word borders, of four characters: weak.
    """
    short, long_ = F.when(F.size(F.split(a, " ")) <= F.size(F.split(b, " ")), a).otherwise(b), F.when(F.size(F.split(a, " ")) <= F.size(F.split(b, " ")), b).otherwise(a)
    tiny = (tokens_a < 2) & (F.length(F.replace(a, F.lit(" "), F.lit(""))) < 4)
    inside = (F.length(short) >= 4) & F.contains(F.concat(F.lit(" "), long_, F.lit(" ")), F.concat(F.lit(" "), short, F.lit(" ")))
    out = F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), "none")
    return out.when((a == b) & tiny, "none").when((a == b) & generic, "weak").when(a == b, "medium").when(inside, "weak").otherwise("none")


def evidence(pairs: DataFrame, nodes_: DataFrame, lineage: DataFrame | None = None, folders: DataFrame | None = None) -> DataFrame:
    """Pairs with ``evidence`` (signal, grp, strength) and ``conflicts``.

    lineage: a, b, signal (plate_md5 or source_file), of pairs named either way;
    folders: folder, status, as ``model_folders`` tells. A shared model folder
    supports another group, a shared designer folder only explains.
    """
    a = nodes_.select(*[F.col(c).alias("a" if c == "key" else f"a_{c}") for c in nodes_.columns])
    b = nodes_.select(*[F.col(c).alias("b" if c == "key" else f"b_{c}") for c in nodes_.columns])
    rows = pairs.select("a", "b", "via").join(a, "a").join(b, "b")
    if lineage is not None:
        told = lineage.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "signal").groupBy("a", "b").agg(F.array_sort(F.collect_set("signal")).alias("signals"))
        rows = rows.join(told, ["a", "b"], "left")
    else:
        rows = rows.withColumn("signals", F.lit(None).cast("array<string>"))
    empty = F.array().cast("array<string>")
    for side in ("a", "b"):  # nodes without folders
        for c in ("model_folders", "designer_folders"):
            if f"{side}_{c}" not in rows.columns:
                rows = rows.withColumn(f"{side}_{c}", empty)
    shared = F.get(F.array_sort(F.array_intersect("a_model_folders", "b_model_folders")), F.lit(0))
    rows = rows.withColumn("_folder", shared)
    if folders is not None:
        rows = rows.join(folders.select(F.col("folder").alias("_folder"), (F.col("status") == "model_folder").alias("_sure")), "_folder", "left")
    else:
        rows = rows.withColumn("_sure", F.col("_folder").isNotNull())
    item = lambda signal, group, strength: F.struct(F.lit(signal).alias("signal"), F.lit(group).alias("grp"), strength.alias("strength"))
    both = lambda c: (F.size(f"a_{c}") > 0) & (F.size(f"b_{c}") > 0)
    equal, some = F.col("a_objects") == F.col("b_objects"), F.arrays_overlap("a_objects", "b_objects")
    design = F.arrays_overlap("a_designs", "b_designs")
    title = title_strength(F.col("a_title"), F.col("b_title"), F.col("a_token_count"), F.greatest("a_generic_score", "b_generic_score") >= 0.5)
    list_ = F.array(
        F.when(both("designs") & design, item("design_model_id", "identity", F.lit("identity"))),
        F.when(F.array_contains("signals", "plate_md5"), item("plate_md5", "identity", F.lit("identity"))),
        F.when(F.array_contains("signals", "source_file"), item("source_file", "identity", F.lit("identity"))),
        F.when(both("objects") & equal, item("object_names", "internal-content", F.lit("medium"))).when(both("objects") & some, item("object_names", "internal-content", F.lit("weak"))),
        F.when(title != "none", item("title", "filename", title)),
        F.when(F.arrays_overlap("a_designer_folders", "b_designer_folders"), item("designer_folder", "location", F.lit("weak"))),
        F.when(F.col("_sure"), item("model_folder", "location", F.lit("medium"))),
    )
    conflicts = F.array(F.when(both("designs") & ~design, F.lit("different designs")), F.when(both("objects") & ~some, F.lit("no object in common")))
    return rows.select("a", "b", "via", F.array_compact(list_).alias("evidence"), F.array_compact(conflicts).alias("conflicts"))


def policy(pairs: DataFrame) -> DataFrame:
    """Adds cls (auto, suggest, record, none), confidence, groups and method to pairs with evidence and conflicts."""
    counted = F.filter("evidence", lambda e: e["strength"].isin("identity", "medium"))
    groups = F.array_sort(F.array_distinct(F.transform(counted, lambda e: e["grp"])))
    independent = F.size(F.array_except(groups, F.array(F.lit("identity"))))
    identity = F.exists("evidence", lambda e: e["strength"] == "identity")
    exact = F.exists("evidence", lambda e: e["signal"] == "plate_md5")
    conflict = F.size("conflicts") > 0
    cls = F.when(identity, "auto").when(conflict, "record").when(independent >= 2, "auto").when(independent == 1, "suggest").when(F.size("evidence") > 0, "record").otherwise("none")
    confidence = F.when(identity & exact, "exact").when(identity, "high").when(conflict, "low").when(independent >= 2, "high").when(independent == 1, "medium").when(F.size("evidence") > 0, "low")
    signals = F.transform(F.when(F.size(counted) > 0, counted).otherwise(F.col("evidence")), lambda e: e["signal"])
    return pairs.withColumns({"cls": cls, "confidence": confidence, "groups": groups, "method": F.when(conflict & ~identity, "conflict").otherwise(F.array_join(signals, "+"))})


def duplicates(files: DataFrame, key: str = "content_key", place: str = "place", hashed: Column | None = None) -> DataFrame:
    """(a, b) places of one content, linked in order of place: each copy to the one before it, ``exact`` if all are hashed.

    Copies need no pair each: the chain through n places has n - 1 links.
    """
    by = Window.partitionBy(key).orderBy(place)
    whole = F.min((hashed if hashed is not None else F.lit(True)).cast("int")).over(Window.partitionBy(key)) == 1
    rows = files.select(key, F.lag(place).over(by).alias("a"), F.col(place).alias("b"), F.when(whole, "exact").otherwise("high").alias("confidence"))
    return rows.where("a IS NOT NULL")


def duplicate_pairs(files: DataFrame, key: str = "content_key", place: str = "place") -> DataFrame:
    """(a, b) of all places of one content, a < b: grows with the square of the copies; ``duplicates`` does not."""
    one = files.select(key, F.col(place).alias("a"))
    return one.join(files.select(key, F.col(place).alias("b")), key).where("a < b")


def suggestions(pairs: DataFrame, model_of: DataFrame, distinct: DataFrame) -> DataFrame:
    """(key, model): suggested pairs across models; a key with several targets is ambiguous and suggests nothing."""
    side = lambda x: model_of.select(F.col("key").alias(x), F.col("model").alias(f"m{x}"))
    rows = pairs.where("cls = 'suggest'").join(side("a"), "a").join(side("b"), "b").where("ma <> mb")
    apart = distinct.select(F.col("a").alias("ma"), F.col("b").alias("mb"))
    rows = rows.join(apart.union(apart.select("mb", "ma")), ["ma", "mb"], "left_anti")
    each = rows.select(F.col("a").alias("key"), F.col("mb").alias("model")).union(rows.select("b", "ma")).distinct()
    return each.groupBy("key").agg(F.count("*").alias("n"), F.first("model").alias("model")).where("n = 1").select("key", "model")


def folder_classes(folders: DataFrame) -> DataFrame:
    """Adds ``class``: format, printer_family_like (a short name of a family), designer (its name comes up under another parent) or unknown.

    folders: root_id, rel_path.
    """
    name = F.regexp_extract("rel_path", r"([^/]+)$", 1)
    parent = F.concat_ws(":", "root_id", F.regexp_replace("rel_path", r"/?[^/]+$", ""))
    rows = folders.withColumns({"_key": name_key(name), "_parent": parent})
    spread = rows.groupBy("_key").agg(F.count_distinct("_parent").alias("_n"))
    kind = F.when(F.lower(F.trim(name)).rlike(FORMAT_FOLDER), "format")
    kind = kind.when(F.size(families_like(name)) > 0, "printer_family_like").when((F.col("_n") > 1) & (F.col("_key") != ""), "designer")
    return rows.join(spread, "_key").withColumn("class", kind.otherwise("unknown")).drop("_key", "_parent", "_n")


# Kinds of review items that a run makes and closes.
MANAGED = (
    "suggested_match", "ambiguous_grouping", "possible_duplicate", "source_may_match", "unknown_printer", "folder_disagrees",
    "missing_file", "source_offline", "unreadable_file", "file_changed", "decision_unmatched", "empty_model",
)


def reviews_after(current: DataFrame, produced: DataFrame) -> DataFrame:
    """Review items after a run: new and returning ones open, open ones that vanished closed by themselves, what a person settled left alone.

    Both: subject_key, kind; current also status (open, dismissed, resolved or
    auto_closed). Items of kinds that no run makes stay as they are.
    """
    p = produced.select("subject_key", F.col("kind").alias("p_kind"))
    both = current.join(p, "subject_key", "full_outer")
    settled = F.col("status").isin("dismissed", "resolved")
    gone = (F.col("status") == "open") & F.col("kind").isin(*MANAGED)
    status = F.when(settled, F.col("status")).when(F.col("p_kind").isNotNull(), "open").when(gone, "auto_closed").otherwise(F.col("status"))
    return both.select("subject_key", F.coalesce("p_kind", "kind").alias("kind"), status.alias("status"))


def recovered(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Full hashes of files by (quick_fp, size), only where the cache names exactly one."""
    one = cache.groupBy("quick_fp", "size").agg(F.min("sha256").alias("sha256"), F.count_distinct("sha256").alias("_n")).where("_n = 1").drop("_n")
    return files.join(one, ["quick_fp", "size"], "left")


def claim_key(*fields: Column) -> Column:
    return F.sha1(F.concat_ws("|", *fields))
