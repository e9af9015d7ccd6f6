"""What follows from clusters: claims of membership, anchors, names and facts of models, protected names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written
from .browse import first_by, most_common, ranked, top_within

_CONFIDENCE = ("exact", "high", "medium", "low")


def split_out(members: DataFrame, rejects: DataFrame, anchors: DataFrame) -> DataFrame:
    """(key, cluster, model, split): members without those that were separated from their cluster's model.

    members: key, cluster, model; rejects, anchors: key, model. One that leaves
    is a cluster of its own; it takes the oldest model that it is anchored to, was
    not separated from, and that no cluster has, if no other that leaves wants
    it before; else a new model named by a hash of its key.
    """
    away = members.join(rejects, ["key", "model"], "left_semi").select("key")
    taken = members.join(away, "key", "left_anti").select("model").distinct()
    own = anchors.join(away, "key").join(rejects, ["key", "model"], "left_anti").join(taken, "model", "left_anti")
    first = first_by(own, ["key"], [F.col("model")])
    first = first_by(first, ["model"], [F.col("key")]).select("key", F.col("model").cast("string").alias("own"))
    new = F.concat(F.lit("new-"), F.substring(F.sha1("key"), 1, 16))
    left = away.join(first, "key", "left").select("key", F.col("key").alias("cluster"), F.coalesce("own", new).alias("model"), F.lit(True).alias("split"))
    stay = members.join(away, "key", "left_anti").select("key", "cluster", F.col("model").cast("string").alias("model"), F.lit(False).alias("split"))
    return stay.unionByName(left)


def membership_claims(edges: DataFrame, members: DataFrame, most: int = 4) -> DataFrame:
    """(key, model, method, confidence, partners, groups): why a member is in its model, by the automatic edges to other members.

    edges: a, b, confidence, method, groups (array), in the order of a and b;
    members: key, cluster, model. The best edge gives method and confidence, the
    first ``most`` edges the partners that are shown; a cluster of one has none.
    """
    one = edges.select(F.col("a").alias("key"), F.col("b").alias("with"), "confidence", "method", "groups", F.concat("a", "b").alias("_o"))
    both = one.unionByName(edges.select(F.col("b").alias("key"), F.col("a").alias("with"), "confidence", "method", "groups", F.concat("a", "b").alias("_o")))
    of = members.select(F.col("key").alias("with"), F.col("cluster").alias("_c"))
    rows = both.join(members, "key").join(of, "with").where("cluster = _c")
    best = first_by(rows, ["key"], [ranked(F.col("confidence"), *_CONFIDENCE), F.col("_o")]).select("key", "model", "method", "confidence")
    shown = top_within(rows, ["key"], [F.col("_o")], most).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "with"))), lambda x: x["with"]).alias("partners"))
    groups = rows.select("key", F.explode("groups").alias("g")).groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("g")), ",").alias("groups"))
    return best.join(shown, "key").join(groups, "key", "left").withColumn("groups", F.coalesce("groups", F.lit("")))


def anchors_after(anchors: DataFrame, members: DataFrame, aliases: DataFrame) -> DataFrame:
    """(content_key, model, moved): anchors of a run. One moves only if its content is in the index and in another model now.

    anchors: content_key, model; members: key, model; aliases: alias, key.
    """
    now = members.select(F.col("key").alias("_k"), F.col("model").alias("_now"))
    canonical = anchors.join(aliases.select(F.col("alias").alias("content_key"), F.col("key").alias("_a")), "content_key", "left").withColumn("_k", F.coalesce("_a", "content_key"))
    stay = canonical.join(now, "_k", "left").where("_now IS NULL OR _now = model").select("content_key", "model", F.lit(False).alias("moved"))
    had = anchors.select(F.col("content_key").alias("key"), "model")
    new = members.select("key", "model").join(had, ["key", "model"], "left_anti").select(F.col("key").alias("content_key"), "model", F.lit(True).alias("moved"))
    return stay.unionByName(new).distinct()


def model_names(titles: DataFrame) -> DataFrame:
    """(model, name): a project's title, else the commonest title that is not all generic as its first file writes it, else the first file's own words.

    titles: model, place, project_title, normalized, display, noise_only,
    token_count, generic_score, file_name.
    """
    project = titles.where("project_title IS NOT NULL AND project_title <> ''").groupBy("model").agg(F.min_by("project_title", "place").alias("by_project"))
    telling = titles.where("normalized <> '' AND token_count > 0 AND generic_score < 1")
    best = most_common(telling, "model", "normalized").select("model", F.col("normalized").alias("best"))
    shown = telling.join(best, "model").where("normalized = best").groupBy("model", "best").agg(F.min_by("display", F.when(F.col("display") != "", F.col("place"))).alias("shown"))
    shown = shown.select("model", F.coalesce("shown", F.initcap("best")).alias("by_title"))
    stem = F.regexp_replace("file_name", r"\.[^.]+$", "")
    last = titles.groupBy("model").agg(F.min_by(F.when(F.length("noise_only") >= 2, F.col("noise_only")).otherwise(stem), "place").alias("fallback"))
    return last.join(project, "model", "left").join(shown, "model", "left").select("model", F.coalesce("by_project", "by_title", "fallback").alias("name"))


def model_facts(models: DataFrame, projects: DataFrame) -> DataFrame:
    """models with designer, license and design_model_id filled where they are null, from the first project that states each.

    models: model and the three; projects: model, place and the three.
    """
    columns = ("designer", "license", "design_model_id")
    stated = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("place"))
    first = projects.groupBy("model").agg(*[F.min_by(c, stated(c)).alias(f"_{c}") for c in columns])
    out = models.join(first, "model", "left")
    return out.select("model", *[F.coalesce(c, f"_{c}").alias(c) for c in columns])


def model_folders(files: DataFrame, folders: DataFrame) -> DataFrame:
    """(folder, status, reason): which top folders of files hold one model each.

    files: root_id, rel_path, of roots that are grouped by folders; folders:
    root_id, rel_path, class. A folder of a designer, format or printer is none;
    one with further folders of files that are no format folders is nested.
    """
    parts = F.split("rel_path", "/")
    tops = files.where(F.size(parts) > 1).select("root_id", parts[0].alias("top"), F.when(F.size(parts) > 2, F.concat_ws("/", parts[0], F.get(parts, F.lit(1)))).alias("sub"))
    inner = folders.where((F.size(parts) == 2) & (F.col("class") != "format")).select("root_id", F.col("rel_path").alias("sub"))
    nested = tops.join(inner, ["root_id", "sub"]).groupBy("root_id", "top").agg(F.count_distinct("sub").alias("subs"))
    own = folders.select("root_id", F.col("rel_path").alias("top"), "class")
    out = tops.select("root_id", "top").distinct().join(own, ["root_id", "top"], "left").join(nested, ["root_id", "top"], "left")
    status = F.when(F.col("class").isin("designer", "format", "printer_family_like"), "not_model_folder").when(F.col("subs") > 0, "nested").otherwise("model_folder")
    reason = F.when(status == "not_model_folder", F.concat(F.lit("classified "), "class")).when(status == "nested", F.concat(F.lit("holds further folders with files: "), F.col("subs").cast("string"))).otherwise("top folder")
    return out.select(F.concat_ws(":", "root_id", "top").alias("folder"), status.alias("status"), reason.alias("reason"))


def protected_names(terms: DataFrame, members: DataFrame) -> DataFrame:
    """(terms, keys, models): generic terms that files of several models share, terms of exactly the same files as one case.

    terms: term, key; members: key, model. Each key is counted once a term. The
    files of a term are never gathered: their number and sums and exclusive ors
    of two hashes tell sets that may be equal, and joining those with the first
    of them, file by file, tells whether they are.
    """
    rows = written(terms.select("term", "key").where("term IS NOT NULL AND key IS NOT NULL").distinct(), "terms")
    models = rows.join(members.select("key", "model").distinct(), "key").select("term", "model").distinct().groupBy("term").agg(F.count("model").alias("models")).where("models > 1")
    one, other = F.xxhash64("key"), F.xxhash64("key", F.lit("other"))
    total = lambda h: F.sum(h.cast("decimal(20,0)"))
    told = rows.groupBy("term").agg(F.count("*").alias("keys"), F.struct(total(one), total(other), F.bit_xor(one), F.bit_xor(other)).alias("print")).where(F.col("keys") > 1)
    left, cases = written(told.join(models, "term"), "prints"), []
    while not left.isEmpty():
        heads = left.join(left.groupBy("keys", "print").agg(F.min("term").alias("head")), ["keys", "print"])
        pairs = heads.select("term", "head").where("term <> head")
        met = rows.join(pairs, "term").join(rows.withColumnRenamed("term", "head"), ["head", "key"]).groupBy("term").agg(F.count("*").alias("met"))
        tested = written(heads.join(met, "term", "left").withColumn("same", (F.col("term") == F.col("head")) | (F.coalesce("met", F.lit(0)) == F.col("keys"))), "cases")
        cases.append(tested.where("same"))
        left = tested.where("NOT same").select(*left.columns)  # two sets with one print: told apart in another round
    found = reduce(DataFrame.unionByName, cases) if cases else left.withColumn("head", F.col("term"))
    return found.groupBy("head").agg(F.sort_array(F.collect_list("term")).alias("terms"), F.max("keys").alias("keys"), F.max("models").alias("models")).select("terms", "keys", "models")
