"""The search document of each model and the caches that listings read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import search_forms


def model_families(variants: DataFrame, files: DataFrame) -> DataFrame:
    """(model, family, n): printer families of each model's variants, with how many there are.

    variants: file_id, family; files: id, model, entry_path.
    """
    own = files.where("model IS NOT NULL AND entry_path = ''").select(F.col("id").alias("file_id"), "model")
    return variants.where("family IS NOT NULL").join(own, "file_id").groupBy("model", "family").agg(F.count("*").alias("n"))


def _joined(rows: DataFrame, name: str, column: Column, distinct: bool = True) -> DataFrame:
    values = F.collect_set(column) if distinct else F.collect_list(column)
    return rows.groupBy("model").agg(F.array_join(F.array_sort(values), "," if distinct else " ").alias(name))


def documents(models: DataFrame, files: DataFrame, projects: DataFrame, objects: DataFrame) -> DataFrame:
    """One row a model that holds files: the texts that a search looks in.

    models: model, name, designer, notes; files: id, model, name, entry_path;
    projects: file_id, title, designer; objects: file_id, raw_name, generic,
    origin. Every part is aggregated by model on its own before it is joined.
    """
    own = files.where("model IS NOT NULL").select(F.col("id").alias("file_id"), "model", "name", "entry_path")
    of = lambda rows: rows.join(own.select("file_id", "model"), "file_id")
    names = _joined(own.where("entry_path = ''"), "file_names", F.col("name"), distinct=False)
    stem = F.regexp_replace("name", r"(?i)\.(?:gcode|gco|g|bgcode|3mf|stl|obj|step|stp)$", "")
    stems = _joined(own.where("entry_path = ''"), "_stems", stem, distinct=False)
    titles = _joined(of(projects).where("title IS NOT NULL"), "project_titles", F.col("title"))
    makers = _joined(of(projects.select("file_id", F.col("designer").alias("_d"))).where("_d IS NOT NULL"), "_makers", F.col("_d"))
    parts = _joined(of(objects.where("NOT generic AND origin <> 'source_file'")), "object_names", F.col("raw_name"))
    out = models.join(own.select("model").distinct(), "model", "left_semi")
    for part in (names, stems, titles, makers, parts):
        out = out.join(part, "model", "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    out = out.select(
        "model",
        text(F.col("name")).alias("name"),
        F.trim(F.concat_ws(" ", text(F.col("designer")), text(F.col("_makers")))).alias("designer"),
        *[text(F.col(c)).alias(c) for c in ("file_names", "object_names", "project_titles", "notes")],
        text(F.col("_stems")).alias("_stems"),
    )
    return out.withColumn("terms", search_forms(F.concat_ws(" ", "name", "project_titles", "_stems"))).drop("_stems")
