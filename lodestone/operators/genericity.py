"""Names that identify nothing because unrelated titles use them.

Whether two titles are related is looked up, not tried: equal letters, equal
bags of words and words or letters inside one another all become equal keys, of
which a title has no more than its own length gives. Related titles of a name
then form components, so no name's titles are gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written
from .graph import components

#: Letters from which one title inside another counts; groups whose first title is told.
LEAST, TOLD = 4, 8


def _parts(list_: Column, least: int, join: str) -> Column:
    """All runs of neighbours of at least ``least``, each once."""
    n = F.size(list_)
    starts = F.when(n >= least, F.sequence(F.lit(1), n - least + 1)).otherwise(F.array().cast("array<int>"))
    runs = F.transform(starts, lambda i: F.transform(F.sequence(i + least - 1, n), lambda j: F.array_join(F.slice(list_, i, j - i + 1), join)))
    return F.array_distinct(F.flatten(runs))


def _letters(text: Column, least: int) -> Column:
    """All runs of letters of at least ``least``, each once."""
    n = F.char_length(text)
    starts = F.when(n >= least, F.sequence(F.lit(1), n - least + 1)).otherwise(F.array().cast("array<int>"))
    runs = F.transform(starts, lambda i: F.transform(F.sequence(i + least - 1, n), lambda j: F.substring(text, i, j - i + 1)))
    return F.array_distinct(F.flatten(runs))


def contained_titles(titles: DataFrame) -> DataFrame:
    """(outer, inner): titles one of which holds the other.

    titles: title, distinct. Held are the other's letters and digits, four or
    more, wherever words part them; or, where these are fewer, its words as
    neighbours, if they take four characters with their blanks. Equal letters
    are not listed.
    """
    compact = F.regexp_replace("title", r"[^\p{L}\p{N}]", "")
    rows = titles.select("title", compact.alias("compact"))
    long_, short = rows.where(F.char_length("compact") >= LEAST), rows.where((F.char_length("compact") < LEAST) & (F.char_length("title") >= LEAST))
    inner = long_.select(F.col("title").alias("inner"), F.col("compact").alias("part"))
    outer = long_.select(F.col("title").alias("outer"), "compact", F.explode(_letters(F.col("compact"), LEAST)).alias("part")).where("part <> compact")
    by_letters = outer.join(inner, "part").select("outer", "inner")
    words = F.split("title", " ")
    few = rows.select(F.col("title").alias("outer"), F.explode(_parts(words, 1, " ")).alias("inner")).where("inner <> outer")
    few = few.where((F.char_length("inner") >= LEAST) & (F.char_length(F.regexp_replace("inner", r"[^\p{L}\p{N}]", "")) < LEAST))
    return by_letters.unionByName(few.join(short.select(F.col("title").alias("inner")), "inner", "left_semi").select("outer", "inner")).distinct()


def common_objects(names: DataFrame, least: int = 3) -> DataFrame:
    """(name, groups, titles) of object names that at least ``least`` unrelated titles use.

    names: name, title; empty and null titles count for nothing. Titles are
    related if they are made of the same letters, or of the same words in any
    order, or if one holds the other (``contained_titles``), directly or through
    further titles of the same name. ``titles``: the first of each group, eight
    at most.
    """
    used = written(names.where("name IS NOT NULL AND title <> ''").select("name", "title").distinct(), "used")
    many = used.groupBy("name").count().where(F.col("count") >= least).select("name")
    used = written(used.join(many, "name", "left_semi"), "used")
    words = F.array_join(F.array_sort(F.split("title", r"\s+")), " ")
    compact = F.regexp_replace("title", r"[^\p{L}\p{N}]", "")
    node = lambda title: F.concat_ws("\u0001", "name", title)
    links = None
    for alike in (F.concat(F.lit("w"), words), F.when(F.char_length(compact) >= LEAST, F.concat(F.lit("c"), compact))):
        keyed = used.withColumn("alike", alike).where("alike IS NOT NULL")
        heads = keyed.groupBy("name", "alike").agg(F.min("title").alias("head"), F.count("*").alias("n")).where("n > 1")
        same = keyed.join(heads, ["name", "alike"]).where("title <> head").select(node("title").alias("a"), node("head").alias("b"))
        links = same if links is None else links.unionByName(same)
    inside = written(contained_titles(used.select("title").distinct()), "inside")
    held = used.withColumnRenamed("title", "outer").join(inside, "outer").join(used.withColumnRenamed("title", "inner"), ["name", "inner"], "left_semi")
    links = links.unionByName(held.select(node("outer").alias("a"), node("inner").alias("b")))
    found = components(used.select(node("title").alias("key")), links).where("key = component")
    first = found.select(F.substring_index("component", "\u0001", 1).alias("name"), F.substring_index("component", "\u0001", -1).alias("title"))
    groups = first.groupBy("name").agg(F.count("*").cast("int").alias("groups")).where(F.col("groups") >= least)
    told = first.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy("title"))).where(F.col("_r") <= TOLD)
    return groups.join(told.groupBy("name").agg(F.array_sort(F.collect_list("title")).alias("titles")), "name")
