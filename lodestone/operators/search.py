"""Prefix search over exploded postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import search_forms, words


#: Bytes of items that may be broadcast.
BROADCAST_MOST = 16 << 20


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term), each once."""
    return docs.select(key, F.explode(search_forms(text)).alias("term"))


def query_terms(text: str, most: int = 8) -> list[str]:
    import re

    return re.findall(r"[^\W_]+", text.lower())[:most]


def search(posts: DataFrame, key: str, text: str) -> DataFrame:
    """Keys whose terms begin with every word of the query, or with all words joined; a one-letter word must match whole.

    Case and accents do not count. An empty query finds nothing.
    """
    terms = query_terms(text)
    fold = lambda c: F.collate(c, "UNICODE_CI_AI")
    hit = lambda t: fold(F.col("term")).startswith(F.lit(t)) if len(t) > 1 else fold(F.col("term")) == F.lit(t)
    if not terms:
        return posts.select(key).limit(0)
    any_hit = hit("".join(terms))
    for t in terms:
        any_hit = any_hit | hit(t)
    # Only postings that some word meets are shuffled.
    found = posts.where(any_hit).groupBy(key).agg(*[F.bool_or(hit(t)).alias(f"t{i}") for i, t in enumerate(terms)], F.bool_or(hit("".join(terms))).alias("joined"))
    every = F.lit(True)
    for i in range(len(terms)):
        every = every & F.col(f"t{i}")
    return found.where(every | F.col("joined")).select(key)


def contained(items: DataFrame, docs: DataFrame, item: str, doc: str, first_words: int = 8) -> DataFrame:
    """(item, doc, unique): documents that hold an item's text; unique if it is the only one.

    A shared run of words brings the candidates together, the whole text
    decides. The run is of words inside the item, since those at its ends may
    be cut from longer ones; an item with fewer of them has a run of its own
    length, and one with none is tested against every document.
    """
    needle, w = F.col("needle"), F.col("words")
    first, last = (F.when(needle.rlike(r), 1).otherwise(0) for r in (r"\A[\p{L}\p{N}]", r"[\p{L}\p{N}]\z"))
    a = items.select(item, F.lower("text").alias("needle")).where("needle IS NOT NULL").withColumn("words", words(needle))
    a = a.withColumn("run", F.slice(w, 1 + first, F.least(F.lit(first_words), F.greatest(F.size(w) - first - last, F.lit(0))))).withColumn("n", F.size("run"))
    hashed = lambda list_: F.transform(list_, lambda x: F.xxhash64(x))  # noqa: E731  words once, runs from their hashes
    a = a.select(item, "needle", "n", F.xxhash64(hashed(F.col("run"))).alias("run"))
    sizes = sorted(r.n for r in a.select("n").distinct().collect())  # at most first_words + 1 numbers
    b = docs.select(doc, F.lower("text").alias("hay"))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, n)))
    each = F.explode(F.array_distinct(F.concat(*[runs(n) for n in sizes if n], F.array().cast("array<bigint>"))))
    holds = F.contains("hay", "needle")
    known = a.where("n > 0")
    if (known.agg(F.sum(F.octet_length("needle") + 64)).first()[0] or 0) <= BROADCAST_MOST:
        known = F.broadcast(known)  # then a document's runs are not shuffled
    hits = b.withColumn("w", hashed(words(F.col("hay")))).withColumn("run", each).join(known, "run").where(holds).select(item, doc)
    if 0 in sizes:
        hits = hits.union(a.where("n = 0").join(b, holds).select(item, doc))
    hits = hits.distinct()
    return hits.join(hits.groupBy(item).agg((F.count("*") == 1).alias("unique")), item)
