"""What prints belong to: the link that counts now, histories, outcomes that arrive later, keys that change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .browse import first_by

#: An open job is trusted for so long even if the outcome names another file.
TRUSTED_MS = 3 * 24 * 3600 * 1000
#: Rows that a task of a chain of joins holds.
MOST_ROWS = 100_000


def tasks_for(rows: DataFrame) -> int:
    """Tasks of about MOST_ROWS rows each, as many as shuffles have at least.

    Joins that follow on a key run in the tasks that it was dealt to, each with
    sorts of its own. A number that is given stays, where AQE would put together
    what is small as shuffled; both sides get it, else one is dealt again.
    """
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // MOST_ROWS))


def owner_of_content(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted with ``owner``: the model that holds the content now.

    wanted: id, key, location, at_link; files: content_key, location, model. The
    file it was sent from decides, then the only model, then the model it was in
    when it was linked, then the one with most copies, the older on a tie.
    """
    there = files.where("model IS NOT NULL").select(F.col("content_key").alias("key"), F.col("location").alias("_at"), "model")
    rows = wanted.select("id", "key", "location", "at_link").join(there, "key")
    sent = F.coalesce(F.col("_at") == F.col("location"), F.lit(False)).cast("int")
    copies = rows.groupBy("id", "at_link", "model").agg(F.count("*").alias("n"), F.max(sent).alias("sent"))
    order = [F.desc("sent"), F.when(F.col("sent") == 1, F.col("model")), F.when(F.col("model") == F.col("at_link"), 0).otherwise(1), F.desc("n"), F.col("model")]
    return wanted.join(first_by(copies, ["id"], order).select("id", F.col("model").alias("owner")), "id", "left")


def effective_links(prints: DataFrame, decisions: DataFrame, files: DataFrame) -> DataFrame:
    """(id, model, key, confidence, method, by_decision): a person's decision, else the print's content, else the model at link.

    prints: id, content_key, location, model_at_link, link_confidence,
    link_method, with canonical keys and live models; decisions: id, print_id,
    model, content_key (one of the two), the later one counts; files as for
    ``owner_of_content``.
    """
    number = tasks_for(prints)
    last = first_by(decisions.repartition(number, "print_id"), ["print_id"], [F.desc("id")]).select(F.col("print_id").alias("id"), F.col("model").alias("d_model"), F.col("content_key").alias("d_key"), F.lit(True).alias("by_decision"))
    rows = prints.repartition(number, "id").join(last, "id", "left").withColumn("by_decision", F.coalesce("by_decision", F.lit(False)))
    key = F.when(F.col("by_decision"), F.col("d_key")).otherwise(F.col("content_key"))
    rows = rows.withColumn("key", key).withColumn("at_link", F.when(~F.col("by_decision"), F.col("model_at_link")))
    rows = owner_of_content(rows, files)
    trusted = ~F.coalesce(F.col("link_confidence").isin("low", "none"), F.lit(True))
    by_link = F.when(F.col("key").isNotNull() | trusted, F.col("model_at_link"))
    model = F.when(F.col("by_decision"), F.coalesce("d_model", "owner")).otherwise(F.coalesce(F.col("owner"), by_link))
    told = lambda own, c: F.when(F.col("by_decision"), own).otherwise(F.col(c))
    return rows.select("id", model.alias("model"), "key", told(F.lit("exact"), "link_confidence").alias("confidence"), told(F.lit("decision"), "link_method").alias("method"), "by_decision")


def history(links: DataFrame, prints: DataFrame, visible: Column, most: int = 20) -> DataFrame:
    """(model, rank, id, total): each model's latest prints that may be seen; ``total`` counts all, seen or not.

    links: id, model; prints: id, at and what ``visible`` reads.
    """
    rows = links.where("model IS NOT NULL").select("id", "model").join(prints, "id")
    total = F.count("*").over(Window.partitionBy("model"))
    seen = rows.withColumn("total", total).where(visible)
    rank = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("at"), F.desc("id")))
    return seen.withColumn("rank", rank).where(F.col("rank") <= most).select("model", "rank", "id", "total")


def outcomes_applied(prints: DataFrame, outcomes: DataFrame) -> DataFrame:
    """prints after a batch of outcomes, one a printer: each closes its printer's latest open job if it may be meant.

    prints: id, printer_id, job, outcome, started_at, ended_at; outcomes:
    printer_id, job, outcome, at. The jobs' names agree, or the start is recent.
    """
    last = first_by(prints.where("outcome = 'printing'"), ["printer_id"], [F.desc(F.coalesce("started_at", F.lit(0))), F.desc("id")])
    told = outcomes.where(F.col("outcome").isin("completed", "failed", "cancelled")).select("printer_id", F.col("job").alias("_job"), F.col("outcome").alias("_outcome"), F.col("at").alias("_at"))
    fits = (F.col("job") == F.col("_job")) | (F.col("_at") - F.col("started_at") < TRUSTED_MS)
    closed = last.join(told, "printer_id").where(F.coalesce(fits, F.lit(False))).select("id", "_outcome", "_at")
    return prints.join(closed, "id", "left").withColumn("outcome", F.coalesce("_outcome", "outcome")).withColumn("ended_at", F.coalesce("_at", "ended_at")).drop("_outcome", "_at")


def rekeyed(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """(old_key, new_key, verdict) of provisional keys whose full hash arrived.

    files: id, content_key (q: and a fingerprint while provisional); hashes: id,
    sha256. confirmed: all files of the key have one hash; contradicted: they
    have several, and the key moves to none.
    """
    rows = files.where("content_key LIKE 'q:%'").join(hashes, "id", "left")
    one = rows.groupBy(F.col("content_key").alias("old_key")).agg(F.min("sha256").alias("new_key"), F.count_distinct("sha256").alias("n"), F.max(F.col("sha256").isNull().cast("int")).alias("open"))
    verdict = F.when(F.col("n") > 1, "contradicted").when((F.col("n") == 1) & (F.col("open") == 0), "confirmed").otherwise("pending")
    return one.select("old_key", F.when(verdict == "confirmed", F.col("new_key")).alias("new_key"), verdict.alias("verdict"))


def with_new_keys(rows: DataFrame, moves: DataFrame, column: str) -> DataFrame:
    """Rows whose key column follows confirmed moves; a part after # stays with it."""
    key, rest = F.substring_index(column, "#", 1), F.regexp_extract(column, "(#.*)$", 1)
    to = moves.where("verdict = 'confirmed'").select(F.col("old_key").alias("_k"), F.col("new_key").alias("_n"))
    out = rows.withColumn("_k", key).join(to, "_k", "left")
    return out.withColumn(column, F.when(F.col("_n").isNotNull(), F.concat("_n", rest)).otherwise(F.col(column))).drop("_k", "_n")
