"""Re-keying: what follows once files' full hashes are known.

A file's key is provisional (``q:`` and a fingerprint) until its hash is there,
or was restored from what was known of its fingerprint. Claims go with the
content that they were made of; what people decided follows only when no file
holds the old key any more, and never goes from one content to another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.commits import Tables

#: Columns of each table that hold keys of contents, a plate's number after # included.
AUTHORED = {"decisions": ("subject_key", "object_key"), "prints": ("content_key",), "review_items": ("content_key", "other_content_key"), "models": ("cover_content_key",)}


def verdicts(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """(id, old_key, new_key, verdict) of files whose hash arrived.

    files: id, size, mtime_ms, quick_fp, content_key, sha256; hashes: id, size,
    mtime_ms, quick_fp as they were when the file was read, sha256. verdict:
    changed (the file is not as it was read, its hash counts for nothing), same,
    confirmed (a restored key that is right), contradicted (one that is wrong)
    or rekeyed.
    """
    told = hashes.select("id", *[F.col(c).alias(f"_{c}") for c in ("size", "mtime_ms", "quick_fp")], F.col("sha256").alias("new_key"))
    as_read = F.lit(True)
    for c in ("size", "mtime_ms", "quick_fp"):
        as_read = as_read & F.col(c).eqNullSafe(F.col(f"_{c}"))
    restored = F.col("sha256").isNull() & ~F.col("content_key").startswith("q:")
    verdict = F.when(~as_read, "changed").when((F.col("content_key") == F.col("new_key")) & restored, "confirmed").when(F.col("content_key") == F.col("new_key"), "same")
    verdict = verdict.when(restored, "contradicted").otherwise("rekeyed")
    return files.join(told, "id").select("id", F.col("content_key").alias("old_key"), "new_key", verdict.alias("verdict"))


def moves(files: DataFrame, told: DataFrame) -> DataFrame:
    """(old_key, new_key, verdict, still_used, last): distinct changes of keys.

    ``still_used``: a file keeps the old key; ``last``: of several new keys the
    one that what people decided follows, that of the last file.
    """
    changed = told.where("verdict IN ('rekeyed', 'contradicted')")
    kept = files.join(changed.select("id"), "id", "left_anti").select(F.col("content_key").alias("old_key")).distinct().withColumn("still_used", F.lit(True))
    last = changed.groupBy("old_key").agg(F.max_by("new_key", "id").alias("_last"))
    each = changed.groupBy("old_key", "new_key").agg(F.max("verdict").alias("verdict"))
    return each.join(kept, "old_key", "left").join(last, "old_key").select("old_key", "new_key", "verdict", F.coalesce("still_used", F.lit(False)).alias("still_used"), (F.col("new_key") == F.col("_last")).alias("last"))


def _stem(c: str):
    return F.substring_index(c, "#", 1)


def _moved(rows: DataFrame, column: str, to: DataFrame) -> DataFrame:
    """``column`` with its key in place of old ones; what stands after # stays."""
    own = to.select(F.col("old_key").alias("_old"), F.col("new_key").alias("_new"))
    rest = F.regexp_extract(column, "(#.*)$", 1)
    out = rows.join(own, _stem(column) == F.col("_old"), "left")
    return out.withColumn(column, F.when(F.col("_new").isNotNull(), F.concat("_new", rest)).otherwise(F.col(column))).drop("_old", "_new")


def claim_key():
    return F.sha1(F.concat_ws("|", "subject_type", "subject_key", "relation", "object_type", "object_key"))


def rekeyed_claims(claims: DataFrame, to: DataFrame) -> DataFrame:
    """claims after the moves: those of an old key are there for each of its new keys, and for the old one if a file keeps it.

    claims: subject_type, subject_key, relation, object_type, object_key,
    automatic and any others. From a key that was restored wrongly only
    automatic ones go. Of equal claims the one that was there stays.
    """
    ends = to.select("old_key", "new_key", "verdict", "still_used")
    side = lambda n: ends.select(*[F.col(c).alias(f"{n}_{c}") for c in ends.columns])
    both = claims.join(side("s"), _stem("subject_key") == F.col("s_old_key"), "left").join(side("o"), _stem("object_key") == F.col("o_old_key"), "left")
    goes = lambda n: F.coalesce((F.col(f"{n}_verdict") == "rekeyed") | F.col("automatic"), F.lit(False)) & F.col(f"{n}_new_key").isNotNull()
    both = both.withColumns({"_s": goes("s"), "_o": goes("o")})
    key = lambda n, c: F.when(F.col(f"_{n}"), F.concat(f"{n}_new_key", F.regexp_extract(c, "(#.*)$", 1))).otherwise(F.col(c))
    new = both.where("_s OR _o").withColumns({"subject_key": key("s", "subject_key"), "object_key": key("o", "object_key")}).withColumn("_rank", F.lit(1))
    gone = (F.col("_s") & ~F.col("s_still_used")) | (F.col("_o") & ~F.col("o_still_used"))
    old = both.withColumn("_gone", F.coalesce(gone, F.lit(False))).where("NOT _gone").withColumn("_rank", F.lit(0))
    names = [c for c in claims.columns if c != "claim_key"]
    all_ = old.select(*names, "_rank").unionByName(new.select(*names, "_rank")).withColumn("claim_key", claim_key())
    first = all_.groupBy("claim_key").agg(F.min_by(F.struct(*names), F.struct("_rank", F.to_json(F.struct(*names)))).alias("c"))
    return first.select("claim_key", "c.*")


def rekeyed_anchors(anchors: DataFrame, to: DataFrame) -> DataFrame:
    """(model, content_key) after the moves; a model has a key once."""
    return _moved(anchors, "content_key", to.where("verdict = 'rekeyed' AND NOT still_used AND last")).select("model", "content_key").distinct()


def aliases_after(aliases: DataFrame, files: DataFrame, told: DataFrame) -> DataFrame:
    """(alias, content_key): provisional keys and what they became, the last file's hash; a wrongly restored key is no longer meant unless a file with the fingerprint still has it."""
    new = told.where("verdict = 'rekeyed'").groupBy(F.col("old_key").alias("alias")).agg(F.max_by("new_key", "id").alias("content_key"))
    wrong = told.where("verdict = 'contradicted'").join(files.select("id", "quick_fp"), "id").select(F.concat(F.lit("q:"), "quick_fp").alias("alias"), F.col("old_key").alias("content_key")).distinct()
    holds = files.join(told.where("verdict IN ('rekeyed', 'contradicted')").select("id"), "id", "left_anti").select(F.concat(F.lit("q:"), "quick_fp").alias("alias"), "content_key").distinct()
    kept = aliases.join(wrong.join(holds, ["alias", "content_key"], "left_anti"), ["alias", "content_key"], "left_anti")
    return kept.join(new, "alias", "left_anti").select("alias", "content_key").unionByName(new)


def apply_hashes(tables: Tables, hashes: DataFrame) -> None:
    """Re-key all tables by a batch of hashes, as one commit.

    Tables: files, claims, content_aliases, model_anchors and those of AUTHORED;
    any but files may be missing.
    """
    there = set(tables.names())
    files = tables.read("files")
    told = verdicts(files, hashes)
    to = moves(files, told)
    known = told.where("verdict <> 'changed'").select("id", F.col("new_key").alias("_new"))
    out = {"files": files.join(known, "id", "left").withColumns({"content_key": F.coalesce("_new", "content_key"), "sha256": F.coalesce("_new", "sha256")}).select(*files.columns)}
    if "claims" in there:
        out["claims"] = rekeyed_claims(tables.read("claims"), to)
    if "content_aliases" in there:
        out["content_aliases"] = aliases_after(tables.read("content_aliases"), files, told)
    if "model_anchors" in there:
        out["model_anchors"] = rekeyed_anchors(tables.read("model_anchors"), to)
    for name in AUTHORED.keys() & there:
        rows = tables.read(name)
        for column in AUTHORED[name]:
            if column in rows.columns:
                rows = _moved(rows, column, to.where("verdict = 'rekeyed' AND NOT still_used AND last"))
        out[name] = rows
    tables.commit(**out)
