"""Queries of commands over a catalogue derived from customers (models) and their orders (files)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import commands
from ..sources.storage import written
from .registry import query
from .tables import table

_FACTS = """
SELECT concat('m', c_custkey) AS model, 'name' AS field, c_name AS value FROM customer
UNION ALL SELECT concat('m', c_custkey), 'merged_into', concat('m', c_custkey - 1) FROM customer WHERE c_custkey % 19 = 0
UNION ALL SELECT concat('m', c_custkey), 'designer', concat('by ', c_custkey % 7) FROM customer WHERE c_custkey % 3 = 0"""
_FILES = """
SELECT concat('f', o_orderkey) AS content_key, CAST(NULL AS VARCHAR(9)) AS container, concat('m', o_custkey) AS model, CASE o_orderkey % 4 WHEN 0 THEN 'sliced' WHEN 1 THEN 'project' WHEN 2 THEN 'source' ELSE 'image' END AS role,
  concat('file ', o_orderkey, '.gcode') AS name, o_orderkey % 2 = 0 AS pictured FROM orders"""
_APART = "SELECT concat('d', c_custkey) AS id, 'model' AS subject_type, concat('m', c_custkey) AS subject_key, 'distinct_from' AS relation, concat('m', c_custkey + 2) AS object_key FROM customer WHERE c_custkey % 11 = 0"
_PINS = "SELECT concat('p', o_orderkey) AS id, 'file' AS subject_type, concat('f', o_orderkey) AS subject_key, 'member_of' AS relation, concat('m', o_custkey) AS object_key FROM orders WHERE o_orderkey % 7 = 0"
_REVIEWS = """
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'ambiguous_grouping' ELSE 'suggested_match' END AS kind, concat('m', c_custkey) AS model, concat('m', c_custkey + 1) AS other,
  CASE WHEN c_custkey % 5 = 0 THEN 'resolved' ELSE 'open' END AS status FROM customer"""
_COMMANDS = """
SELECT c_custkey AS id, CASE CAST(floor(c_custkey / 4) AS BIGINT) % 6 WHEN 0 THEN 'merge' WHEN 1 THEN 'reject' WHEN 2 THEN 'move' WHEN 3 THEN 'hide' WHEN 4 THEN 'rename' ELSE 'dismiss' END AS kind, concat('m', c_custkey) AS model,
  concat('m', c_custkey + 1) AS other, CASE WHEN c_custkey % 8 = 0 THEN ' ' ELSE concat('  New ', c_custkey) END AS name, first_file
FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first_file FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey WHERE c_custkey % 4 = 0"""

#: The SQL twin of a command's check.
_JUDGED = f"""c AS (SELECT id, kind, name, first_file, id % 3 AS three, id % 5 AS five, id % 19 = 0 OR (kind NOT IN ('hide', 'rename') AND (id + 1) % 19 = 0) AS merged,
  kind NOT IN ('hide', 'rename', 'dismiss') AND id + 1 NOT IN (SELECT c_custkey FROM customer) AS lost FROM ({_COMMANDS})),
j AS (SELECT *, CASE WHEN kind IN ('reject', 'dismiss') AND five = 0 THEN 'review_resolved' WHEN kind = 'reject' AND three = 0 THEN 'wrong_review_kind' WHEN lost THEN 'model_not_found' WHEN kind <> 'dismiss' AND merged THEN 'model_merged'
  WHEN kind = 'move' AND first_file IS NULL THEN 'no_files' WHEN kind = 'move' AND first_file % 4 = 3 THEN 'not_model_file' WHEN kind = 'rename' AND trim(name) = '' THEN 'name_required' END AS refused FROM c)"""


def _state(spark, sf_dir) -> commands.State:
    of = {n: table(spark, sf_dir, n) for n in ("customer", "orders")}

    def rows(text, name, **more):
        df = spark.sql(text.replace("FROM customer", "FROM {customer}").replace("FROM orders", "FROM {orders}"), **of)
        wanted = [c.strip().split(" ") for c in commands.SCHEMAS[name].split(", ")]
        return df.select(*[(F.col(c) if c in df.columns else more.get(c, F.lit(None))).cast(t).alias(c) for c, t in wanted])

    decided = {"action_id": F.lit(0), "polarity": F.lit("affirm")}
    return commands.fresh(rows(_FACTS, "facts"), rows(_FILES, "files"), decisions=rows(_APART, "decisions", **decided).union(rows(_PINS, "decisions", **decided)), reviews=rows(_REVIEWS, "reviews"))


def _given(spark, sf_dir):
    text = _COMMANDS.replace("FROM customer", "FROM {customer}").replace("FROM orders", "FROM {orders}")
    c = spark.sql(text, **{n: table(spark, sf_dir, n) for n in ("customer", "orders")})
    nothing, by_review = F.lit(None), F.col("kind").isin("reject", "dismiss")
    file = F.when((F.col("kind") == "move") & F.col("first_file").isNotNull(), F.array(F.concat(F.lit("f"), F.col("first_file").cast("string"))))
    return c.select("id", "kind", F.when(~by_review, F.col("model")).alias("model"), F.when(F.col("kind").isin("merge", "move"), F.col("other")).alias("other"), F.when(by_review, F.col("id")).alias("review"), file.alias("files"), "name", nothing.cast("boolean").alias("auto"), nothing.cast("int").alias("plate"), nothing.cast("array<string>").alias("keep"))


@query("command_refusals", f"WITH {_JUDGED} SELECT id, refused FROM j")
def command_refusals(spark, sf_dir):
    """Why each command does not apply, null where it does."""
    return commands.judged(_given(spark, sf_dir), _state(spark, sf_dir)).select("id", "refused")


@query("command_effects", f"""
WITH {_JUDGED}, ok AS (SELECT * FROM j WHERE refused IS NULL),
placed AS (SELECT id, o_orderkey AS o, kind FROM ok JOIN orders ON o_custkey = id AND kind = 'merge' AND o_orderkey % 4 <> 3 UNION ALL SELECT id, first_file, kind FROM ok WHERE kind = 'move'),
made AS (SELECT id || '/member_of/affirm/f' || o || '/m' || (id + 1) AS key FROM placed UNION ALL SELECT id || '/member_of/reject/f' || o || '/m' || id FROM placed WHERE kind = 'move'
  UNION ALL SELECT id || '/distinct_from/affirm/m' || id || '/m' || (id + 1) FROM ok WHERE kind = 'reject'
  UNION ALL SELECT id || '/distinct_from/affirm/m' || (id + 1) || '/m' || (id + 2) FROM ok WHERE kind = 'merge' AND id % 11 = 0
  UNION ALL SELECT id || '/distinct_from/affirm/m' || (id + 1) || '/m' || (id - 2) FROM ok WHERE kind = 'merge' AND id > 2 AND (id - 2) % 11 = 0 AND id - 2 IN (SELECT c_custkey FROM customer)),
facts AS ({_FACTS}),
fresh AS (SELECT 'm' || id AS model, 'merged_into' AS field, 'm' || (id + 1) AS value FROM ok WHERE kind = 'merge' UNION ALL SELECT 'm' || (id + 1), 'designer', 'by ' || (id % 7) FROM ok WHERE kind = 'merge' AND three = 0
  UNION ALL SELECT 'm' || id, 'hidden', '1' FROM ok WHERE kind = 'hide' UNION ALL SELECT 'm' || id, 'name', 'New ' || id FROM ok WHERE kind = 'rename' UNION ALL SELECT 'm' || id, 'name_source', 'user' FROM ok WHERE kind = 'rename')
SELECT 'decision' AS what, key, '' AS value FROM made
UNION ALL SELECT 'decision', id, '' FROM ({_APART})
UNION ALL SELECT 'decision', 'p' || o_orderkey, coalesce((SELECT 'by ' || id FROM placed WHERE o = o_orderkey), '') FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT 'fact', model || '|' || field, value FROM facts WHERE (model, field) NOT IN (SELECT (model, field) FROM fresh)
UNION ALL SELECT 'fact', model || '|' || field, value FROM fresh
UNION ALL SELECT 'review', r.id::VARCHAR, CASE WHEN kind_of = 'reject' OR (kind_of = 'merge' AND status = 'open' AND r.kind = 'suggested_match') THEN 'resolved' WHEN kind_of = 'dismiss' THEN 'dismissed' ELSE status END FROM ({_REVIEWS}) r LEFT JOIN (SELECT id, kind AS kind_of FROM ok) k USING (id)
UNION ALL SELECT 'file', content_key, coalesce((SELECT 'm' || (id + 1) FROM placed WHERE 'f' || o = content_key), model) FROM ({_FILES})""")
def command_effects(spark, sf_dir):
    """Decisions, facts, reviews and places of files after one round of commands."""
    s = _state(spark, sf_dir)
    then = commands.after(written(commands.judged(_given(spark, sf_dir), s), "commands"), s)
    told = lambda rows, what, key, value: rows.select(F.lit(what).alias("what"), key.alias("key"), value.alias("value"))
    by = F.coalesce(F.concat(F.lit("by "), F.coalesce("superseded_by", "withdrawn_by").cast("string")), F.lit(""))
    out = told(then.decisions, "decision", F.col("id"), by)
    out = out.union(told(then.facts, "fact", F.concat_ws("|", "model", "field"), F.col("value")))
    out = out.union(told(then.reviews, "review", F.col("id").cast("string"), F.col("status")))
    return out.union(told(then.files, "file", F.col("content_key"), F.col("model")))
