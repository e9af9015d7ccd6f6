"""Queries of the catalogue operators over files, models, prints and decisions that are derived from ``part``, ``orders`` and ``events``.

The derived tables are plain SQL that Spark and DuckDB read alike; each query
calls the operators on them, each SQL twin says the same rule on its own.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import codes, status
from ..operators import eventlog, lineage, membership, prints, queue, resolve, reviews, searchdoc
from .registry import query
from .tables import table

#: Derived tables: the driver's table that they read, and their SELECT.
DERIVED = {
    "files": ("part", """
SELECT p_partkey AS id, concat('r', p_partkey % 3) AS root_id,
  concat(lower(p_brand), '/', lower(p_type), '/', replace(p_name, ' ', '_'), '-', p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.gcode' WHEN 1 THEN '.3mf' WHEN 2 THEN '.stl' ELSE '.png' END) AS rel_path,
  concat(p_name, ' ', CAST(floor(p_partkey / 3) AS BIGINT), CASE p_partkey % 4 WHEN 0 THEN '.gcode' WHEN 1 THEN '.3mf' WHEN 2 THEN '.stl' ELSE '.png' END) AS name,
  CASE p_partkey % 4 WHEN 0 THEN 'sliced' WHEN 1 THEN 'project' WHEN 2 THEN 'source' ELSE 'image' END AS role,
  CASE WHEN p_partkey % 11 = 0 THEN concat('q:', p_partkey) WHEN p_partkey % 7 = 0 THEN concat('s', p_partkey - 7) ELSE concat('s', p_partkey) END AS content_key,
  CASE WHEN p_partkey % 11 <> 0 THEN concat('s', p_partkey) END AS sha256,
  CASE WHEN p_partkey % 17 = 3 THEN 'missing' WHEN p_partkey % 19 = 4 THEN 'unreadable' ELSE 'present' END AS state,
  CASE WHEN p_partkey % 4 = 0 THEN concat('m', p_partkey) END AS md5,
  CASE WHEN p_partkey % 4 <> 3 THEN p_size + 50 * (p_partkey % 2) END AS model, '' AS entry_path
FROM part"""),
    "plates": ("part", "SELECT p_partkey AS file_id, 1 AS plate_no, CASE WHEN p_partkey % 3 = 0 THEN concat('m', p_partkey + 3) END AS gcode_md5, array(p_name, p_brand) AS names FROM part WHERE p_partkey % 4 = 1"),
    "objects": ("part", """
SELECT p_partkey AS file_id, 'exclude_object' AS origin, concat(p_name, ' ', CAST(floor((p_partkey + 2) / 3) AS BIGINT), '.STL') AS raw_name, p_name AS name_norm, p_size < 5 AS generic FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT p_partkey, 'm486', p_brand, p_brand, false FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT p_partkey, 'source_file', upper(concat(p_name, ' ', CAST(floor((p_partkey + p_size % 2) / 3) AS BIGINT), '.stl')), p_name, false FROM part WHERE p_partkey % 4 = 1"""),
    "projects": ("part", "SELECT p_partkey AS file_id, CASE WHEN p_size % 3 = 0 THEN concat('Kit ', p_type) END AS title, CASE WHEN p_size % 2 = 0 THEN p_brand END AS designer, CASE WHEN p_size % 5 = 0 THEN 'CC0' END AS license, CASE WHEN p_size % 7 = 0 THEN concat('d', p_size) END AS design_model_id FROM part WHERE p_partkey % 4 = 1"),
    "models": ("part", "SELECT CAST(m AS BIGINT) AS model, concat('Model ', m) AS name, CASE WHEN m % 4 = 0 THEN concat('maker ', m) END AS designer, CASE WHEN m % 3 = 0 THEN concat('note ', m) END AS notes, CASE WHEN m % 10 = 9 THEN 1 END AS merged_into, m % 8 = 7 AS hidden, CASE WHEN m % 6 = 0 THEN 'MIT' END AS license, CAST(NULL AS VARCHAR(9)) AS design_model_id FROM (SELECT DISTINCT p_size + 50 * (p_partkey % 3) AS m FROM part) x"),
    "roots": ("region", "SELECT concat('r', r_regionkey) AS id, CASE WHEN r_regionkey = 2 THEN 'offline' ELSE 'ok' END AS status, r_regionkey <> 1 AS enabled, r_regionkey <> 3 AS indexed, 'idle' AS full_hash FROM region WHERE r_regionkey < 3"),
    "decisions": ("orders", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN concat('gone', o_orderkey, '#2') ELSE concat('s', o_custkey) END AS subject_key,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('r', o_orderkey % 3, ':x/', o_orderkey) END AS subject_hint FROM orders"""),
    "prints": ("orders", """
SELECT o_orderkey AS id, concat('p', o_custkey % 40) AS printer_id, concat('job', o_custkey % 7) AS job, CASE WHEN o_orderkey % 3 = 0 THEN 'printing' ELSE 'completed' END AS outcome,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey * 1000 END AS started_at, CAST(NULL AS BIGINT) AS ended_at, o_orderkey * 10 AS printed_at,
  CASE WHEN o_orderkey % 4 <> 0 THEN concat('s', o_custkey) END AS content_key, concat('r', o_custkey % 3, ':', o_custkey) AS location, CAST(o_orderkey % 50 AS BIGINT) AS model_at_link,
  CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'exact' END AS link_confidence, 'sha256' AS link_method FROM orders"""),
    "print_decisions": ("orders", "SELECT o_orderkey AS id, CAST(floor(o_orderkey / 2) AS BIGINT) AS print_id, CASE WHEN o_orderkey % 8 = 0 THEN CAST(o_custkey % 30 AS BIGINT) END AS model, CASE WHEN o_orderkey % 8 <> 0 THEN concat('s', o_custkey) END AS content_key FROM orders WHERE o_orderkey % 4 = 0"),
}


def derived(spark, sf_dir, name: str):
    of, text = DERIVED[name]
    return spark.sql(text.replace(f"FROM {of}", "FROM {src}"), src=table(spark, sf_dir, of))


def having(*names: str) -> str:
    """The derived tables as the WITH clause of a SQL twin."""
    return "WITH " + ", ".join(f"{n} AS ({DERIVED[n][1].replace('array(', 'list_value(')})" for n in names)


_PRESENT = "f AS (SELECT * FROM files WHERE state = 'present')"


@query("lineage_claims", f"""
{having("files", "plates", "objects")}, {_PRESENT},
e AS (SELECT DISTINCT g.content_key AS subject, p.content_key AS object FROM f g JOIN plates ON gcode_md5 = g.md5 JOIN f p ON p.id = file_id WHERE g.id <> p.id),
gs AS (SELECT content_key AS subject, string_agg(DISTINCT name_norm, '|' ORDER BY name_norm) AS k FROM objects JOIN f ON f.id = file_id WHERE origin <> 'source_file' AND NOT generic GROUP BY 1),
ps AS (SELECT DISTINCT content_key AS object, array_to_string(list_sort(list_distinct(names)), '|') AS k FROM plates JOIN f ON f.id = file_id),
s AS (SELECT subject, object FROM gs JOIN ps USING (k) WHERE subject <> object EXCEPT SELECT * FROM e),
sn AS (SELECT *, count(*) OVER (PARTITION BY subject) AS hits FROM s),
w AS (SELECT DISTINCT o.file_id, o.raw_name, h.id AS hit FROM objects o JOIN f ON f.id = file_id JOIN f h ON lower(h.name) = lower(o.raw_name) AND h.id <> o.file_id WHERE origin = 'source_file'),
wn AS (SELECT *, count(*) OVER (PARTITION BY file_id, raw_name) AS hits FROM w),
m AS (SELECT DISTINCT o.file_id, o.raw_name, h.id AS hit FROM objects o JOIN f ON f.id = file_id JOIN f h ON lower(h.name) = lower(o.raw_name) AND h.id <> o.file_id AND h.role = 'source' WHERE origin <> 'source_file' AND NOT generic),
mn AS (SELECT *, count(*) OVER (PARTITION BY file_id, raw_name) AS hits FROM m)
SELECT subject, 'sliced_from' AS relation, object, 'plate_md5' AS method, 'exact' AS confidence, 'applied' AS state, 1 AS hits FROM e
UNION ALL SELECT subject, 'sliced_from', object, 'object_names', CASE WHEN hits = 1 THEN 'medium' ELSE 'low' END, CASE WHEN hits = 1 THEN 'suggested' ELSE 'recorded' END, hits FROM sn
UNION ALL SELECT a.content_key, 'source_of', b.content_key, 'source_file_meta', CASE WHEN max(hits) = 1 THEN 'high' ELSE 'low' END, CASE WHEN max(hits) = 1 THEN 'applied' ELSE 'recorded' END, max(hits) FROM wn JOIN f a ON a.id = hit JOIN f b ON b.id = file_id GROUP BY a.content_key, b.content_key
UNION ALL SELECT a.content_key, 'source_of', b.content_key, 'object_name', 'medium', 'suggested', max(hits) FROM mn JOIN f a ON a.id = hit JOIN f b ON b.id = file_id WHERE hits = 1 GROUP BY a.content_key, b.content_key""")
def lineage_claims(spark, sf_dir):
    return _claims(spark, sf_dir)


def _claims(spark, sf_dir):
    present = derived(spark, sf_dir, "files").where("state = 'present'")
    here = lambda name: derived(spark, sf_dir, name).join(present.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    return lineage.lineage(present, here("plates"), here("objects"))


@query("unresolved_sources", f"""
{having("files", "objects")}, {_PRESENT}, o AS (SELECT f.content_key, f.id, raw_name FROM objects JOIN f ON f.id = file_id WHERE origin = 'source_file'),
r AS (SELECT o.content_key FROM o JOIN f ON lower(f.name) = lower(raw_name) AND f.id <> o.id),
s AS (SELECT f.content_key FROM objects JOIN f ON f.id = file_id JOIN f h ON lower(h.name) = lower(raw_name) AND h.role = 'source' AND h.id <> file_id WHERE origin <> 'source_file' AND NOT generic)
SELECT content_key, raw_name FROM o WHERE content_key NOT IN (SELECT content_key FROM r) AND content_key NOT IN (SELECT content_key FROM s)""")
def unresolved_sources(spark, sf_dir):
    present = derived(spark, sf_dir, "files").where("state = 'present'")
    objects = derived(spark, sf_dir, "objects").join(present.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    return reviews.unresolved_sources(objects, present, _claims(spark, sf_dir))


_FOLDERS = """
folders AS (SELECT DISTINCT concat('r', p_partkey % 3) AS root_id, lower(p_brand) AS rel_path, CASE WHEN p_brand LIKE '%1' THEN 'designer' ELSE 'unknown' END AS class FROM part
  UNION SELECT DISTINCT concat('r', p_partkey % 3), concat(lower(p_brand), '/', lower(p_type)), CASE WHEN p_type LIKE 'S%' THEN 'format' ELSE 'unknown' END FROM part WHERE p_brand NOT LIKE '%2')"""


@query("model_folder_status", f"""
{having("files")}, {_FOLDERS},
t AS (SELECT root_id, split_part(rel_path, '/', 1) AS top, split_part(rel_path, '/', 1) || '/' || split_part(rel_path, '/', 2) AS sub FROM files WHERE role <> 'image'),
n AS (SELECT t.root_id, t.top, count(DISTINCT sub) AS subs FROM t JOIN folders d ON d.root_id = t.root_id AND d.rel_path = sub AND class <> 'format' GROUP BY 1, 2)
SELECT x.root_id || ':' || x.top AS folder, CASE WHEN class = 'designer' THEN 'not_model_folder' WHEN subs > 0 THEN 'nested' ELSE 'model_folder' END AS status
FROM (SELECT DISTINCT root_id, top FROM t) x LEFT JOIN folders d ON d.root_id = x.root_id AND d.rel_path = x.top LEFT JOIN n ON n.root_id = x.root_id AND n.top = x.top""")
def model_folder_status(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    root = F.concat(F.lit("r"), (F.col("p_partkey") % 3).cast("string"))
    one = part.select(root.alias("root_id"), F.lower("p_brand").alias("rel_path"), F.when(F.col("p_brand").endswith("1"), "designer").otherwise("unknown").alias("class"))
    two = part.where("p_brand NOT LIKE '%2'").select(root.alias("root_id"), F.concat_ws("/", F.lower("p_brand"), F.lower("p_type")).alias("rel_path"), F.when(F.col("p_type").startswith("S"), "format").otherwise("unknown").alias("class"))
    return membership.model_folders(derived(spark, sf_dir, "files").where("role <> 'image'"), one.union(two).distinct()).select("folder", "status")


@query("folder_classification", """
WITH d AS (SELECT DISTINCT concat('r', p_partkey % 3) AS root_id, concat('p', p_size % 9, '/', CASE p_partkey % 4 WHEN 0 THEN 'STLs' WHEN 1 THEN 'K1C' WHEN 2 THEN p_type ELSE concat('only ', p_partkey) END) AS rel_path, p_partkey % 4 AS what,
  lower(CASE p_partkey % 4 WHEN 0 THEN 'STLs' WHEN 1 THEN 'K1C' WHEN 2 THEN p_type ELSE concat('only', p_partkey) END) AS k, concat('r', p_partkey % 3, ':p', p_size % 9) AS parent FROM part)
SELECT root_id, rel_path, CASE what WHEN 0 THEN 'format' WHEN 1 THEN 'printer_family_like' ELSE CASE WHEN count(*) OVER (PARTITION BY k) > 1 THEN 'designer' ELSE 'unknown' END END AS class FROM d""")
def folder_classification(spark, sf_dir):
    kind = F.col("p_partkey") % 4
    name = F.when(kind == 0, "STLs").when(kind == 1, "K1C").when(kind == 2, F.col("p_type")).otherwise(F.concat(F.lit("only "), F.col("p_partkey").cast("string")))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("r"), (F.col("p_partkey") % 3).cast("string")).alias("root_id"), F.concat(F.lit("p"), (F.col("p_size") % 9).cast("string"), F.lit("/"), name).alias("rel_path")).distinct()
    return resolve.folder_classes(rows).select("root_id", "rel_path", "class")


_MEMBERS = "SELECT p_partkey AS key, p_partkey - p_partkey % 5 AS cluster, (p_partkey - p_partkey % 5) % 400 AS model FROM part"


def _members(spark, sf_dir):
    return spark.sql(_MEMBERS.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part")).select(F.col("key").cast("string").alias("key"), F.col("cluster").cast("string").alias("cluster"), "model")


@query("members_split_out", f"""
WITH m AS ({_MEMBERS}), away AS (SELECT key FROM m WHERE key % 7 = 3), taken AS (SELECT DISTINCT model FROM m WHERE key % 7 <> 3),
a AS (SELECT key, unnest([key % 900 + 1000, key % 50 + 2000, model]) AS own, model FROM m WHERE key % 7 = 3),
c AS (SELECT key, own FROM a WHERE own <> model AND own NOT IN (SELECT model FROM taken)),
f AS (SELECT key, min(own) AS own FROM c GROUP BY key), g AS (SELECT own, min(key::VARCHAR) AS key FROM f GROUP BY own)
SELECT key::VARCHAR AS key, cluster::VARCHAR AS cluster, model::VARCHAR AS model, false AS split FROM m WHERE key % 7 <> 3
UNION ALL SELECT away.key::VARCHAR, away.key::VARCHAR, coalesce(g.own::VARCHAR, 'new-' || substr(sha1(away.key::VARCHAR), 1, 16)), true FROM away LEFT JOIN g ON g.key = away.key::VARCHAR""")
def members_split_out(spark, sf_dir):
    members = _members(spark, sf_dir)
    n = F.col("key").cast("bigint")
    rejects = members.where(n % 7 == 3).select("key", "model")
    anchors = members.select("key", F.explode(F.array(n % 900 + 1000, n % 50 + 2000, F.col("model"))).alias("model"))
    return membership.split_out(members, rejects, anchors)


@query("membership_claims", """
WITH m AS (SELECT p_partkey AS key, p_partkey - p_partkey % 5 AS c FROM part),
e AS (SELECT x.key AS a, y.key AS b, CASE (x.key + y.key) % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN (x.key + y.key) % 2 = 0 THEN 'title' ELSE 'design' END AS method FROM m x JOIN m y ON y.key IN (x.key + 1, x.key + 2)),
h AS (SELECT a AS key, b AS w, e.* FROM e UNION ALL SELECT b, a, e.* FROM e),
r AS (SELECT h.*, row_number() OVER (PARTITION BY h.key ORDER BY CASE confidence WHEN 'exact' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, a::VARCHAR || b::VARCHAR) AS best, row_number() OVER (PARTITION BY h.key ORDER BY a::VARCHAR || b::VARCHAR) AS nth
  FROM h JOIN m x ON x.key = h.key JOIN m y ON y.key = h.w WHERE x.c = y.c)
SELECT key::VARCHAR AS key, max(method) FILTER (WHERE best = 1) AS method, max(confidence) FILTER (WHERE best = 1) AS confidence, string_agg(w::VARCHAR, ',' ORDER BY nth) FILTER (WHERE nth <= 2) AS partners, string_agg(DISTINCT method, ',' ORDER BY method) AS groups FROM r GROUP BY key""")
def membership_claims(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"))
    edges = part.select("a", F.explode(F.array(F.col("a") + 1, F.col("a") + 2)).alias("b")).join(part.select(F.col("a").alias("b")), "b", "left_semi")
    total = F.col("a") + F.col("b")
    method = F.when(total % 2 == 0, "title").otherwise("design")
    edges = edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.when(total % 3 == 0, "exact").when(total % 3 == 1, "high").otherwise("medium").alias("confidence"), method.alias("method"), F.array(method).alias("groups"))
    found = membership.membership_claims(edges, _members(spark, sf_dir), most=2)
    return found.select("key", "method", "confidence", F.array_join("partners", ",").alias("partners"), "groups")


@query("anchors_after_run", f"""
WITH m AS ({_MEMBERS}), a AS (SELECT CASE WHEN key % 6 = 0 THEN 'q' || key ELSE key::VARCHAR END AS content_key, CASE WHEN key % 4 = 0 THEN model + 1 ELSE model END AS model, key FROM m WHERE key % 3 <> 1
  UNION ALL SELECT 'lost' || key, model, NULL FROM m WHERE key % 10 = 1)
SELECT content_key, a.model, false AS moved FROM a LEFT JOIN m ON m.key = a.key WHERE m.model IS NULL OR m.model = a.model
UNION SELECT key::VARCHAR, model, true FROM m WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.content_key = m.key::VARCHAR AND a.model = m.model)""")
def anchors_after_run(spark, sf_dir):
    members = _members(spark, sf_dir)
    n = F.col("key").cast("bigint")
    key = F.when(n % 6 == 0, F.concat(F.lit("q"), "key")).otherwise(F.col("key"))
    own = members.where(n % 3 != 1).select(key.alias("content_key"), F.when(n % 4 == 0, F.col("model") + 1).otherwise(F.col("model")).alias("model"))
    lost = members.where(n % 10 == 1).select(F.concat(F.lit("lost"), "key").alias("content_key"), "model")
    return membership.anchors_after(own.unionByName(lost), members, members.where(n % 6 == 0).select(F.concat(F.lit("q"), "key").alias("alias"), "key"))


@query("model_names", """
WITH t AS (SELECT p_size AS model, p_partkey AS place, CASE WHEN p_size % 4 = 0 AND p_partkey % 5 = 0 THEN 'Kit ' || p_partkey END AS pt, CASE WHEN p_size % 4 = 3 THEN 'part' ELSE p_type END AS norm, p_size % 4 = 3 AS generic FROM part),
n AS (SELECT model, norm, count(*) AS n, min(place) AS place FROM t WHERE NOT generic GROUP BY 1, 2),
b AS (SELECT model, norm, place FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY n DESC, norm) AS r FROM n) WHERE r = 1)
SELECT t.model, coalesce(max(p.pt), max(upper(b.norm) || b.place), 'Part ' || min(t.place)) AS name FROM t LEFT JOIN b ON b.model = t.model LEFT JOIN (SELECT model, pt FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY place) AS r FROM t WHERE pt IS NOT NULL) WHERE r = 1) p ON p.model = t.model GROUP BY t.model""")
def model_names(spark, sf_dir):
    generic = F.col("p_size") % 4 == 3
    n = F.col("p_partkey").cast("string")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_size").alias("model"), F.col("p_partkey").alias("place"), F.when((F.col("p_size") % 4 == 0) & (F.col("p_partkey") % 5 == 0), F.concat(F.lit("Kit "), n)).alias("project_title"),
        F.when(generic, "part").otherwise(F.col("p_type")).alias("normalized"), F.concat(F.upper("p_type"), n).alias("display"), F.concat(F.lit("Part "), n).alias("noise_only"),
        F.lit(1).alias("token_count"), F.when(generic, 1.0).otherwise(0.0).alias("generic_score"), F.lit("x.stl").alias("file_name"),
    )
    return membership.model_names(rows)


@query("model_facts", f"""
{having("files", "projects", "models")}, p AS (SELECT f.model, f.id AS place, r.designer, r.license, r.design_model_id FROM projects r JOIN files f ON f.id = r.file_id WHERE f.model IS NOT NULL)
SELECT m.model, coalesce(m.designer, (SELECT min_by(designer, place) FROM p WHERE p.model = m.model AND designer IS NOT NULL)) AS designer, coalesce(m.license, (SELECT min_by(license, place) FROM p WHERE p.model = m.model AND license IS NOT NULL)) AS license,
  (SELECT min_by(design_model_id, place) FROM p WHERE p.model = m.model AND design_model_id IS NOT NULL) AS design_model_id FROM models m""")
def model_facts(spark, sf_dir):
    own = derived(spark, sf_dir, "files").where("model IS NOT NULL").select(F.col("id").alias("file_id"), "model", F.col("id").alias("place"))
    return membership.model_facts(derived(spark, sf_dir, "models"), derived(spark, sf_dir, "projects").join(own, "file_id"))


@query("protected_names", """
WITH t AS (SELECT unnest([lower(p_brand), 'plate ' || lower(p_brand), p_name || p_size]) AS term, p_partkey AS key, p_partkey % 5 AS model FROM part),
s AS (SELECT term, string_agg(DISTINCT key::VARCHAR, ',' ORDER BY key::VARCHAR) AS ks, count(DISTINCT key) AS keys, count(DISTINCT model) AS models FROM t GROUP BY term HAVING count(DISTINCT key) > 1 AND count(DISTINCT model) > 1)
SELECT string_agg(term, ',' ORDER BY term) AS terms, max(keys) AS keys, max(models) AS models FROM s GROUP BY ks""")
def protected_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    terms = part.select(F.explode(F.array(F.lower("p_brand"), F.concat(F.lit("plate "), F.lower("p_brand")), F.concat("p_name", F.col("p_size").cast("string")))).alias("term"), F.col("p_partkey").cast("string").alias("key"))
    found = membership.protected_names(terms, part.select(F.col("p_partkey").cast("string").alias("key"), (F.col("p_partkey") % 5).alias("model")))
    return found.select(F.array_join("terms", ",").alias("terms"), F.col("keys").cast("bigint").alias("keys"), "models")


@query("search_documents", f"""
{having("files", "projects", "objects", "models")}, f AS (SELECT * FROM files WHERE model IS NOT NULL)
SELECT m.model, m.name, trim(coalesce(m.designer, '') || ' ' || coalesce((SELECT string_agg(DISTINCT p.designer, ',' ORDER BY p.designer) FROM projects p JOIN f ON f.id = p.file_id WHERE f.model = m.model), '')) AS designer,
  coalesce((SELECT string_agg(f.name, ' ' ORDER BY f.name) FROM f WHERE f.model = m.model), '') AS file_names,
  coalesce((SELECT string_agg(DISTINCT o.raw_name, ',' ORDER BY o.raw_name) FROM objects o JOIN f ON f.id = o.file_id WHERE f.model = m.model AND NOT o.generic AND o.origin <> 'source_file'), '') AS object_names,
  coalesce((SELECT string_agg(DISTINCT p.title, ',' ORDER BY p.title) FROM projects p JOIN f ON f.id = p.file_id WHERE f.model = m.model), '') AS project_titles, coalesce(m.notes, '') AS notes
FROM models m WHERE m.model IN (SELECT model FROM f)""")
def search_documents(spark, sf_dir):
    return searchdoc.documents(*[derived(spark, sf_dir, t) for t in ("models", "files", "projects", "objects")]).drop("terms")


@query("model_families", f"""
{having("files")} SELECT model, 'family-' || id % 4 AS family, count(*) AS n FROM files WHERE model IS NOT NULL AND id % 5 <> 0 GROUP BY 1, 2""")
def model_families(spark, sf_dir):
    files = derived(spark, sf_dir, "files")
    variants = files.select(F.col("id").alias("file_id"), F.when(F.col("id") % 5 != 0, F.concat(F.lit("family-"), (F.col("id") % 4).cast("string"))).alias("family"))
    return searchdoc.model_families(variants, files)


_ITEM_SQL = f"""
{having("files", "roots")}, k AS (SELECT f.*, f.root_id || ':' || rel_path AS place, r.status FROM files f LEFT JOIN roots r ON r.id = f.root_id),
i AS (SELECT 'missing_file' AS kind, 'missing:' || place AS subject_key, content_key, place AS location FROM k WHERE state = 'missing' AND status <> 'offline'
UNION ALL SELECT 'unreadable_file', 'unreadable:' || place, content_key, place FROM k WHERE state = 'unreadable' UNION ALL SELECT 'source_offline', 'offline:' || id, NULL, id FROM roots WHERE status = 'offline')"""


@query("review_items_of_files", f"{_ITEM_SQL} SELECT kind, subject_key, content_key, location FROM i")
def review_items_of_files(spark, sf_dir):
    items = reviews.wanted(reviews.file_items(derived(spark, sf_dir, "files"), derived(spark, sf_dir, "roots")))
    return items.select("kind", "subject_key", "content_key", "location")


@query("review_items_to_models", f"""
{_ITEM_SQL}, m AS (SELECT root_id || ':' || rel_path AS place, content_key, model FROM files WHERE model IS NOT NULL)
SELECT subject_key, model FROM i JOIN m ON m.content_key = i.content_key UNION SELECT subject_key, model FROM i JOIN m ON m.place = i.location""")
def review_items_to_models(spark, sf_dir):
    files = derived(spark, sf_dir, "files")
    items = reviews.file_items(files, derived(spark, sf_dir, "roots"))
    return reviews.models_of(items, files, spark.createDataFrame([], "subject_key string, location string"))


@query("availability", f"{having('files', 'roots')} SELECT f.id, CASE WHEN NOT enabled OR status = 'offline' THEN 'offline' WHEN state = 'present' THEN 'ok' ELSE state END AS availability FROM files f LEFT JOIN roots r ON r.id = f.root_id")
def availability(spark, sf_dir):
    roots = derived(spark, sf_dir, "roots").select(F.col("id").alias("root_id"), "enabled", "status")
    return derived(spark, sf_dir, "files").join(roots, "root_id", "left").select("id", reviews.availability(F.col("state"), F.col("enabled"), F.col("status")).alias("availability"))


@query("decisions_without_file", f"""
{having("decisions", "files", "roots")}, p AS (SELECT * FROM files WHERE state = 'present'),
d AS (SELECT *, split_part(subject_key, '#', 1) AS k, split_part(subject_hint, ':', 1) AS root FROM decisions),
g AS (SELECT d.* FROM d LEFT JOIN roots r ON r.id = d.root WHERE k NOT IN (SELECT content_key FROM p) AND (r.id IS NULL OR r.status <> 'offline' AND r.indexed)),
pending AS (SELECT count(*) > 0 AS x FROM p JOIN roots r ON r.id = p.root_id WHERE sha256 IS NULL AND content_key LIKE 'q:%' AND enabled)
SELECT 'decision:' || g.id AS subject_key, k AS content_key FROM g, pending WHERE NOT x OR k LIKE 'q:%'""")
def decisions_without_file(spark, sf_dir):
    found = reviews.decision_items(*[derived(spark, sf_dir, t) for t in ("decisions", "files", "roots")])
    return found.select("subject_key", "content_key")


@query("decisions_after_hashing", f"""
{having("decisions", "files", "roots")}, p AS (SELECT *, root_id || ':x/' || id AS place FROM files WHERE state = 'present' AND sha256 IS NOT NULL),
d AS (SELECT *, split_part(subject_key, '#', 1) AS k, split_part(subject_hint, ':', 1) AS root FROM decisions),
g AS (SELECT d.* FROM d LEFT JOIN roots r ON r.id = d.root WHERE k NOT IN (SELECT content_key FROM p) AND (r.id IS NULL OR r.status <> 'offline' AND r.indexed))
SELECT CASE WHEN p.id IS NOT NULL THEN 'changed:' ELSE 'decision:' END || g.id AS subject_key, coalesce(p.content_key, k) AS content_key FROM g LEFT JOIN p ON p.place = g.subject_hint""")
def decisions_after_hashing(spark, sf_dir):
    files = derived(spark, sf_dir, "files").where("sha256 IS NOT NULL").withColumn("rel_path", F.concat(F.lit("x/"), F.col("id").cast("string")))
    return reviews.decision_items(derived(spark, sf_dir, "decisions"), files, derived(spark, sf_dir, "roots")).select("subject_key", "content_key")


@query("empty_models", f"{having('models', 'files')} SELECT 'empty:' || model AS subject_key FROM models WHERE NOT hidden AND merged_into IS NULL AND model NOT IN (SELECT model FROM files WHERE model IS NOT NULL)")
def empty_models(spark, sf_dir):
    return reviews.empty_models(derived(spark, sf_dir, "models"), derived(spark, sf_dir, "files").where("model IS NOT NULL")).select("subject_key")


@query("effective_links", f"""
{having("prints", "print_decisions", "files")}, fm AS (SELECT content_key, root_id || ':' || id AS place, model FROM files WHERE model IS NOT NULL),
d AS (SELECT print_id, model AS dm, content_key AS dk FROM (SELECT *, row_number() OVER (PARTITION BY print_id ORDER BY id DESC) AS r FROM print_decisions) WHERE r = 1),
w AS (SELECT p.*, d.print_id IS NOT NULL AS dec, dm, CASE WHEN d.print_id IS NOT NULL THEN dk ELSE p.content_key END AS key, CASE WHEN d.print_id IS NULL THEN model_at_link END AS was FROM prints p LEFT JOIN d ON d.print_id = p.id),
c AS (SELECT w.id, fm.model, count(*) AS n, max(CASE WHEN fm.place = w.location THEN 1 ELSE 0 END) AS sent, max(CASE WHEN fm.model = w.was THEN 1 ELSE 0 END) AS was FROM w JOIN fm ON fm.content_key = w.key GROUP BY 1, 2),
o AS (SELECT id, model FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sent DESC, was DESC, n DESC, model) AS r FROM c) WHERE r = 1)
SELECT w.id, CASE WHEN dec THEN coalesce(dm, o.model) ELSE coalesce(o.model, CASE WHEN key IS NOT NULL OR link_confidence NOT IN ('low', 'none') THEN model_at_link END) END AS model, key,
  CASE WHEN dec THEN 'exact' ELSE link_confidence END AS confidence, CASE WHEN dec THEN 'decision' ELSE link_method END AS method, dec AS by_decision FROM w LEFT JOIN o ON o.id = w.id""")
def effective_links(spark, sf_dir):
    return _links(spark, sf_dir)


def _links(spark, sf_dir):
    files = derived(spark, sf_dir, "files").select("content_key", F.concat_ws(":", "root_id", F.col("id").cast("string")).alias("location"), F.col("model").cast("bigint").alias("model"))
    return prints.effective_links(derived(spark, sf_dir, "prints"), derived(spark, sf_dir, "print_decisions"), files)


@query("print_history", f"""
{having("prints")}, l AS (SELECT *, count(*) OVER (PARTITION BY model_at_link) AS total FROM prints)
SELECT model, CAST(rank AS INTEGER) AS rank, id, total FROM (SELECT model_at_link AS model, row_number() OVER (PARTITION BY model_at_link ORDER BY printed_at DESC, id DESC) AS rank, id, total FROM l WHERE printer_id <> 'p3') WHERE rank <= 5""")
def print_history(spark, sf_dir):
    rows = derived(spark, sf_dir, "prints")
    return prints.history(rows.select("id", F.col("model_at_link").alias("model")), rows.select("id", F.col("printed_at").alias("at"), "printer_id"), F.col("printer_id") != "p3", most=5)


_OUTCOMES = "SELECT concat('p', n_nationkey) AS printer_id, concat('job', n_nationkey % 7) AS job, CASE WHEN n_nationkey % 5 = 0 THEN 'paused' ELSE 'failed' END AS outcome, CAST(n_nationkey * 20000000 AS BIGINT) AS at FROM nation"


@query("outcomes_applied", f"""
{having("prints")}, u AS ({_OUTCOMES}), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY printer_id ORDER BY coalesce(started_at, 0) DESC, id DESC) AS r FROM prints WHERE outcome = 'printing') WHERE r = 1),
c AS (SELECT o.id, u.outcome, u.at FROM o JOIN u ON u.printer_id = o.printer_id WHERE u.outcome = 'failed' AND (u.job = o.job OR u.at - o.started_at < 259200000))
SELECT p.id, coalesce(c.outcome, p.outcome) AS outcome, c.at AS ended_at FROM prints p LEFT JOIN c ON c.id = p.id""")
def outcomes_applied(spark, sf_dir):
    told = spark.sql(_OUTCOMES.replace("FROM nation", "FROM {nation}"), nation=table(spark, sf_dir, "nation"))
    return prints.outcomes_applied(derived(spark, sf_dir, "prints"), told).select("id", "outcome", "ended_at")


@query("keys_after_hashing", """
WITH f AS (SELECT p_partkey AS id, 'q:' || p_size AS k, CASE WHEN p_size % 3 = 0 THEN 'h' || p_size WHEN p_size % 3 = 1 THEN 'h' || p_partkey WHEN p_partkey % 2 = 0 THEN 'h' || p_size END AS h FROM part),
m AS (SELECT k, CASE WHEN count(DISTINCT h) > 1 THEN 'contradicted' WHEN count(DISTINCT h) = 1 AND count(h) = count(*) THEN 'confirmed' ELSE 'pending' END AS verdict, min(h) AS h FROM f GROUP BY k)
SELECT f.id, CASE WHEN verdict = 'confirmed' THEN m.h ELSE f.k END || '#1' AS subject_key, verdict FROM f JOIN m ON m.k = f.k""")
def keys_after_hashing(spark, sf_dir):
    size, n = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("q:"), size).alias("content_key"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("h"), size)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("h"), n)).when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("h"), size)).alias("sha256"))
    moves = prints.rekeyed(files.select("id", "content_key"), files.where("sha256 IS NOT NULL").select("id", "sha256"))
    rows = files.select("id", F.concat("content_key", F.lit("#1")).alias("subject_key"), F.col("content_key").alias("old_key"))
    return prints.with_new_keys(rows, moves, "subject_key").join(moves.select("old_key", "verdict"), "old_key").select("id", "subject_key", "verdict")


@query("status_dialects", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN CASE WHEN event_type = 'error' THEN 'error' ELSE 'printing' END WHEN 1 THEN CASE WHEN event_type = 'error' THEN CASE WHEN user_id % 3 = 0 THEN 'error' ELSE 'cancelled' END WHEN event_type = 'view' THEN 'paused' ELSE 'printing' END WHEN 2 THEN CASE WHEN event_type = 'error' THEN 'error' ELSE 'complete' END ELSE 'standby' END AS state,
  CASE event_id % 4 WHEN 0 THEN value / 1000 WHEN 1 THEN least(1.0, value / 100) WHEN 2 THEN value / 1000 ELSE 0.0 END AS progress,
  CASE event_id % 4 WHEN 0 THEN floor(value + 0.5) WHEN 1 THEN floor(value + 0.5) WHEN 2 THEN floor(value + 0.5) END::BIGINT AS bed, CASE WHEN event_id % 4 = 0 AND event_type = 'error' THEN 'KLIPPER_SHUTDOWN' ELSE '' END AS error_code FROM events""")
def status_dialects(spark, sf_dir):
    """Reports of four dialects as JSON, read into one schema."""
    v, bad = F.col("value"), F.col("event_type") == "error"
    reports = {
        "moonraker": F.to_json(F.struct(F.struct(F.when(bad, "shutdown").otherwise("ready").alias("state"), F.lit(" off ").alias("state_message")).alias("webhooks"), F.struct(F.lit("printing").alias("state")).alias("print_stats"), F.struct((v / 1000).alias("progress")).alias("virtual_sdcard"), F.struct(v.alias("temperature")).alias("heater_bed"))),
        "bambu": F.to_json(F.struct(F.when(bad, "FAILED").when(F.col("event_type") == "view", "PAUSE").otherwise("RUNNING").alias("gcode_state"), F.when(F.col("user_id") % 3 == 0, 83902524).when(F.col("user_id") % 3 == 1, status.CANCELLED).otherwise(0).alias("print_error"), v.alias("mc_percent"), v.alias("bed_temper"))),
        "flashforge": F.to_json(F.struct(F.when(bad, "error").otherwise("completed").alias("status"), (v / 1000).alias("printProgress"), v.alias("platTemp"))),
        "creality": F.to_json(F.struct(F.lit(0).alias("state"))),
    }
    rows = table(spark, sf_dir, "events")
    out = None
    for k, (dialect, report) in enumerate(reports.items()):
        part = rows.where(F.col("event_id") % 4 == k).select("event_id", report.alias("report"))
        part = part.select("event_id", status.normalised(F.col("report"), dialect).alias("s"))
        out = part if out is None else out.unionByName(part)
    return out.select("event_id", "s.state", "s.progress", "s.bed", "s.error_code")


@query("catalogue_diagnostics", f"""
{having("files")} SELECT count(*) AS rows, count(*) FILTER (WHERE sha256 IS NOT NULL) AS hashed, (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT role AS k, count(*) AS n FROM files GROUP BY 1)) AS role, (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT state AS k, count(*) AS n FROM files GROUP BY 1)) AS state FROM files""")
def catalogue_diagnostics(spark, sf_dir):
    found = eventlog.diagnostics(derived(spark, sf_dir, "files"), ["role", "state"], {"hashed": F.col("sha256").isNotNull()})
    shown = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(c)
    return found.select("rows", "hashed", shown("role"), shown("state"))


@query("idle_connections", "SELECT user_id, max(ts) AS ts FROM events GROUP BY 1 HAVING (SELECT max(ts) FROM events) - max(ts) > INTERVAL 12 HOUR")
def idle_connections(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return eventlog.idle_since(rows, "user_id", "ts", F.lit(rows.agg(F.max("ts")).first()[0]), F.make_dt_interval(F.lit(0), F.lit(12)))


@query("blend_kinds", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 AND p_size % 3 <> 0 THEN 'ratdoux' WHEN p_partkey % 4 = 1 THEN 'neotko' END AS kind, p_partkey % 3 <> 1 AS overlap FROM part""")
def blend_kinds(spark, sf_dir):
    n = F.col("p_partkey")
    mixed = F.when(F.col("p_size") % 3 == 0, " NIL ").otherwise("a,b")
    config = F.when(n % 4 == 0, F.create_map(F.lit("mixed_filament_definitions"), mixed)).when(n % 4 == 1, F.create_map(F.lit("colorstitch_x"), F.lit("1"))).otherwise(F.create_map(F.lit("layer_height"), F.lit("0.2")))
    place = F.when(n % 3 == 0, "/a/b").when(n % 3 == 1, "/a/bc").otherwise("/a/b/c/")
    return table(spark, sf_dir, "part").select("p_partkey", codes.blend_kind(config).alias("kind"), codes.overlaps(F.lit("/a/b/"), place).alias("overlap"))


@query("simulated_jobs", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN least(1.0, value / 20) WHEN 1 THEN 0.25 WHEN 2 THEN 1.0 ELSE 0.0 END AS progress, CASE event_id % 4 WHEN 0 THEN CASE WHEN value >= 20 THEN 'complete' ELSE 'printing' END WHEN 1 THEN 'paused' WHEN 2 THEN 'complete' ELSE 'idle' END AS phase FROM events""")
def simulated_jobs(spark, sf_dir):
    phase = F.get(F.array(*[F.lit(x) for x in ("printing", "paused", "complete", "other")]), (F.col("event_id") % 4).cast("int"))
    found = codes.simulated(phase, F.lit(0.0), F.lit(20.0), F.lit(0.25), F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", found.alias("x")).select("event_id", "x.progress", "x.phase")


@query("webhook_messages", """
SELECT event_id, '{"printer":"p' || user_id || '","event":"' || event_type || '","message":"","progress":null,"filename":' || CASE WHEN event_id % 2 = 0 THEN 'null' ELSE '"f' || event_id || '"' END || ',"ts":' || event_id || '}' AS body FROM events""")
def webhook_messages(spark, sf_dir):
    name = F.when(F.col("event_id") % 2 == 0, "").otherwise(F.concat(F.lit("f"), F.col("event_id").cast("string")))
    body = codes.webhook_message(F.concat(F.lit("p"), F.col("user_id").cast("string")), F.col("event_type"), F.lit(None).cast("string"), F.lit(None).cast("double"), name, F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", body.alias("body"))


@query("queue_claims", "SELECT c_custkey AS printer_id, c_custkey * 10 AS item FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 4 <> 0")
def queue_claims(spark, sf_dir):
    n = F.col("c_custkey")
    none = F.array().cast("array<bigint>")
    state = F.when(n % 3 == 0, "idle").otherwise("printing")
    rows = table(spark, sf_dir, "customer").select(n.alias("printer_id"), state.alias("state"), (n % 5 == 0).alias("paused"), (n % 7 == 0).alias("stopped"), F.when(n % 4 != 0, F.array(n * 10, n * 10 + 1)).otherwise(none).alias("queue"))
    return queue.claims(rows)


#: Kinds of a queue's events by type of event and event_id % 3.
_QUEUE_KINDS = {"signup": ("add", "add", "add"), "click": ("claim", "dispatched", "claim"), "view": ("dispatched", "deferred", "bed_confirmed"), "error": ("failed", "dispatch_failed", "restart"), "purchase": ("completed", "skip", "resume")}


@query("queue_lives", f"""
WITH k AS (SELECT user_id, event_id, CASE event_type {" ".join(f"WHEN '{t}' THEN {list(k)}[event_id % 3 + 1]" for t, k in _QUEUE_KINDS.items())} END AS kind FROM events),
l AS (SELECT user_id, list(kind ORDER BY event_id) AS kinds FROM k GROUP BY 1),
f AS (SELECT user_id, list_reduce(list_transform(kinds, lambda k: {{'k': k, 's': 'idle', 'r': NULL::VARCHAR, 'w': 0, 'n': 0}}), lambda q, e: CASE
  WHEN e.k = 'add' THEN {{'k': e.k, 's': q.s, 'r': q.r, 'w': q.w + 1, 'n': q.n}}
  WHEN e.k = 'claim' AND q.s = 'idle' AND q.w > 0 THEN {{'k': e.k, 's': 'dispatching', 'r': q.r, 'w': q.w - 1, 'n': q.n}}
  WHEN e.k = 'dispatched' AND q.s = 'dispatching' THEN {{'k': e.k, 's': 'printing', 'r': q.r, 'w': q.w, 'n': q.n}}
  WHEN e.k = 'deferred' AND q.s = 'dispatching' THEN {{'k': e.k, 's': 'idle', 'r': q.r, 'w': q.w + 1, 'n': q.n}}
  WHEN e.k = 'bed_confirmed' AND q.s = 'awaiting_bed_clear' THEN {{'k': e.k, 's': 'idle', 'r': q.r, 'w': q.w, 'n': q.n}}
  WHEN e.k = 'failed' AND q.s = 'printing' THEN {{'k': e.k, 's': '{queue.ATTENTION}', 'r': 'print-failed', 'w': q.w, 'n': q.n}}
  WHEN e.k = 'dispatch_failed' AND q.s = 'dispatching' THEN {{'k': e.k, 's': '{queue.ATTENTION}', 'r': 'dispatch-failed', 'w': q.w, 'n': q.n}}
  WHEN e.k = 'restart' AND q.s = 'dispatching' THEN {{'k': e.k, 's': '{queue.ATTENTION}', 'r': 'recovery-interrupted', 'w': q.w, 'n': q.n}}
  WHEN e.k = 'restart' AND q.s = 'printing' THEN {{'k': e.k, 's': '{queue.ATTENTION}', 'r': 'recovery-unknown-outcome', 'w': q.w, 'n': q.n}}
  WHEN e.k = 'restart' THEN {{'k': e.k, 's': q.s, 'r': q.r, 'w': q.w, 'n': q.n}}
  WHEN e.k = 'completed' AND q.s = 'printing' THEN {{'k': e.k, 's': 'awaiting_bed_clear', 'r': q.r, 'w': q.w, 'n': q.n}}
  WHEN e.k = 'skip' AND q.r = 'dispatch-failed' THEN {{'k': e.k, 's': 'idle', 'r': NULL, 'w': q.w, 'n': q.n}}
  WHEN e.k = 'skip' AND q.r IS NOT NULL THEN {{'k': e.k, 's': 'awaiting_bed_clear', 'r': NULL, 'w': q.w, 'n': q.n}}
  WHEN e.k = 'resume' AND q.r IN ('print-failed', 'recovery-unknown-outcome') THEN {{'k': e.k, 's': 'printing', 'r': NULL, 'w': q.w, 'n': q.n}}
  ELSE {{'k': e.k, 's': q.s, 'r': q.r, 'w': q.w, 'n': q.n + 1}} END, {{'k': '', 's': 'idle', 'r': NULL::VARCHAR, 'w': 0, 'n': 0}}) AS q FROM l)
SELECT user_id::VARCHAR AS printer_id, q.s AS state, q.r AS reason, q.w AS waiting, q.n::BIGINT AS refused FROM f""")
def queue_lives(spark, sf_dir):
    """Where each printer's queue stands after its events, and how many of them did not fit."""
    picked = F.create_map(*[F.lit(x) for t, k in _QUEUE_KINDS.items() for x in (t, json.dumps(k))])[F.col("event_type")]
    kind = F.get(F.from_json(picked, "array<string>"), (F.col("event_id") % 3).cast("int"))
    answer = F.when(kind.isin("skip", "resume"), kind)
    event = F.to_json(F.struct(F.when(answer.isNotNull(), "resolve").otherwise(kind).alias("kind"), answer.alias("answer"), F.lit("item").alias("id")))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("printer_id"), F.col("event_id").alias("at"), "event_id", event.alias("event"))
    last = F.max_by(F.struct("state", "reason", "waiting"), "event_id").alias("q")
    return queue.run_queues(rows).groupBy("printer_id").agg(last, F.count_if("refused").alias("refused")).select("printer_id", "q.state", "q.reason", "q.waiting", "refused")
