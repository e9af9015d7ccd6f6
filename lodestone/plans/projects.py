"""Queries over project archives, which the tables' orders are made into, and over keys of contents."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from ..operators import rekey
from ..operators.prints import tasks_for
from ..sources import archives, zipped
from .registry import query
from .tables import table

_BY = {"F": "BambuStudio-02.06.00.51", "O": "OrcaSlicer-2.1.0", "P": ""}
_KIND = {"N": "3mf", "A": "cone"}


@lru_cache(256)
def _model(title: str, status: str, method: int) -> zipped.Packed:
    """The model's entry, which all orders of a priority and a status share."""
    text = f'<model><metadata name="Title">{title}</metadata><metadata name="Application">{_BY[status]}</metadata><resources>' + "<vertex/>" * 2000 + "</resources></model>"
    return zipped.packed("3D/3dmodel.model", text.encode(), method)


@lru_cache(2)
def _added(method: int) -> list[zipped.Packed]:
    """Entries that are the same in every project."""
    return [zipped.packed("Auxiliaries/Model Pictures/é.png", b"\x89PNG\r\n\x1a\n", method), zipped.packed("Auxiliaries/.thumbnails/small.png", b"none", method)]


def _archive(key: int, title: str, status: str, parts: list[int], quantities: list[float], flags: list[str]) -> bytes:
    """An order as a project: its lines are plates with one object each; the returned ones are sliced."""
    method = zipped.DEFLATED if key % 2 else zipped.STORED
    objects, laid, told, sliced = [], [], [], []
    for n, (part, quantity, flag) in enumerate(zip(parts, quantities, flags, strict=True), 1):
        objects.append(f'<object id="{n}"><metadata key="name" value="Part &amp; {part}"/><part><metadata key="name" value="{part}.{_KIND.get(flag, "stl")}"/><metadata key="source_file" value="{part % 10}.step"/></part></object>')
        laid.append(f'<plate><metadata key="plater_id" value="{n}"/>' + f'<model_instance><metadata key="object_id" value="{n}"/></model_instance>' * (1 + int(quantity) % 3) + "</plate>")
        told.append(
            f'<plate><metadata key="index" value="{n}"/><metadata key="prediction" value="{int(quantity) * 60}"/><metadata key="weight" value="{quantity}"/>'
            f'<filament id="1" type="PLA" color="#00ff00ff" used_g="{quantity}"/><object name="Part {part}" skipped="false"/></plate>'
        )
        if flag == "R":
            sliced.append(zipped.packed(f"Metadata/plate_{n}.gcode", f"G1 X{part}\n".encode(), method))
    laid_out, plates = f"<config>{''.join(objects)}{''.join(laid)}</config>", f"<config>{''.join(told)}</config>"
    data = zipped.archive([
        _model(title, status, method),
        zipped.packed("Metadata/model_settings.config", laid_out.encode(), method),
        zipped.packed("Metadata/slice_info.config", plates.encode(), method),
        *sliced,
        *_added(method),
    ])
    return data[: len(data) // 2] if key % 50 == 0 else data  # a copy that was cut off


def _projects(spark, sf_dir):
    """(order, content) of every order's project.

    Contents are made by a plain UDF, which Spark runs in one go with the UDF
    that reads them, so they never leave a Python worker.
    """
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"))
    held = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), line.alias("line"))
    # Spread before they are grouped: a repartition after the join would be optimized away and the rest coalesced into few long tasks.
    tasks = tasks_for(held)
    lines = held.repartition(tasks, "key").groupBy("key").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("status"))
    orders = orders.repartition(tasks, "key").join(lines, "key")
    content = F.udf(_archive, "binary", useArrow=False)("key", "title", "status", "lines.part", "lines.quantity", "lines.flag")
    return orders.select(F.col("key").alias("order"), content.alias("content"))


_LINES = "l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) AS n, l_partkey AS part, l_quantity AS q, l_returnflag AS flag FROM lineitem), o AS (SELECT o_orderkey AS k, o_orderpriority AS title, o_orderstatus AS s, o_orderkey % 50 = 0 AS cut FROM orders WHERE o_orderkey IN (SELECT k FROM l))"


@query("project_facts", f"""
WITH {_LINES},
m AS (SELECT k, count(*)::INTEGER AS plates, count(*) FILTER (WHERE flag = 'R')::INTEGER AS sliced, sum(CAST(q AS BIGINT) * 60)::BIGINT AS seconds, round(sum(q), 2) AS grams, sum(1 + CAST(floor(q) AS BIGINT) % 3)::BIGINT AS copies,
  count(DISTINCT part || flag) FILTER (WHERE flag IN ('N', 'R'))::INTEGER AS meshes, array_to_string(list_sort(list_distinct(list(part % 10 || '.step'))), ',') AS sources, max('Part & ' || part) AS last FROM l GROUP BY k)
SELECT o.k AS "order", CASE WHEN NOT cut THEN title END AS title, CASE WHEN NOT cut THEN CASE s WHEN 'F' THEN 'bambu' WHEN 'O' THEN 'orca' ELSE 'other' END END AS flavour,
  CASE WHEN NOT cut THEN plates END AS plates, CASE WHEN NOT cut THEN sliced END AS sliced, CASE WHEN NOT cut THEN seconds END AS seconds, CASE WHEN NOT cut THEN grams END AS grams, CASE WHEN NOT cut THEN copies END AS copies, CASE WHEN NOT cut THEN meshes END AS meshes,
  CASE WHEN NOT cut THEN sources END AS sources, CASE WHEN NOT cut THEN last END AS last_object, CASE WHEN NOT cut THEN 'é.png' END AS picture, cut AS broken
FROM o JOIN m ON o.k = m.k""")
def project_facts(spark, sf_dir):
    """What the projects say of themselves; one that was cut off says nothing but that."""
    found = archives.with_projects(_projects(spark, sf_dir), "order")
    return found.select(
        "order", "title", "flavour",
        F.when(F.col("error").isNull(), F.size("plates")).alias("plates"),
        F.when(F.col("error").isNull(), F.size(F.filter("plates", lambda p: p["sliced"]))).alias("sliced"),
        F.aggregate("plates", F.lit(0).cast("bigint"), lambda a, p: a + p["seconds"]).alias("seconds"),
        F.round(F.aggregate("plates", F.lit(0.0), lambda a, p: a + p["filaments"][0]["g"]), 2).alias("grams"),
        F.aggregate("objects", F.lit(0).cast("bigint"), lambda a, x: a + x["copies"]).alias("copies"),
        F.when(F.col("error").isNull(), F.size("mesh_names")).alias("meshes"),
        F.array_join(F.array_sort("source_files"), ",").alias("sources"),
        F.array_max(F.transform("objects", lambda x: x["name"])).alias("last_object"),
        F.array_join(F.transform("auxiliaries", lambda x: x["name"]), ",").alias("picture"),
        F.col("error").isNotNull().alias("broken"),
    )


@query("archive_entries", f"""
WITH {_LINES}
SELECT o.k AS "order", 'Metadata/plate_' || n || '.gcode' AS name, octet_length(encode('G1 X' || part || chr(10)))::BIGINT AS size, sha256('G1 X' || part || chr(10)) AS sha256, false AS broken FROM l JOIN o ON l.k = o.k WHERE flag = 'R' AND NOT cut
UNION ALL SELECT k, NULL, NULL, NULL, true FROM o WHERE cut""")
def archive_entries(spark, sf_dir):
    """The sliced plates inside the projects by their hashes, and the archives that cannot be read."""
    found = archives.with_entries(_projects(spark, sf_dir), "order", wanted=r"\.gcode\Z")
    return found.where("name LIKE '%.gcode' OR name IS NULL").select("order", "name", "size", "sha256", F.col("error").isNotNull().alias("broken"))


# Parts as files: those of a size share a provisional key, some have one that was restored; hashes of all but one brand have arrived, a few for files that changed since.
_FILES = "SELECT p_partkey AS id, p_size AS size, p_partkey % 40 AS mtime_ms, 'f' || p_size AS quick_fp, CASE WHEN p_partkey % 3 = 0 THEN p_type || p_size ELSE 'q:f' || p_size END AS content_key, CAST(NULL AS VARCHAR) AS sha256 FROM part"
_HASHES = "SELECT p_partkey AS id, p_size AS size, CASE WHEN p_partkey % 40 = 1 THEN 0 ELSE p_partkey % 40 END AS mtime_ms, 'f' || p_size AS quick_fp, CASE WHEN p_partkey % 6 = 0 THEN p_type || p_size ELSE 's' || p_name END AS sha256 FROM part WHERE p_brand <> 'Brand#1'"
_CLAIMS = """SELECT 'file' AS subject_type, subject_key, 'same_as' AS relation, 'file' AS object_type, object_key, length(p) % 2 = 0 AS automatic, p AS state
  FROM (SELECT DISTINCT CASE WHEN p_size % 4 = 0 THEN 'q:f' || p_size ELSE p_type || p_size END || CASE WHEN p_size % 5 = 0 THEN '#1' ELSE '' END AS subject_key, 'q:f' || p_size % 10 AS object_key, p_type AS p FROM part)"""


@query("rekeyed_claims", f"""
WITH f AS ({_FILES}), h AS ({_HASHES}), c AS ({_CLAIMS}),
v AS (SELECT f.id, f.content_key AS old, h.sha256 AS new, CASE WHEN f.mtime_ms <> h.mtime_ms THEN 'changed' WHEN f.content_key = h.sha256 THEN 'confirmed' WHEN f.content_key LIKE 'q:%' THEN 'rekeyed' ELSE 'contradicted' END AS verdict FROM f JOIN h USING (id)),
m AS (SELECT DISTINCT old, new, verdict FROM v WHERE verdict IN ('rekeyed', 'contradicted')),
k AS (SELECT DISTINCT content_key AS old FROM f WHERE id NOT IN (SELECT id FROM v WHERE verdict IN ('rekeyed', 'contradicted'))),
e AS (SELECT *, split_part(subject_key, '#', 1) AS s, split_part(object_key, '#', 1) AS o FROM c),
j AS (SELECT e.*, CASE WHEN ms.verdict = 'rekeyed' OR automatic THEN ms.new END AS sn, CASE WHEN mo.verdict = 'rekeyed' OR automatic THEN mo.new END AS so FROM e LEFT JOIN m ms ON ms.old = s LEFT JOIN m mo ON mo.old = o),
g AS (SELECT subject_key, object_key, state, automatic, 0 AS r FROM j WHERE NOT coalesce(sn IS NOT NULL AND s NOT IN (SELECT old FROM k), false) AND NOT coalesce(so IS NOT NULL AND o NOT IN (SELECT old FROM k), false)
  UNION SELECT coalesce(sn || substr(subject_key, length(s) + 1), subject_key), coalesce(so || substr(object_key, length(o) + 1), object_key), state, automatic, 1 FROM j WHERE sn IS NOT NULL OR so IS NOT NULL)
SELECT sha1('file|' || subject_key || '|same_as|file|' || object_key) AS claim_key, subject_key, object_key FROM g GROUP BY subject_key, object_key""")
def rekeyed_claims(spark, sf_dir):
    """Claims after a batch of hashes: moved, copied, or left where they were."""
    table(spark, sf_dir, "part").createOrReplaceTempView("part_of_rekeying")
    sql = lambda text: spark.sql(text.replace("FROM part", "FROM part_of_rekeying").replace("VARCHAR", "STRING"))
    files, hashes, claims = sql(_FILES), sql(_HASHES), sql(_CLAIMS)
    to = rekey.moves(files, rekey.verdicts(files, hashes))
    return rekey.rekeyed_claims(claims, to).select("claim_key", "subject_key", "object_key")
