"""Queries of scans, sync, decisions, fleets and resolution over tables derived from the driver's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import actions, browse, fleet, manifest, resolve
from .catalogue import derived, having
from .registry import query
from .tables import table


@query("scan_finished", """
WITH f AS (SELECT p_partkey AS rel_path, CASE WHEN p_partkey % 3 = 0 THEN 'missing' ELSE 'present' END AS state, CASE WHEN p_size % 2 = 0 THEN 0 ELSE 5000000000 END AS last_seen FROM part)
SELECT rel_path, CASE WHEN rel_path % 4 <> 1 THEN 'present' ELSE 'missing' END AS state FROM f WHERE rel_path % 4 <> 1 OR last_seen >= 6000000000 - 30 * 86400000::BIGINT""")
def scan_finished(spark, sf_dir):
    n = F.col("p_partkey")
    files = table(spark, sf_dir, "part").select(n.alias("rel_path"), F.when(n % 3 == 0, "missing").otherwise("present").alias("state"), F.when(F.col("p_size") % 2 == 0, 0).otherwise(5_000_000_000).alias("last_seen"))
    return manifest.after_scan(files, files.where("rel_path % 4 <> 1"), True, F.lit(6_000_000_000)).select("rel_path", "state")


@query("orphan_blobs", "SELECT DISTINCT p_size AS key FROM part WHERE p_size NOT IN (SELECT p_size FROM part WHERE p_partkey % 20 = 0) AND p_size NOT IN (SELECT s_nationkey FROM supplier)")
def orphan_blobs(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_size").alias("key"), "p_partkey")
    return manifest.orphans(part.select("key").distinct(), "key", part.where("p_partkey % 20 = 0"), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key")))


_REMOTE = "SELECT o_orderkey AS id, o_custkey AS size, CAST(o_orderkey % 100 AS BIGINT) AS modified FROM orders"
_SYNCED = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'synced' END AS status, o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS remoteSize, CAST(o_orderkey % 100 AS BIGINT) AS remoteModified, o_orderkey % 3 = 0 AS local_verified FROM orders WHERE o_orderkey % 4 <> 2"


def _sync(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return [spark.sql(text.replace("FROM orders", "FROM {orders}"), orders=orders) for text in (_REMOTE, _SYNCED)]


@query("files_to_download", f"WITH r AS ({_REMOTE}), s AS ({_SYNCED}) SELECT r.id FROM r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.id = r.id AND status = 'synced' AND remoteSize = size AND remoteModified = modified)")
def files_to_download(spark, sf_dir):
    return manifest.to_download(*_sync(spark, sf_dir), ["id"]).select("id")


@query("files_to_delete", f"WITH r AS ({_REMOTE}), s AS ({_SYNCED}) SELECT r.id FROM r JOIN s USING (id) WHERE status = 'synced' AND local_verified AND modified < 50")
def files_to_delete(spark, sf_dir):
    return manifest.may_delete(*_sync(spark, sf_dir), ["id"], F.lit(50)).select("id")


@query("identical_files", """
SELECT p_partkey, p_partkey % 4 = 0 AS same, list_sort(list_distinct(list_transform(range(0, 5), lambda i: (greatest(p_size - 8, 0) * i) // 4)))::BIGINT[] AS starts FROM part""")
def identical_files(spark, sf_dir):
    n = F.col("p_partkey")
    none = F.lit(None).cast("array<string>")
    there = F.when(n % 4 == 0, F.array(F.lit("a"), F.lit("b"))).when(n % 4 == 1, F.array(F.lit("a"))).when(n % 4 == 2, none).otherwise(F.array(F.lit("a"), F.lit("b")))
    same = manifest.identical(F.col("p_size"), F.when(n % 4 == 3, F.col("p_size") + 1).otherwise(F.col("p_size")), F.array(F.lit("a"), F.lit("b")), there)
    return table(spark, sf_dir, "part").select("p_partkey", same.alias("same"), manifest.evenly_spaced(F.col("p_size"), 8, 5).alias("starts"))


@query("container_states", """
WITH f AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey - p_partkey % 3 END AS container_id, CASE WHEN p_partkey % 5 = 0 THEN 'missing' ELSE 'present' END AS state FROM part)
SELECT f.id, coalesce(c.state, f.state) AS state FROM f LEFT JOIN f c ON c.id = f.container_id""")
def container_states(spark, sf_dir):
    n = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(n.alias("id"), F.when(n % 3 != 0, n - n % 3).alias("container_id"), F.when(n % 5 == 0, "missing").otherwise("present").alias("state"))
    return manifest.with_container_state(rows).select("id", "state")


@query("undoable_actions", """
WITH a AS (SELECT o_orderkey AS id, o_orderkey % 6 = 0 AS undone FROM orders), d AS (SELECT o_orderkey AS action_id, o_custkey AS subject_key FROM orders UNION ALL SELECT o_orderkey, o_custkey + 1 FROM orders WHERE o_orderkey % 2 = 0),
m AS (SELECT subject_key, max(action_id) AS last FROM d JOIN a ON a.id = action_id WHERE NOT undone GROUP BY 1)
SELECT id, NOT undone AND NOT EXISTS (SELECT 1 FROM d JOIN m USING (subject_key) WHERE d.action_id = a.id AND m.last > a.id) AS undoable FROM a""")
def undoable_actions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    own = orders.select(F.col("o_orderkey").alias("action_id"), F.col("o_custkey").alias("subject_key"))
    more = orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_custkey") + 1)
    return actions.undoable(orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 6 == 0).alias("undone")), own.union(more)).select("id", "undoable")


@query("superseded_decisions", """
WITH d AS (SELECT o_orderkey AS id, o_custkey AS subject_key, o_orderkey % 2 AS relation, CASE WHEN o_orderkey % 5 = 0 THEN 1 END AS withdrawn_at FROM orders)
SELECT id, (SELECT min(e.id) FROM d e WHERE e.subject_key = d.subject_key AND e.relation = d.relation AND e.id > d.id AND e.withdrawn_at IS NULL) AS superseded_by FROM d""")
def superseded_decisions(spark, sf_dir):
    n = F.col("o_orderkey")
    log = table(spark, sf_dir, "orders").select(n.alias("id"), F.col("o_custkey").alias("subject_key"), (n % 2).alias("relation"), F.when(n % 5 == 0, 1).alias("withdrawn_at"))
    return actions.superseded(log).select("id", "superseded_by")


@query("linked_prints", f"""
{having("files")}, f AS (SELECT *, CASE WHEN id % 2 = 0 THEN sha256 END AS hash FROM files), p AS (SELECT o_orderkey AS id, concat('s', o_custkey) AS sha256, o_custkey AS place, o_orderkey % 2 AS off, concat('part ', o_custkey % 9) AS name FROM orders),
h AS (SELECT id, ck FROM (SELECT p.id, f.content_key AS ck, row_number() OVER (PARTITION BY p.id ORDER BY f.state <> 'present', f.root_id, f.rel_path) AS r FROM p JOIN f ON f.hash = p.sha256) WHERE r = 1),
s AS (SELECT p.id, min(f.content_key) AS ck FROM p JOIN f ON f.id = p.place WHERE off = 0 GROUP BY p.id),
n AS (SELECT 'part ' || (id % 13) AS name, count(DISTINCT content_key) AS n, min(content_key) AS ck FROM f WHERE id % 13 <> 4 AND id < 15 GROUP BY 1)
SELECT p.id, CASE WHEN h.id IS NOT NULL THEN h.ck WHEN s.id IS NOT NULL THEN s.ck WHEN n.n = 1 THEN n.ck END AS content_key, CASE WHEN h.id IS NOT NULL THEN 'sha256' WHEN s.id IS NOT NULL THEN 'location' WHEN n.n IS NOT NULL THEN 'name' ELSE 'none' END AS method,
  CASE WHEN h.id IS NOT NULL THEN 'exact' WHEN s.id IS NOT NULL THEN 'high' WHEN n.n = 1 THEN 'medium' WHEN n.n > 1 THEN 'low' ELSE 'none' END AS confidence FROM p LEFT JOIN h ON h.id = p.id LEFT JOIN s ON s.id = p.id LEFT JOIN n ON n.name = p.name""")
def linked_prints(spark, sf_dir):
    id_ = F.col("id")
    files = derived(spark, sf_dir, "files").select("content_key", F.when(id_ % 2 == 0, F.col("sha256")).alias("sha256"), "root_id", "rel_path", id_.alias("size"), F.lit(0.0).alias("mtime_ms"), F.concat(F.lit("PART "), (id_ % 13).cast("string")).alias("name"), "state", ((id_ % 13 == 4) | (id_ >= 15)).alias("generic"), id_.alias("place"))
    at = files.select("place", F.col("root_id").alias("r"), F.col("rel_path").alias("p"))
    orders = table(spark, sf_dir, "orders").join(at, F.col("o_custkey") == F.col("place"), "left")
    prints = orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("sha256"), F.col("r").alias("root_id"), F.col("p").alias("rel_path"), F.col("o_custkey").alias("size"), F.when(F.col("o_orderkey") % 2 == 0, 0.4).otherwise(5.0).alias("mtime_ms"), F.concat(F.lit("part "), (F.col("o_custkey") % 9).cast("string")).alias("name"))
    return actions.linked_prints(prints, files.drop("place"))


_LINKS = "SELECT CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey % 100 END AS model_id, CASE o_orderkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence, o_orderkey % 13 = 0 AS by_decision, o_orderkey AS ended_at FROM orders"
_STATS = f"""SELECT model_id, count(*) AS n, count(*) FILTER (WHERE by_decision OR confidence IN ('exact', 'high')) AS confirmed, count(*) FILTER (WHERE NOT by_decision AND confidence = 'medium') AS by_name, max(ended_at) AS last
FROM ({_LINKS}) WHERE model_id IS NOT NULL AND (by_decision OR confidence <> 'low') GROUP BY 1"""


@query("print_stats", _STATS)
def print_stats(spark, sf_dir):
    return actions.print_stats(spark.sql(_LINKS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders")))


@query("print_stats_refreshed", _STATS)
def print_stats_refreshed(spark, sf_dir):
    """Old statistics of half the links, then those of every touched model anew: the same as a full count."""
    links = spark.sql(_LINKS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    late = links.where("ended_at % 2 = 1")
    old = actions.print_stats(links.where("ended_at % 2 = 0"))
    return actions.refreshed_stats(old, links, late.where("model_id IS NOT NULL").select("model_id").distinct())


@query("settings_differences", """
WITH a AS (SELECT p_partkey AS k, p_size::VARCHAR AS v FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey AS k, CASE WHEN p_size % 4 = 0 THEN p_size + 1 ELSE p_size END::VARCHAR AS v FROM part WHERE p_partkey % 5 <> 0)
SELECT 'key' || coalesce(a.k, b.k) AS name, CASE WHEN coalesce(a.k, b.k) % 2 = 0 AND a.v IS NOT NULL THEN '•••' ELSE a.v END AS a, CASE WHEN coalesce(a.k, b.k) % 2 = 0 AND b.v IS NOT NULL THEN '•••' ELSE b.v END AS b FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v AND coalesce(a.k, b.k) <> 7""")
def settings_differences(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("name", F.concat(F.lit("key"), F.col("p_partkey").cast("string")))
    a = part.where("p_partkey % 3 <> 0").select("name", F.col("p_size").cast("string").alias("value"))
    b = part.where("p_partkey % 5 <> 0").select("name", F.when(F.col("p_size") % 4 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).cast("string").alias("value"))
    return actions.settings_diff(a, b, ["key7"], F.col("name").rlike("[02468]$"))


@query("health_issues", """
SELECT event_id AS printer_id, unnest(list_filter([CASE WHEN event_id % 2 = 0 THEN 'throttled' END, CASE WHEN value >= 90 THEN 'disk' END, CASE WHEN event_type = 'error' THEN 'fault' END, CASE WHEN user_id % 3 = 0 THEN 'fan' END], lambda x: x IS NOT NULL)) AS issue FROM events""")
def health_issues(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("printer_id"), (F.col("event_id") % 2 == 0).alias("throttled"), F.col("value").alias("disk_percent"), F.when(F.col("event_type") == "error", "x").alias("fault"), (F.col("user_id") % 3 == 0).alias("fan_flagged"))
    return actions.health(rows)


@query("tray_lists", "SELECT k, array_to_string(list_transform(range(1, n + 1), lambda i: coalesce(list_filter(m, lambda x: x.s = i)[1].t, '-')), ',') AS trays FROM (SELECT p_partkey // 6 AS k, max(p_partkey % 6) AS n, list({s: p_partkey % 6, t: p_type}) AS m FROM part WHERE p_partkey % 6 > 0 AND p_size % 3 <> 0 GROUP BY 1)")
def tray_lists(spark, sf_dir):
    slots = table(spark, sf_dir, "part").where("p_size % 3 <> 0").select(F.floor(F.col("p_partkey") / 6).alias("k"), (F.col("p_partkey") % 6).cast("int").alias("slot"), F.col("p_type").alias("material"))
    return actions.tray_list(slots, "k").select("k", F.array_join("trays", ",", "-").alias("trays"))


@query("material_boxes", """
SELECT p_partkey, i - CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS slot, CASE i WHEN 1 THEN p_type ELSE p_brand END AS material, CASE i WHEN 1 THEN '#AB00' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') ELSE '#FFEE00' END AS hex
FROM part, (SELECT unnest([0, 1, 2]) AS i) x WHERE i = 1 AND p_partkey % 2 = 0 OR i = 2 AND p_partkey % 2 = 0 OR p_partkey % 2 = 1 AND i = 0""".replace("CASE i WHEN 1 THEN p_type ELSE p_brand END", "CASE i WHEN 1 THEN p_type WHEN 2 THEN p_brand ELSE 'spare' END").replace("WHEN 1 THEN '#AB00' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') ELSE '#FFEE00' END", "WHEN 1 THEN '#AB00' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') WHEN 2 THEN '#FFEE00' ELSE '#123456' END"))
def material_boxes(spark, sf_dir):
    """Boxes with a serial hide the place-holder beside them; alone it counts."""
    m = lambda t, c: F.struct(t.alias("type"), c.alias("color"))
    digits = F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0")
    own = F.struct(F.lit("x1").alias("serial"), F.array(m(F.col("p_type"), F.concat(F.lit("0#ab00"), digits)), m(F.col("p_brand"), F.lit("ffee00"))).alias("materials"))
    spare = F.struct(F.lit("").alias("serial"), F.array(m(F.lit("spare"), F.lit("#123456"))).alias("materials"))
    boxes = F.when(F.col("p_partkey") % 2 == 0, F.array(spare, own)).otherwise(F.array(spare))
    return actions.decoded_boxes(table(spark, sf_dir, "part").select("p_partkey", boxes.alias("boxes")), "p_partkey")


@query("fleet_snapshot", """
WITH l AS (SELECT user_id, max_by(event_type, event_id) AS state, max_by(value, event_id) AS progress FROM events GROUP BY 1)
SELECT c_custkey AS printer_id, c_name AS name, l.state, l.progress, coalesce(o.n, 0) AS waiting FROM customer JOIN l ON l.user_id = c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey""")
def fleet_snapshot(spark, sf_dir):
    printers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("printer_id"), F.col("c_name").alias("name"))
    status = table(spark, sf_dir, "events").select(F.col("user_id").alias("printer_id"), F.col("event_type").alias("state"), F.col("value").alias("progress"), F.col("event_id").alias("ts"))
    queues = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("printer_id")).agg(F.count("*").alias("waiting"))
    return fleet.snapshot(printers, status, queues)


@query("model_covers", """
SELECT p_size AS model_id, picture FROM (SELECT p_size, p_name || p_partkey AS picture, row_number() OVER (PARTITION BY p_size ORDER BY CASE p_type WHEN 'SMALL' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'ECONOMY' THEN 2 ELSE 3 END, p_name || p_partkey) AS r FROM part) WHERE r = 1""")
def model_covers(spark, sf_dir):
    kind = F.when(F.col("p_type") == "SMALL", "chosen").when(F.col("p_type") == "LARGE", "project").when(F.col("p_type") == "ECONOMY", "plate").otherwise("image")
    return fleet.covers(table(spark, sf_dir, "part").select(F.col("p_size").alias("model_id"), kind.alias("kind"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("picture")))


@query("best_claims", """
SELECT subject_key, claim_key FROM (SELECT p_size AS subject_key, p_partkey AS claim_key, row_number() OVER (PARTITION BY p_size ORDER BY CASE p_partkey % 5 WHEN 0 THEN 4 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 3 END, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 4 END, p_partkey) AS r FROM part) WHERE r = 1""")
def best_claims(spark, sf_dir):
    n = F.col("p_partkey")
    state = F.get(F.array(*[F.lit(x) for x in ("odd", "confirmed", "applied", "suggested", "recorded")]), (n % 5).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("subject_key"), n.alias("claim_key"), state.alias("state"), F.when(n % 3 == 0, "exact").when(n % 3 == 1, "medium").alias("confidence"))
    return browse.best_claim(rows).select("subject_key", "claim_key")


@query("model_suggestions", """
WITH e AS (SELECT p_partkey AS a, p_partkey + 1 + p_size % 3 AS b FROM part WHERE p_size % 2 = 0 AND p_partkey + 3 < (SELECT count(*) FROM part)), m AS (SELECT p_partkey AS key, p_partkey // 2 AS model FROM part),
r AS (SELECT a, b, x.model AS ma, y.model AS mb FROM e JOIN m x ON x.key = a JOIN m y ON y.key = b WHERE x.model <> y.model AND NOT (x.model % 9 = 0 AND y.model = x.model + 1)),
s AS (SELECT a AS key, mb AS model FROM r UNION SELECT b, ma FROM r)
SELECT key, min(model) AS model FROM s GROUP BY key HAVING count(*) = 1""")
def model_suggestions(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    n, total = F.col("p_partkey"), part.count()
    pairs = part.where((F.col("p_size") % 2 == 0) & (n + 3 < total)).select(n.alias("a"), (n + 1 + F.col("p_size") % 3).alias("b"), F.lit("suggest").alias("cls"))
    model = F.floor(n / 2)
    apart = part.where(model % 9 == 0).select(model.alias("a"), (model + 1).alias("b")).distinct()
    return resolve.suggestions(pairs, part.select(n.alias("key"), model.alias("model")), apart)


@query("review_items_after_run", """
WITH c AS (SELECT p_partkey AS k, p_partkey % 7 <> 0 AS managed, CASE p_partkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'dismissed' WHEN 2 THEN 'resolved' ELSE 'auto_closed' END AS status FROM part WHERE p_partkey % 5 <> 0), n AS (SELECT p_partkey AS k FROM part WHERE p_size % 2 = 0)
SELECT coalesce(c.k, n.k) AS subject_key, CASE WHEN c.status IN ('dismissed', 'resolved') THEN c.status WHEN n.k IS NOT NULL THEN 'open' WHEN c.status = 'open' AND managed THEN 'auto_closed' ELSE c.status END AS status FROM c FULL JOIN n ON n.k = c.k""")
def review_items_after_run(spark, sf_dir):
    n = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select(n.alias("subject_key"), F.when(n % 7 != 0, "empty_model").otherwise("unlinked_print").alias("kind"), F.when(n % 4 == 0, "open").when(n % 4 == 1, "dismissed").when(n % 4 == 2, "resolved").otherwise("auto_closed").alias("status"), "p_size")
    return resolve.reviews_after(part.where("subject_key % 5 <> 0").drop("p_size"), part.where("p_size % 2 = 0").select("subject_key", "kind")).select("subject_key", "status")


@query("recovered_identities", """
WITH c AS (SELECT p_size AS fp, p_partkey % 2 AS size, CASE WHEN p_size % 4 = 0 THEN 'h' || p_partkey ELSE 'h' || p_size END AS h FROM part WHERE p_size % 5 <> 0),
o AS (SELECT fp, size, min(h) AS h FROM c GROUP BY 1, 2 HAVING count(DISTINCT h) = 1) SELECT p_partkey AS id, o.h AS sha256 FROM part LEFT JOIN o ON o.fp = p_size AND o.size = p_partkey % 2""")
def recovered_identities(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("quick_fp"), (F.col("p_partkey") % 2).alias("size"))
    hash_ = F.concat(F.lit("h"), F.when(F.col("quick_fp") % 4 == 0, F.col("id").cast("string")).otherwise(F.col("quick_fp").cast("string")))
    return resolve.recovered(part.where("quick_fp % 5 <> 0").withColumn("sha256", hash_).drop("id"), part).select("id", "sha256")


@query("pair_policy_with_folders", """
WITH n AS (SELECT p_partkey::VARCHAR AS key, p_partkey AS id, p_name AS title, p_size AS folder, p_brand AS maker FROM part),
b AS (SELECT key, 'title' AS kind, title AS v FROM n UNION ALL SELECT key, 'model_folder', 'r:' || folder FROM n), s AS (SELECT kind, v FROM b GROUP BY 1, 2 HAVING count(DISTINCT key) BETWEEN 2 AND 50),
l AS (SELECT DISTINCT least(x.key, y.key) AS a, greatest(x.key, y.key) AS b, CASE WHEN x.id % 20 = 0 THEN 'plate_md5' WHEN x.id % 20 = 10 THEN 'source_file' END AS signal FROM n x JOIN n y ON y.id = x.id + 1 WHERE x.id % 5 = 0),
p AS (SELECT x.key AS a, y.key AS b FROM b x JOIN s USING (kind, v) JOIN b y ON y.kind = x.kind AND y.v = x.v AND x.key < y.key UNION SELECT a, b FROM l),
e AS (SELECT p.a, p.b, x.title = y.title AS t, x.folder = y.folder AND x.folder % 3 <> 0 AS f, x.maker = y.maker AS m, (SELECT min(signal) FROM l WHERE l.a = p.a AND l.b = p.b) AS signal FROM p JOIN n x ON x.key = p.a JOIN n y ON y.key = p.b)
SELECT a, b, CASE WHEN signal IS NOT NULL OR t AND f THEN 'auto' WHEN t OR f THEN 'suggest' WHEN m THEN 'record' ELSE 'none' END AS cls, CASE WHEN signal = 'plate_md5' THEN 'exact' WHEN signal IS NOT NULL OR t AND f THEN 'high' WHEN t OR f THEN 'medium' WHEN m THEN 'low' END AS confidence FROM e""")
def pair_policy_with_folders(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    empty = F.array().cast("array<string>")
    id_, folder = F.col("p_partkey"), F.concat(F.lit("r:"), F.col("p_size").cast("string"))
    nodes = part.select(
        id_.cast("string").alias("key"), F.col("p_name").alias("title"), F.array("p_name").alias("titles"), F.lit(2).alias("token_count"), F.lit(0.0).alias("generic_score"),
        empty.alias("objects"), empty.alias("designs"), F.array(folder).alias("model_folders"), F.array(F.lower("p_brand")).alias("designer_folders"),
    )
    signal = F.when(id_ % 20 == 0, "plate_md5").when(id_ % 20 == 10, "source_file")
    a, b = id_.cast("string"), (id_ + 1).cast("string")
    lineage = part.where("p_partkey % 5 = 0").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), signal.alias("signal"))
    status = part.select(folder.alias("folder"), F.when(F.col("p_size") % 3 == 0, "nested").otherwise("model_folder").alias("status")).distinct()
    pairs = resolve.with_lineage(resolve.blocked_pairs(resolve.blocks_of(nodes)), lineage, nodes)
    return resolve.policy(resolve.evidence(pairs, nodes, lineage, status)).select("a", "b", "cls", "confidence")


_TITLE = """CASE p_type WHEN 'ECONOMY' THEN p_name WHEN 'SMALL' THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) WHEN 'MEDIUM' THEN replace(p_name, ' ', '')
  WHEN 'LARGE' THEN p_name || ' no ' || p_size WHEN 'PROMO' THEN 'a b ' || p_size ELSE replace(p_name, ' ', '-') || ' set' END"""


@query("common_object_names", f"""
WITH RECURSIVE t AS (SELECT DISTINCT p_brand || ' ' || p_size // 10 AS name, {_TITLE} AS title FROM part),
c AS (SELECT *, regexp_replace(title, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS k, array_to_string(list_sort(string_split(title, ' ')), ' ') AS bag FROM t),
e AS (SELECT x.name, x.title AS a, y.title AS b FROM c x JOIN c y ON x.name = y.name AND (x.bag = y.bag OR length(y.title) >= 4 AND contains(' ' || x.title || ' ', ' ' || y.title || ' ') OR length(x.k) >= 4 AND length(y.k) >= 4 AND contains(x.k, y.k))),
s AS (SELECT name, a, b FROM e UNION SELECT name, b, a FROM e),
r AS (SELECT name, a, b FROM s UNION SELECT r.name, r.a, s.b FROM r JOIN s ON r.name = s.name AND r.b = s.a),
m AS (SELECT DISTINCT name, min(b) AS title FROM r GROUP BY name, a)
SELECT name, count(*)::INTEGER AS groups, array_to_string(list_slice(list_sort(list(title)), 1, 8), '|') AS titles FROM m GROUP BY name HAVING count(*) >= 3""".replace("\\\\", "\\"))
def common_object_names(spark, sf_dir):
    title = F.expr(_TITLE.replace("p_name || ' no ' || p_size", "concat(p_name, ' no ', p_size)").replace("'a b ' || p_size", "concat('a b ', p_size)"))
    name = F.concat_ws(" ", "p_brand", F.expr("p_size div 10").cast("string"))
    found = resolve.common_objects(table(spark, sf_dir, "part").select(name.alias("name"), title.alias("title")))
    return found.select("name", "groups", F.array_join("titles", "|").alias("titles"))
