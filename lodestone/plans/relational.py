"""Event-log, browsing, join, aggregate and set queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codes, text
from ..operators import browse, eventlog, manifest, temporal, reviews
from ..sources import storage
from .registry import query
from .tables import table

_LOG = "SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type, value FROM events"


def _log(events: DataFrame) -> DataFrame:
    return events.select("event_id", temporal.micros("ts").alias("ts_us"), "user_id", "event_type", "value")


@query("event_log_page", f"{_LOG} WHERE event_type IN ('purchase') AND user_id >= 10 AND ts >= TIMESTAMP '2024-01-02' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")
def event_log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("user_id >= 10")
    found = eventlog.matching(events, {"event_type": "purchase", "user_id": None}, since=F.lit("2024-01-02").cast("timestamp_ntz"))
    return _log(eventlog.newest_page(found, 50, 100))


@query("event_log_total", "SELECT count(*) AS total FROM events WHERE event_type = 'error' AND ts <= TIMESTAMP '2024-01-20'")
def event_log_total(spark, sf_dir):
    found = eventlog.matching(table(spark, sf_dir, "events"), {"event_type": "error"}, until=F.lit("2024-01-20").cast("timestamp_ntz"))
    return found.agg(F.count("*").alias("total"))


@query("event_log_text", "SELECT event_id, event_type, props FROM events WHERE event_type ILIKE '%UR%' OR props ILIKE '%: 7}%'")
def event_log_text(spark, sf_dir):
    first = eventlog.matching(table(spark, sf_dir, "events"), text="UR", text_columns=("event_type",))
    second = eventlog.matching(table(spark, sf_dir, "events"), text=": 7}", text_columns=("props",))
    return first.union(second).select("event_id", "event_type", "props").distinct()


@query("event_retention", "SELECT count(*) AS kept FROM events WHERE ts >= TIMESTAMP '2024-01-25' - INTERVAL 10 DAY")
def event_retention(spark, sf_dir):
    return eventlog.retained(table(spark, sf_dir, "events"), F.lit("2024-01-25").cast("timestamp_ntz"), 10).agg(F.count("*").alias("kept"))


@query("props_json_histogram", "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1")
def props_json_histogram(spark, sf_dir):
    return eventlog.histogram(table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")), "k")


@query("keyset_page_orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice, o_orderkey) > (150000.0, 10) ORDER BY o_totalprice, o_orderkey LIMIT 61")
def keyset_page_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return browse.keyset_page(orders, "o_totalprice", "o_orderkey", 60, browse.from_cursor(browse.cursor(150000.0, 10)))


@query("page_then_decorate", """
WITH page AS (SELECT c_custkey, c_name FROM customer ORDER BY lower(c_name), c_custkey LIMIT 40)
SELECT page.c_custkey, c_name, count(o_orderkey) AS orders, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 0)::BIGINT AS done
FROM page LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def page_then_decorate(spark, sf_dir):
    page = table(spark, sf_dir, "customer").select("c_custkey", "c_name").orderBy(F.lower("c_name"), "c_custkey").limit(40)
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return page.join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("done", F.lit(0)).alias("done"))


@query("top_orders_per_customer", """
SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3""")
def top_orders_per_customer(spark, sf_dir):
    return browse.top_within(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("first_by_state_then_place", """
SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderstatus <> 'F', CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey) AS r FROM orders) WHERE r = 1""")
def first_by_state_then_place(spark, sf_dir):
    order = [F.col("o_orderstatus") != "F", browse.ranked(F.col("o_orderpriority"), "1-URGENT", "2-HIGH"), F.col("o_orderkey")]
    return browse.first_by(table(spark, sf_dir, "orders"), ["o_custkey"], order).select("o_custkey", "o_orderkey")


@query("facet_brand_type", "SELECT p_brand, count(DISTINCT p_type) AS n FROM part GROUP BY p_brand")
def facet_brand_type(spark, sf_dir):
    return browse.facet(table(spark, sf_dir, "part"), "p_brand", "p_type")


@query("facet_conditional_counts", """
SELECT l_shipyear, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_linestatus = 'O') AS open, count(*) AS n
FROM (SELECT *, CAST(year(l_shipdate) AS INTEGER) AS l_shipyear FROM lineitem) GROUP BY 1""")
def facet_conditional_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("l_shipyear", F.year("l_shipdate"))
    return rows.groupBy("l_shipyear").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "O").alias("open"), F.count("*").alias("n"))


@query("group_concat_types", "SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY p_brand")
def group_concat_types(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


@query("ambiguous_keys_having", "SELECT md5(text) AS print, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def ambiguous_keys_having(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("print")).agg(F.count("*").alias("n")).where("n > 1")


@query("min_place_per_key", "SELECT md5(text) AS k, min(source || ':' || CAST(doc_id AS VARCHAR)) AS place, min(doc_id) AS least FROM documents GROUP BY 1")
def min_place_per_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("k")).agg(F.min(F.concat("source", F.lit(":"), F.col("doc_id").cast("string"))).alias("place"), F.min("doc_id").alias("least"))


@query("visible_customers_semi", """
SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE'))
AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')""")
def visible_customers_semi(spark, sf_dir):
    regions = table(spark, sf_dir, "region").where(F.col("r_name").isin("ASIA", "EUROPE"))
    nations = table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    open_ = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    rows = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return rows.join(open_, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("shared_group_visibility", """
SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_nationkey % 5 = 0""")
def shared_group_visibility(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("allowed_groups", F.when(F.col("c_nationkey") % 5 != 0, F.array("c_mktsegment")))
    return eventlog.visible(rows, ["BUILDING", "MACHINERY", "default"]).select("c_custkey")


@query("capability_resolution", """
SELECT user_id, event_type AS capability, coalesce(bool_and(value > 50) FILTER (WHERE lvl = 0), bool_and(value > 5) FILTER (WHERE lvl = 1), bool_and(value > 20) FILTER (WHERE lvl = 2), false) AS allowed
FROM (SELECT *, CAST(event_id % 3 AS INTEGER) AS lvl FROM events) GROUP BY 1, 2""")
def capability_resolution(spark, sf_dir):
    level = F.element_at(F.array(F.lit("user"), F.lit("group"), F.lit("role")), (F.col("event_id") % 3 + 1).cast("int"))
    bound = F.element_at(F.array(F.lit(50), F.lit(5), F.lit(20)), (F.col("event_id") % 3 + 1).cast("int"))
    return eventlog.capability(table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("capability"), level.alias("level"), (F.col("value") > bound).alias("allowed")))


@query("customers_without_orders_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def customers_without_orders_anti(spark, sf_dir):
    return manifest.orphans(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey"))


@query("orphan_computed_key_anti", """
SELECT page_id FROM pages WHERE NOT EXISTS (SELECT 1 FROM documents WHERE 'doc' || CAST(doc_id AS VARCHAR) = split_part('doc' || CAST(page_id * 7 AS VARCHAR) || '#x', '#', 1))""")
def orphan_computed_key_anti(spark, sf_dir):
    claims = table(spark, sf_dir, "pages").select("page_id", F.split_part(F.concat(F.lit("doc"), (F.col("page_id") * 7).cast("string"), F.lit("#x")), F.lit("#"), F.lit(1)).alias("k"))
    return manifest.orphans(claims, "k", table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("k"))).select("page_id")


@query("manifest_diff_full_outer", """
WITH a AS (SELECT doc_id, n_chars, lang FROM documents WHERE doc_id % 10 <> 3), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars, lang FROM documents WHERE doc_id % 10 <> 4)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'new' WHEN a.doc_id IS NULL THEN 'vanished' WHEN a.n_chars = b.n_chars AND a.lang IS NOT DISTINCT FROM b.lang THEN 'unchanged' ELSE 'changed' END AS change
FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id""")
def manifest_diff_full_outer(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    known = docs.where("doc_id % 10 <> 4").withColumn("n_chars", F.expr("CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END"))
    return manifest.changes(docs.where("doc_id % 10 <> 3"), known, "doc_id", ["n_chars", "lang"])


@query("one_to_one_moves", """
WITH v AS (SELECT md5(text) AS fp, doc_id FROM documents WHERE doc_id % 2 = 0), w AS (SELECT md5(text) AS fp, doc_id FROM documents WHERE doc_id % 2 = 1),
v1 AS (SELECT fp, min(doc_id) AS d FROM v GROUP BY fp HAVING count(*) = 1), w1 AS (SELECT fp, min(doc_id) AS d FROM w GROUP BY fp HAVING count(*) = 1)
SELECT v1.d AS old_place, w1.d AS new_place FROM v1 JOIN w1 ON v1.fp = w1.fp""")
def one_to_one_moves(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.md5("text").alias("fp"), "doc_id")
    return manifest.moves(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "fp", "doc_id").select("old_place", "new_place")


@query("left_join_on_predicate", """
SELECT o_orderkey, count(l_linenumber) AS first_lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 GROUP BY o_orderkey""")
def left_join_on_predicate(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return orders.join(lines, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_linenumber") == 1), "left").groupBy("o_orderkey").agg(F.count("l_linenumber").alias("first_lines"))


@query("three_way_inner", """
SELECT p_brand, s_nationkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def three_way_inner(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("p_brand", "s_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("array_unnest_embeddings", "SELECT label, pos, count(*) AS n FROM (SELECT label, unnest(range(0, len(embedding)))::INTEGER AS pos, unnest(embedding) AS x FROM embeddings) WHERE x > 0.1 GROUP BY 1, 2")
def array_unnest_embeddings(spark, sf_dir):
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return each.where(F.col("x") > 0.1).groupBy("label", "pos").agg(F.count("*").alias("n"))


@query("scalar_subquery_totals", """
SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS latest FROM customer""")
def scalar_subquery_totals(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("o_orderkey").alias("latest"))
    return table(spark, sf_dir, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), "latest")


@query("first_wins_upsert", """
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""")
def first_wins_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    cut = F.lit("2024-01-03").cast("timestamp_ntz")
    old = storage.first_wins(rows.limit(0), rows.where(F.col("ts") < cut), ["user_id"], [F.col("ts"), F.col("event_id")])
    return storage.first_wins(old, rows.where(F.col("ts") >= cut), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


@query("last_wins_upsert", """
SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def last_wins_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "ts")
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    old = storage.last_wins(rows.limit(0), rows.where(F.col("ts") < cut), ["user_id"], [F.col("ts"), F.col("event_id")])
    return storage.last_wins(old, rows.where(F.col("ts") >= cut), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "value")


@query("blob_store", "SELECT DISTINCT 'e' || substr(sha1(text), 1, 31) AS key FROM documents")
def blob_store(spark, sf_dir):
    return storage.blobs(table(spark, sf_dir, "documents").select("text"), "text").select("key")


@query("stable_export", """SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}' AS line FROM nation""")
def stable_export(spark, sf_dir):
    return storage.stable_export(table(spark, sf_dir, "nation").withColumn("ran_at", F.current_timestamp()), ["ran_at", "n_regionkey"], ["n_nationkey"])


@query("label_overrides_auto", """
SELECT d.doc_id, coalesce(l.quality, CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END)::INTEGER AS quality, l.doc_id IS NOT NULL AS by_decision FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def label_overrides_auto(spark, sf_dir):
    auto = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("quality"))
    out = browse.overridden(auto, table(spark, sf_dir, "labels"), "doc_id", "quality")
    return out.select("doc_id", F.col("quality").cast("int").alias("quality"), "by_decision")


@query("standing_decision", """
SELECT user_id AS subject_key, event_id AS id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_id % 4 <> 0 AND event_type <> 'error') WHERE r = 1""")
def standing_decision(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("subject_key"), F.when(F.col("event_id") % 4 == 0, 1).alias("superseded_by"), F.when(F.col("event_type") == "error", 1).alias("withdrawn_at"))
    return browse.standing(rows).select("subject_key", "id")


_KINDS = ("decision_unmatched", "file_changed", "unreadable_file", "suggested_match", "unknown_printer", "missing_file", "source_offline", "source_may_match", "ambiguous_grouping", "unlinked_print", "folder_disagrees", "possible_duplicate", "empty_model")
_ITEMS = f"""SELECT event_id, list_extract({list(_KINDS)}, event_id % 13 + 1) AS kind,
  CASE event_id // 13 % 3 WHEN 0 THEN 'ambiguous:generic:' || event_id WHEN 1 THEN 'ambiguous:nested:' || event_id ELSE 'ambiguous:file:' || event_id END AS subject_key,
  CASE WHEN event_id // 13 % 2 = 0 THEN 'none' ELSE 'low' END AS confidence, user_id AS model FROM events"""
_LEVELS = f"""
SELECT i.*, CASE WHEN l.level IS NOT NULL THEN l.level
  WHEN kind = 'ambiguous_grouping' THEN CASE WHEN split_part(subject_key, ':', 2) IN ('generic', 'nested') THEN 'info' ELSE 'review' END
  WHEN kind = 'unlinked_print' THEN CASE WHEN confidence = 'none' THEN 'info' ELSE 'review' END ELSE 'info' END AS level
FROM ({_ITEMS}) i LEFT JOIN (VALUES ('decision_unmatched', 'action'), ('file_changed', 'action'), ('unreadable_file', 'action'), ('suggested_match', 'review'), ('unknown_printer', 'review'),
  ('missing_file', 'review'), ('source_offline', 'review'), ('source_may_match', 'review')) l(kind, level) USING (kind)"""


def _items(spark, sf_dir):
    id_ = F.col("event_id")
    group = F.floor(id_ / 13)
    key = F.concat(F.when(group % 3 == 0, "ambiguous:generic:").when(group % 3 == 1, "ambiguous:nested:").otherwise("ambiguous:file:"), id_.cast("string"))
    kind = F.get(F.array(*[F.lit(k) for k in _KINDS]), (id_ % 13).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), key.alias("subject_key"), F.when(group % 2 == 0, "none").otherwise("low").alias("confidence"), F.col("user_id").alias("model"))
    return rows.withColumn("level", browse.attention_level(F.col("kind"), F.col("subject_key"), F.col("confidence")))


@query("attention_counts", f"SELECT level, kind, count(*) AS n FROM ({_LEVELS}) GROUP BY 1, 2")
def attention_counts(spark, sf_dir):
    return _items(spark, sf_dir).groupBy("level", "kind").agg(F.count("*").alias("n"))


@query("worst_level_per_model", f"""
SELECT model, CASE min(CASE level WHEN 'action' THEN 0 WHEN 'review' THEN 1 ELSE 2 END) WHEN 0 THEN 'action' WHEN 1 THEN 'review' ELSE 'info' END AS level FROM ({_LEVELS}) WHERE kind <> 'file_changed' OR event_id % 5 = 0 GROUP BY 1""")
def worst_level_per_model(spark, sf_dir):
    return reviews.worst_levels(_items(spark, sf_dir).where((F.col("kind") != "file_changed") | (F.col("event_id") % 5 == 0)), "model")


@query("recursive_merge_chain", """
WITH RECURSIVE m AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 6 = 0 THEN NULL WHEN n_nationkey = 23 THEN 99 ELSE n_nationkey - 1 END AS merged_into FROM nation),
c AS (SELECT id, id AS at, 0 AS hop FROM m UNION ALL SELECT c.id, m.merged_into, hop + 1 FROM c JOIN m ON c.at = m.id WHERE m.merged_into IS NOT NULL AND hop < 10)
SELECT m0.id, coalesce((SELECT c.at FROM c JOIN m ON c.at = m.id WHERE c.id = m0.id AND m.merged_into IS NULL), -1)::INTEGER AS target FROM m m0""")
def recursive_merge_chain(spark, sf_dir):
    into = F.when(F.col("n_nationkey") % 6 == 0, None).when(F.col("n_nationkey") == 23, 99).otherwise(F.col("n_nationkey") - 1)
    return manifest.follow_merges(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), into.alias("merged_into"))).select("id", F.coalesce("target", F.lit(-1)).alias("target"))


@query("folder_ancestry_join", """
SELECT page_id, CAST(i AS INTEGER) AS depth, array_to_string(parts[1:i], '/') AS folder
FROM (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS parts FROM pages) p, LATERAL (SELECT unnest(range(1, len(parts))) AS i) x""")
def folder_ancestry_join(spark, sf_dir):
    paths = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("rel_path"))
    classes = paths.select(F.explode(manifest.prefixes(F.col("rel_path"))).alias("rel_path")).distinct().withColumn("class", F.lit("designer"))
    return manifest.in_folders(paths, classes).select("page_id", F.size(F.split("folder", "/")).alias("depth"), "folder")


@query("alias_canonicalisation", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5(text) ELSE 'q:' || doc_id END AS content_key FROM documents""")
def alias_canonicalisation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    quick = F.concat(F.lit("q:"), F.col("doc_id").cast("string"))
    known = docs.where("doc_id % 3 = 0").select(quick.alias("alias"), F.md5("text").alias("content_key"))
    return manifest.canonical(docs.select("doc_id", quick.alias("content_key")), known).select("doc_id", "content_key")


@query("disjunctive_match_first", """
WITH hit AS (SELECT b.item_id, d.doc_id, 0 AS p FROM benchmark b JOIN documents d ON md5(b.text) = md5(d.text) UNION ALL SELECT b.item_id, d.doc_id, 1 FROM benchmark b JOIN documents d ON b.item_id = d.doc_id)
SELECT item_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY p, doc_id) AS r FROM hit) WHERE r = 1""")
def disjunctive_match_first(spark, sf_dir):
    items, docs = table(spark, sf_dir, "benchmark").select("item_id", F.md5("text").alias("h")), table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("dh"))
    hits = items.join(docs, F.col("h") == F.col("dh")).select("item_id", "doc_id", F.lit(0).alias("p")).union(items.join(docs, F.col("item_id") == F.col("doc_id")).select("item_id", "doc_id", F.lit(1)))
    return browse.first_by(hits, ["item_id"], [F.col("p"), F.col("doc_id")]).select("item_id", "doc_id")


@query("equal_place_band_join", """
SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) < 600000000""")
def equal_place_band_join(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", temporal.micros("ts").alias("us"))
    right = rows.withColumn("bucket", F.floor(F.col("us") / 600000000))
    left = right.select("user_id", "event_type", F.col("event_id").alias("a"), F.col("us").alias("a_us"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    hits = left.join(right, ["user_id", "event_type", "bucket"]).where("a < event_id AND abs(a_us - us) < 600000000")
    return hits.select("a", F.col("event_id").alias("b"))


@query("set_union_intersect_except", """
SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 5000 UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'except', count(*) FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 5000 EXCEPT SELECT s_nationkey FROM supplier)""")
def set_union_intersect_except(spark, sf_dir):
    a = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    count = lambda name, rows: rows.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
    return count("union", a.union(b).distinct()).union(count("intersect", a.intersect(b))).union(count("except", a.exceptAll(b).distinct().join(b, "k", "left_anti")))


@query("object_set_intersections", """
WITH w AS (SELECT p_partkey, list_sort(list_distinct(string_split(lower(p_name), ' '))) AS s FROM part)
SELECT a.p_partkey, len(list_intersect(a.s, b.s))::INTEGER AS shared, a.s = b.s AS same FROM w a JOIN w b ON b.p_partkey = a.p_partkey + 1""")
def object_set_intersections(spark, sf_dir):
    sets = table(spark, sf_dir, "part").select("p_partkey", F.array_sort(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("s"))
    after = sets.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("s").alias("t"))
    return sets.join(after, "p_partkey").select("p_partkey", F.size(F.array_intersect("s", "t")).alias("shared"), (F.col("s") == F.col("t")).alias("same"))


@query("most_common_type_per_brand", """
SELECT p_brand, p_type, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2)) WHERE r = 1""")
def most_common_type_per_brand(spark, sf_dir):
    return browse.most_common(table(spark, sf_dir, "part"), "p_brand", "p_type")


@query("command_histogram_top", """
SELECT w, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '' GROUP BY 1 ORDER BY n DESC, w LIMIT 25""")
def command_histogram_top(spark, sf_dir):
    return eventlog.histogram(table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("w")).where("w <> ''"), "w").orderBy(F.desc("n"), "w").limit(25)


@query("storage_sums", "SELECT c_mktsegment, round(sum(c_acctbal), 2) AS used, round(greatest(0, 1000000 - sum(c_acctbal)), 2) AS other FROM customer GROUP BY 1")
def storage_sums(spark, sf_dir):
    used = F.sum("c_acctbal")
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.round(used, 2).alias("used"), F.round(F.greatest(F.lit(0.0), 1000000 - used), 2).alias("other"))


@query("percentile_floor_index", """
SELECT l_returnflag, n, s[least(floor(0.5 * n)::BIGINT, n - 1) + 1] AS p50, s[least(floor(0.9 * n)::BIGINT, n - 1) + 1] AS p90, s[n] AS most
FROM (SELECT l_returnflag, count(*) AS n, list_sort(list(l_extendedprice)) AS s FROM lineitem GROUP BY 1)""")
def percentile_floor_index(spark, sf_dir):
    return browse.floor_percentiles(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", {"p50": 0.5, "p90": 0.9})


@query("job_cost_estimate", """
SELECT l_orderkey, l_linenumber, nullif(floor((l_extendedprice * 0.002982 / 1000 * 25.0 + l_quantity * 60 / 3600 * 1.5) * 100.0 + 0.5) / 100.0, 0.0) AS cost FROM lineitem""")
def job_cost_estimate(spark, sf_dir):
    cost = codes.job_cost(F.col("l_extendedprice"), F.col("l_quantity") * 60, 25.0, 1.5)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cost.alias("cost"))


@query("nearest_vector", """
SELECT a.vec_id, arg_min(c.label, (c.d, c.label)) AS label FROM embeddings a, LATERAL (
  SELECT b.label, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(round((p[1]::DOUBLE - p[2]::DOUBLE) * 1000) AS BIGINT) * CAST(round((p[1]::DOUBLE - p[2]::DOUBLE) * 1000) AS BIGINT)))::BIGINT AS d
  FROM (SELECT label, embedding FROM embeddings e WHERE vec_id = (SELECT min(vec_id) FROM embeddings f WHERE f.label = e.label)) b) c GROUP BY a.vec_id""")
def nearest_vector(spark, sf_dir):
    """The palette is one vector a label: as many as there are labels, which are few; integer distances, first label wins ties."""
    rows = table(spark, sf_dir, "embeddings")
    palette = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e")).agg(F.array_sort(F.collect_list(F.struct("label", "e"))).alias("palette"))
    step = lambda x, y: F.round((x.cast("double") - y.cast("double")) * 1000).cast("bigint")
    far = lambda e: F.aggregate(F.zip_with("embedding", e, lambda x, y: step(x, y) * step(x, y)), F.lit(0).cast("bigint"), lambda s, d: s + d)
    best = F.array_min(F.transform("palette", lambda p: F.struct(far(p["e"]).alias("d"), p["label"].alias("label"))))
    return rows.join(F.broadcast(palette)).select("vec_id", best["label"].alias("label"))


@query("latest_component_then_due", """
WITH last AS (SELECT o_custkey, o_orderpriority, max_by(o_orderdate, o_orderkey) AS d FROM orders GROUP BY 1, 2)
SELECT o_custkey, CAST(CAST(min(d) AS DATE) AS VARCHAR) AS due FROM last GROUP BY 1""")
def latest_component_then_due(spark, sf_dir):
    last = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.max_by("o_orderdate", "o_orderkey").alias("d"))
    return last.groupBy("o_custkey").agg(F.min("d").cast("date").cast("string").alias("due"))


@query("maintenance_due", """
SELECT o_orderkey, CASE WHEN d < 0 THEN 'overdue' WHEN d <= 14 THEN 'due' ELSE 'ok' END AS state FROM (
SELECT o_orderkey, date_diff('day', DATE '1998-06-01', CAST(o_orderdate AS DATE) + 90) AS d FROM orders)""")
def maintenance_due(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", codes.due_state(F.date_add(F.col("o_orderdate").cast("date"), 90), F.lit("1998-06-01").cast("date")).alias("state"))


@query("warranty_status", """
SELECT o_orderkey, CASE WHEN d < 0 THEN 'expired' WHEN d <= 30 THEN 'expiring' ELSE 'active' END AS state FROM (
SELECT o_orderkey, date_diff('day', DATE '1998-06-01', CAST(CAST(o_orderdate AS DATE) + INTERVAL 12 MONTH AS DATE)) AS d FROM orders)""")
def warranty_status(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", codes.warranty_state(F.col("o_orderdate").cast("date"), F.lit("1998-06-01").cast("date")).alias("state"))


@query("fleet_fit", "SELECT c_mktsegment AS family, count(*) AS printers, count(*) FILTER (WHERE c_acctbal > 0) AS idle FROM customer GROUP BY 1")
def fleet_fit(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("family")).agg(F.count("*").alias("printers"), F.count_if(F.col("c_acctbal") > 0).alias("idle"))


@query("recent_sample", """
SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) AS sample FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20)""")
def recent_sample(spark, sf_dir):
    last = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20)
    return last.agg(F.count_if(F.col("o_orderstatus") == "F").alias("completed"), F.count("*").alias("sample"))


@query("completion_ratio", """
SELECT source, CAST(CASE WHEN count(*) = 0 THEN 100 ELSE floor(100.0 * count(l.doc_id) / count(*) + 0.5) END AS INTEGER) AS percent FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source""")
def completion_ratio(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    return rows.groupBy("source").agg(codes.half_up(100.0 * F.count("has") / F.count("*"), 0).cast("int").alias("percent"))


@query("name_sort_nocase", "SELECT p_partkey, CAST(row_number() OVER (ORDER BY lower(p_name), p_partkey) AS INTEGER) AS place FROM part ORDER BY lower(p_name), p_partkey LIMIT 100")
def name_sort_nocase(spark, sf_dir):
    first = table(spark, sf_dir, "part").orderBy(F.collate("p_name", "UTF8_LCASE"), "p_partkey").limit(100)
    return first.select("p_partkey", F.row_number().over(Window.orderBy(F.lower("p_name"), "p_partkey")).alias("place"))


@query("roles_by_extension", """
SELECT role, count(*) AS n FROM (SELECT CASE WHEN e IN ('html') THEN 'document' WHEN e = 'zip' THEN 'archive' ELSE 'other' END AS role FROM (SELECT regexp_extract(url || '.html', '\\.([^.]+)$', 1) AS e FROM pages)) GROUP BY 1""".replace("\\\\", "\\"))
def roles_by_extension(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(text.file_role(F.concat("url", F.lit(".html"))).alias("role")).agg(F.count("*").alias("n"))
