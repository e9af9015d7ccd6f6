"""Identity, text, search and resolution queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, lineage, resolve, search, searchindex
from ..sources import files
from ..sources.storage import shared_folder, written
from .registry import query
from .tables import table


@query("content_hashes", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, sha1(concat_ws('|', source, lang, CAST(doc_id AS VARCHAR))) AS claim FROM documents")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"), resolve.claim_key(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("claim"))


@query("quick_fingerprint", """
WITH d AS (SELECT doc_id, encode(text) AS b, octet_length(encode(text)) AS n FROM documents), w AS (SELECT *, greatest(0, n // 2 - 32) AS mid, greatest(0, n - 64) AS last FROM d)
SELECT doc_id, CASE WHEN b IS NOT NULL THEN substr(sha256(encode(n || ':') || b[1:64] || CASE WHEN mid > 0 THEN b[mid + 1:mid + 64] ELSE ''::BLOB END || CASE WHEN last > 0 AND last <> mid THEN b[last + 1:last + 64] ELSE ''::BLOB END), 1, 32) END AS quick_fp, sha256(b) AS sha256 FROM w""")
def quick_fingerprint(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return files.with_fingerprints(rows, 64).select("doc_id", "quick_fp", "sha256")


@query("duplicate_pairs", "SELECT md5(x.text) AS k, x.doc_id AS a, y.doc_id AS b FROM documents x JOIN documents y ON x.text = y.text AND x.doc_id < y.doc_id")
def duplicate_pairs(spark, sf_dir):
    return resolve.duplicate_pairs(table(spark, sf_dir, "documents").select(F.md5("text").alias("k"), "doc_id"), "k", "doc_id").select("k", "a", "b")


@query("duplicate_chain", "SELECT md5(text) AS k, a, doc_id AS b FROM (SELECT text, doc_id, lag(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS a FROM documents) WHERE a IS NOT NULL")
def duplicate_chain(spark, sf_dir):
    return resolve.duplicates(table(spark, sf_dir, "documents").select(F.md5("text").alias("k"), "doc_id"), "k", "doc_id").select("k", "a", "b")


@query("title_normalise_subset", """
SELECT p_partkey, trim(regexp_replace(lower(regexp_replace(p_name || '_id_3_copy_' || p_partkey || '.stl', '\\.(stl|obj|3mf)$', '')), '[_\\s]+', ' ', 'g')) AS name FROM part""".replace("\\\\", "\\"))
def title_normalise_subset(spark, sf_dir):
    raw = F.concat("p_name", F.lit("_id_3_copy_"), F.col("p_partkey").cast("string"), F.lit(".stl"))
    return table(spark, sf_dir, "part").select("p_partkey", text.object_name(raw).alias("name"))


@query("camel_split_words", r"""
SELECT p_partkey, regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(replace(p_type, ' ', '') || 'STLFile' || p_size || 'Final', '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([0-9])([A-Za-z]{2,})', '\1 \2', 'g')), '[a-z0-9]+') AS words FROM part""")
def camel_split_words(spark, sf_dir):
    raw = F.concat(F.replace("p_type", F.lit(" "), F.lit("")), F.lit("STLFile"), F.col("p_size").cast("string"), F.lit("Final"))
    return table(spark, sf_dir, "part").select("p_partkey", text.words(text.camel_split(raw)).alias("words"))


@query("search_forms", r"""
WITH w AS (SELECT p_partkey, regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+') AS w FROM part)
SELECT p_partkey, list_sort(list_distinct(list_filter(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || w[i + 1] || w[i + 2])), lambda x: length(x) > 1))) AS forms FROM w""")
def search_forms(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_sort(text.search_forms(F.concat_ws(" ", F.lower("p_name"), F.lower("p_type")))).alias("forms"))


@query("search_prefix_and", r"""
WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' ')) AS w FROM part)
SELECT p_partkey FROM w GROUP BY p_partkey HAVING bool_or(w LIKE 'st%') AND bool_or(w LIKE 'b%')""".replace("bool_or(w LIKE 'b%')", "bool_or(w LIKE 'br%')"))
def search_prefix_and(spark, sf_dir):
    """Built by the first search of a table, kept for all later ones."""
    index = searchindex.kept(table(spark, sf_dir, "part"), "parts", "p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    return index.search("St br").select(F.col("key").cast("bigint").alias("p_partkey"))


_FOUND = """
SELECT '{step}' AS step, p_partkey FROM {rows} t GROUP BY p_partkey HAVING bool_or(w LIKE 'sm%') AND bool_or(w LIKE 'ri%') OR bool_or(w LIKE 'smri%')
UNION ALL SELECT '{step}, joined', p_partkey FROM {rows} t GROUP BY p_partkey HAVING bool_or(w LIKE 'small%') AND bool_or(w LIKE 'bo%') OR bool_or(w LIKE 'smallbo%')"""
_WORDS = "SELECT p_partkey, unnest(string_split({text}, ' ')) AS w FROM part"


@query("search_index_changes", f"""
WITH built AS ({_WORDS.format(text="lower(p_name || ' ' || p_type)")}),
  turned AS (SELECT p_partkey, unnest(CASE WHEN p_size % 7 = 0 THEN [split_part(lower(p_name), ' ', 2), lower(p_type), 'smallboat'] ELSE list_concat(string_split(lower(p_name), ' '), [lower(p_type)]) END) AS w FROM part),
  cut AS (SELECT * FROM turned WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_retailprice > 1500))
{_FOUND.format(step="built", rows="built")} UNION ALL {_FOUND.format(step="changed", rows="turned")} UNION ALL {_FOUND.format(step="cut", rows="cut")} UNION ALL {_FOUND.format(step="merged", rows="cut")}""")
def search_index_changes(spark, sf_dir):
    """An index of all parts, then with a batch of new texts in place of old ones, without deleted parts, and merged: what two searches find each time."""
    part = table(spark, sf_dir, "part")
    index = searchindex.SearchIndex(spark, f"{shared_folder(spark)}/search-changes-{uuid.uuid4().hex}")

    def found(step):
        each = [index.search(text).select(F.lit(name).alias("step"), F.col("key").cast("bigint").alias("p_partkey")) for name, text in ((step, "SM ri"), (f"{step}, joined", "Smáll bo"))]
        return written(each[0].unionByName(each[1]), "found")  # before the next change

    index.add(part, "p_partkey", F.concat_ws(" ", "p_name", "p_type"))
    out = [found("built")]
    index.add(part.where("p_size % 7 = 0"), "p_partkey", F.concat_ws(" ", F.split("p_name", " ")[1], "p_type", F.lit("smallboat")))
    out.append(found("changed"))
    index.delete(part.where("p_retailprice > 1500"), "p_partkey")
    out.append(found("cut"))
    index.compact(whole=True)
    out.append(found("merged"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("page_title_extract", r"""
SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title[^>]*>((?s:.*?))</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&') AS title,
  len(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1))::INTEGER AS links FROM pages""")
def page_title_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.xml_text(F.col("html"), "title").alias("title"), F.size(text.xml_attributes(F.col("html"), "a", "href")).alias("links"))


@query("page_link_domains", r"SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, count(*) AS n, min(regexp_replace(url, '^([a-z]+://[^/?#]+).+$', '\1/…')) AS redacted FROM pages GROUP BY 1")
def page_link_domains(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(text.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.min(text.redact_url(F.col("url"))).alias("redacted"))


_BLOCKS = """
b AS (SELECT p_partkey, 'brand_size' AS kind, p_brand || '/' || p_size AS v FROM part UNION ALL SELECT p_partkey, 'type_size', p_type || '/' || p_size FROM part),
s AS (SELECT kind, v FROM b GROUP BY 1, 2 HAVING count(DISTINCT p_partkey) BETWEEN 2 AND 50),
p AS (SELECT x.p_partkey AS a, y.p_partkey AS b, list_sort(list(DISTINCT x.kind)) AS via FROM b x JOIN s USING (kind, v) JOIN b y ON x.kind = y.kind AND x.v = y.v AND x.p_partkey < y.p_partkey GROUP BY 1, 2)"""


def _part_blocks(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("key", F.col("p_partkey"))
    of = lambda kind, c: part.select("key", F.lit(kind).alias("kind"), F.concat_ws("/", c, F.col("p_size").cast("string")).alias("value"))
    return part, of("brand_size", "p_brand").unionByName(of("type_size", "p_type"))


@query("blocking_pairs_capped", f"WITH {_BLOCKS} SELECT a, b, array_to_string(via, '+') AS via FROM p")
def blocking_pairs_capped(spark, sf_dir):
    return resolve.blocked_pairs(_part_blocks(spark, sf_dir)[1]).select("a", "b", F.array_join("via", "+").alias("via"))


@query("common_blocks_reported", f"WITH {_BLOCKS} SELECT kind, v AS value, count(DISTINCT p_partkey) AS keys FROM b GROUP BY 1, 2 HAVING count(DISTINCT p_partkey) > 5")
def common_blocks_reported(spark, sf_dir):
    return resolve.common_blocks(_part_blocks(spark, sf_dir)[1], 5)


_PAIRS = f"""
{_BLOCKS},
e AS (SELECT p.a, p.b, x.p_name AS ta, y.p_name AS tb, x.p_type = y.p_type AS same_obj, x.p_brand = y.p_brand AS same_design FROM p JOIN part x ON p.a = x.p_partkey JOIN part y ON p.b = y.p_partkey),
t AS (SELECT *, CASE WHEN ta = tb THEN 'medium' WHEN len(string_split(ta, ' ')) <= len(string_split(tb, ' ')) AND contains(' ' || tb || ' ', ' ' || ta || ' ') OR len(string_split(ta, ' ')) > len(string_split(tb, ' ')) AND contains(' ' || ta || ' ', ' ' || tb || ' ') THEN 'weak' ELSE 'none' END AS title FROM e)"""


@query("pair_policy", f"""
WITH {_PAIRS}
SELECT a, b, CASE WHEN NOT same_obj THEN 'record' WHEN title = 'medium' THEN 'auto' ELSE 'suggest' END AS cls, CASE WHEN NOT same_obj THEN 'low' WHEN title = 'medium' THEN 'high' ELSE 'medium' END AS confidence FROM t""")
def pair_policy(spark, sf_dir):
    return _pairs(spark, sf_dir).select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), "cls", "confidence")


def _pairs(spark, sf_dir):
    part, blocks = _part_blocks(spark, sf_dir)
    empty = F.array().cast("array<string>")
    nodes = part.select("key", F.col("p_name").alias("title"), F.lit(2).alias("token_count"), F.lit(0.0).alias("generic_score"), F.array("p_type").alias("objects"), empty.alias("designs"))
    return resolve.policy(resolve.evidence(resolve.blocked_pairs(blocks), nodes))


@query("duplicate_components", """
WITH RECURSIVE l AS (SELECT DISTINCT a.doc_id AS u, b.doc_id AS v FROM (SELECT doc_id, unnest([md5(text), source || ':' || n_chars]) AS k FROM documents) a JOIN (SELECT doc_id, unnest([md5(text), source || ':' || n_chars]) AS k FROM documents) b ON a.k = b.k),
r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
SELECT u AS doc_id, min(v) AS component FROM r GROUP BY u""")
def duplicate_components(spark, sf_dir):
    """Flagship: documents joined by equal content or by equal place and size, as connected components.

    Each key links its members to its smallest, so a key held by many rows gives one link a row.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.md5("text"), F.concat_ws(":", "source", F.col("n_chars").cast("string")))).alias("k"))
    least = docs.groupBy("k").agg(F.min("doc_id").alias("b"))
    links = docs.join(least.hint("merge"), "k").select(F.col("doc_id").alias("a"), "b")
    return graph.components(docs.select(F.col("doc_id").alias("key")).distinct(), links).select(F.col("key").alias("doc_id"), "component")


@query("constrained_clusters")
def constrained_clusters(spark, sf_dir):
    """Sequential rule without SQL form: automatic edges under pins and rejections; tests hold it against a plain loop."""
    pairs = _pairs(spark, sf_dir).select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "cls", "confidence")
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"))
    model = lambda n, r: keys.where(F.col("key").cast("bigint") % n == r).select("key", (F.col("key").cast("bigint") % 7).alias("model"))
    apart = spark.createDataFrame([(1, 2)], "a bigint, b bigint")
    clusters = resolve.constrained_clusters(keys, pairs.where("cls <> 'record'").withColumn("confidence", F.lit("high")), model(11, 3), model(13, 5), model(5, 1), apart)
    return clusters


@query("assigned_models", """
WITH RECURSIVE k AS (SELECT o_orderkey AS key, o_custkey AS cluster, o_orderpriority AS p, o_orderstatus AS s, o_totalprice AS t FROM orders),
size AS (SELECT cluster, count(*) AS size, min(key) AS first FROM k GROUP BY 1),
pinned AS (SELECT cluster, min(5000000 + cluster // 5) AS model FROM k WHERE t > 400000 GROUP BY 1),
claim AS (SELECT cluster, cluster // 2 AS model FROM k WHERE p NOT LIKE '5%' UNION ALL SELECT cluster, 1000000 + cluster // 3 FROM k WHERE s = 'O'),
cand AS (SELECT cluster, model, row_number() OVER (ORDER BY n DESC, first, model) AS rn
  FROM (SELECT cluster, model, count(*) AS n FROM claim WHERE cluster NOT IN (SELECT cluster FROM pinned) GROUP BY 1, 2) JOIN size USING (cluster) WHERE n * 2 >= size),
g(rn, done, taken) AS (
  SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[]
  UNION ALL
  SELECT c.rn, CASE WHEN list_contains(done, cluster) OR list_contains(taken, model) THEN done ELSE list_append(done, cluster) END,
         CASE WHEN list_contains(done, cluster) OR list_contains(taken, model) THEN taken ELSE list_append(taken, model) END
  FROM g JOIN cand c ON c.rn = g.rn + 1),
last AS (SELECT done, taken FROM g ORDER BY rn DESC LIMIT 1),
won AS (SELECT unnest(done) AS cluster, unnest(taken) AS model FROM last UNION ALL SELECT cluster, model FROM pinned)
SELECT cluster, coalesce(model::VARCHAR, 'new-' || substr(sha1(cluster::VARCHAR), 1, 16)) AS model, model IS NULL AS created FROM size LEFT JOIN won USING (cluster)""")
def assigned_models(spark, sf_dir):
    """Orders grouped by customer; what owned them before makes neighbours compete for a model, second choices included."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("cluster"), "o_orderpriority", "o_orderstatus", "o_totalprice")
    half = F.expr("cluster div 2")
    owned = rows.select("key", half.alias("model")).unionByName(rows.where("o_orderstatus = 'O'").select("key", F.expr("1000000 + cluster div 3").alias("model")))
    pins = rows.where("o_totalprice > 400000").select("key", F.expr("5000000 + cluster div 5").alias("model"))
    return resolve.assigned(rows.select("key", "cluster"), pins, rows.where("o_orderpriority LIKE '5%'").select("key", half.alias("model")), owned)


@query("containment_unique_hits", "SELECT item_id, doc_id, count(*) OVER (PARTITION BY item_id) = 1 AS \"unique\" FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))")
def containment_unique_hits(spark, sf_dir):
    return search.contained(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", "text"), "item_id", "doc_id").select("item_id", "doc_id", "unique")


@query("set_equality_join", """
WITH s AS (SELECT doc_id, array_to_string(list_sort(list_distinct(string_split(lower(text), ' '))), '|') AS k FROM documents)
SELECT k1.doc_id AS a, k2.doc_id AS b FROM s k1 JOIN s k2 ON k1.k = k2.k AND k1.doc_id < k2.doc_id""")
def set_equality_join(spark, sf_dir):
    sets = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.split(F.lower("text"), " "))), "|").alias("k")).withColumn("k", F.md5("k"))
    return sets.select(F.col("doc_id").alias("a"), "k").join(sets.select(F.col("doc_id").alias("b"), "k"), "k").where("a < b").select("a", "b")


@query("name_join_uniqueness", """
SELECT a, b, n = 1 AS sure FROM (SELECT x.p_partkey AS a, y.p_partkey AS b, count(*) OVER (PARTITION BY x.p_partkey) AS n FROM part x
  JOIN part y ON lower(x.p_name || ' ' || x.p_partkey // 3) = lower(y.p_name || ' ' || y.p_partkey // 3) AND x.p_partkey <> y.p_partkey)""")
def name_join_uniqueness(spark, sf_dir):
    name = F.concat_ws(" ", "p_name", F.floor(F.col("p_partkey") / 3).cast("string"))
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("name"))
    return lineage.named_files(files.select("id", F.upper("name").alias("name")), files).select(F.col("id").alias("a"), F.col("hit").alias("b"), (F.col("hits") == 1).alias("sure"))


@query("placeholder_mismatches", r"""
SELECT conv_id, turn FROM (SELECT conv_id, turn, list_sort(list_distinct(regexp_extract_all(text, '([0-9]+)', 1))) AS a,
  list_sort(list_distinct(regexp_extract_all(lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '([0-9]+)', 1))) AS b FROM conversations) WHERE b IS NOT NULL AND a <> b""")
def placeholder_mismatches(spark, sf_dir):
    """Neighbouring turns as two wordings of one message, numbers as their placeholders."""
    braces = lambda c: text.placeholders(F.regexp_replace(c, r"([0-9]+)", "{$1}"))
    rows = table(spark, sf_dir, "conversations").withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    return rows.where("next IS NOT NULL").where(braces(F.col("text")) != braces(F.col("next"))).select("conv_id", "turn")
