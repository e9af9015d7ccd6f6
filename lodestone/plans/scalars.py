"""Queries of scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, identity, text, titles
from ..operators import actions
from .registry import query
from .tables import spread, table


@query("packed_codes", """
SELECT l_orderkey, l_linenumber, x & 65535 AS low, x >> 16 AS high, lpad(upper(to_hex(x >> 16)), 4, '0') || '-' || lpad(upper(to_hex(x & 65535)), 4, '0') AS code
FROM (SELECT l_orderkey, l_linenumber, l_partkey * 65536 + l_suppkey AS x FROM lineitem)""")
def packed_codes(spark, sf_dir):
    x = F.col("x")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 65536 + F.col("l_suppkey")).alias("x"))
    return rows.select("l_orderkey", "l_linenumber", codes.low16(x).alias("low"), codes.high16(x).alias("high"), codes.error_code(x).alias("code"))


@query("address_numbers", """
SELECT c_custkey, 167772160 + c_custkey AS number, '10.' || (c_custkey // 65536) || '.' || (c_custkey // 256 % 256) || '.' || (c_custkey % 256) AS address FROM customer""")
def address_numbers(spark, sf_dir):
    address = codes.ip_text(F.col("c_custkey") + 167772160)
    return table(spark, sf_dir, "customer").select("c_custkey", address.alias("address")).withColumn("number", codes.ip_number(F.col("address")))


@query("network_expansion", """
SELECT s_suppkey, base + i AS host FROM (SELECT s_suppkey, (167772160 + s_suppkey * 8) // 8 * 8 AS base FROM supplier), (SELECT unnest(range(1, 7)) AS i) x""")
def network_expansion(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(codes.network_hosts(F.col("s_suppkey") * 8 + 167772160, F.lit(29))).alias("host"))


@query("durations_and_text", """
SELECT p_partkey, p_size * 3600 + p_partkey % 60 * 60 + 5 AS seconds, CASE WHEN p_size > 0 THEN p_size || 'h ' || (p_partkey % 60) || 'm' ELSE (p_partkey % 60) || 'm' END AS shown FROM part""")
def durations_and_text(spark, sf_dir):
    written = F.format_string("%dh %dm 5s", "p_size", F.col("p_partkey") % 60)
    return table(spark, sf_dir, "part").select("p_partkey", text.duration_seconds(written).alias("seconds")).withColumn("shown", codes.duration_text(F.col("seconds")))


@query("version_order", """
WITH v AS (SELECT p_partkey, p_size % 2 AS minor, p_partkey % 5 AS kind, p_size AS n FROM part),
k AS (SELECT p_partkey, (minor, CASE kind WHEN 0 THEN 9 ELSE 1 END, CASE kind WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END, CASE kind WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE 0 END, CASE WHEN kind IN (1, 3) THEN n ELSE 0 END) AS k FROM v)
SELECT a.p_partkey AS a, a.k > b.k AS newer FROM k a JOIN k b ON b.p_partkey = a.p_partkey + 1""")
def version_order(spark, sf_dir):
    """Versions of one minor number: 1.0.0 after 1.0.0-rc, that after 1.0.0-beta.10, beta.2 and beta, and these after 1.0.0-7."""
    n, minor = F.col("p_size").cast("string"), (F.col("p_size") % 2).cast("string")
    pre = F.when(F.col("p_partkey") % 5 == 0, "").when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("-"), n)).when(F.col("p_partkey") % 5 == 2, "-beta").when(F.col("p_partkey") % 5 == 3, F.concat(F.lit("-beta."), n)).otherwise("-rc")
    version = F.concat(F.lit("v1."), minor, F.lit(".0"), pre)
    rows = table(spark, sf_dir, "part").select("p_partkey", codes.version_key(version).alias("v"))
    after = rows.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("v").alias("w"))
    return rows.join(after, "p_partkey").select(F.col("p_partkey").alias("a"), (F.col("v") > F.col("w")).alias("newer"))


@query("nearest_palette_colour", """
WITH h AS (SELECT p_partkey, p_partkey * 37 % 256 AS r, p_size * 5 AS g, p_partkey % 256 AS b FROM part),
d AS (SELECT p_partkey, (r - 255) * (r - 255) + g * g + b * b AS red, r * r + (g - 255) * (g - 255) + b * b AS green, r * r + g * g + (b - 255) * (b - 255) AS blue FROM h)
SELECT p_partkey, CASE WHEN red <= green AND red <= blue THEN 'red' WHEN green <= blue THEN 'green' ELSE 'blue' END AS colour FROM d""")
def nearest_palette_colour(spark, sf_dir):
    two = lambda x: F.lpad(F.hex(x), 2, "0")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("#"), two(F.col("p_partkey") * 37 % 256), two((F.col("p_size") * 5).cast("bigint")), two(F.col("p_partkey") % 256)).alias("h"))
    return actions.nearest_colour(rows, "h", [("red", "#FF0000"), ("green", "#00FF00"), ("blue", "#0000FF")]).select("p_partkey", "colour")


@query("safe_names", r"""SELECT page_id, regexp_replace(trim(regexp_replace(url, '[<>:"/\\|?*]', '_', 'g')), '[. ]+$', '') AS name FROM pages""")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.safe_segment(F.col("url"), 10_000).alias("name"))


@query("upload_disposition", """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'write' WHEN value < 10 THEN 'keep' WHEN event_type = 'purchase' THEN 'refuse' WHEN event_id % 2 = 0 THEN 'replace' ELSE 'ask' END AS what, event_type = 'click' AS idle FROM events""")
def upload_disposition(spark, sf_dir):
    what = actions.disposition(F.col("event_id") % 5 != 0, F.col("value") < 10, F.col("event_id") % 2 == 0, F.col("event_type") == "purchase")
    idle = actions.dispatch_idle(F.when(F.col("event_type") == "click", "idle").otherwise(F.col("event_type")))
    return table(spark, sf_dir, "events").select("event_id", what.alias("what"), idle.alias("idle"))


@query("fan_and_units", """
SELECT event_id, CAST(greatest(0, least(100, floor(value / 255 * 100 + 0.5))) AS INTEGER) AS fan, value > 0 AND (value / 20 > 8 OR value / 20 < 0.125) AS suspect FROM events""")
def fan_and_units(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", codes.fan_percent(F.col("value"), F.lit(255)).alias("fan"), codes.ratio_suspect(F.col("value"), F.lit(20.0)).alias("suspect"))


_NOUN = "CASE split_part(p_name, ' ', 2) WHEN 'ring' THEN 'Part' WHEN 'widget' THEN 'stand' WHEN 'bolt' THEN 'Calibration Cube' WHEN 'gear' THEN 'mesh' ELSE split_part(p_name, ' ', 2) END"
_OBJECT = f"""CASE p_type WHEN 'ECONOMY' THEN {_NOUN} WHEN 'SMALL' THEN concat({_NOUN}, '_', p_size) WHEN 'MEDIUM' THEN concat(' ', upper({_NOUN}), ' - ', p_size) WHEN 'LARGE' THEN concat(p_size, ' ')
  WHEN 'PROMO' THEN '' ELSE concat(split_part(p_name, ' ', 1), ' ', {_NOUN}) END"""


@query("generic_names", f"""
WITH n AS (SELECT p_partkey, lower(trim({_OBJECT})) AS n FROM part), s AS (SELECT *, trim(regexp_replace(n, '[\\s\\-_.#]*[0-9]+$', '')) AS stem FROM n)
SELECT p_partkey, CASE WHEN n = '' THEN 'empty' WHEN regexp_full_match(n, '[0-9]+') THEN 'number' WHEN n IN ('part', 'stand', 'calibration cube', 'mesh', 'plate') THEN 'common word' WHEN stem IN ('part', 'stand', 'calibration cube', 'mesh', 'plate') THEN 'numbered' END AS why,
  CASE CASE WHEN n IN ('part', 'stand', 'calibration cube', 'mesh', 'plate') THEN n WHEN NOT regexp_full_match(n, '[0-9]*') THEN stem END
    WHEN 'part' THEN 'part' WHEN 'stand' THEN 'accessory' WHEN 'calibration cube' THEN 'test print' WHEN 'mesh' THEN 'default name' WHEN 'plate' THEN 'build plate' END AS reason
FROM s""".replace("\\\\", "\\"))
def generic_names(spark, sf_dir):
    name = F.expr(_OBJECT)
    return table(spark, sf_dir, "part").select("p_partkey", titles.generic_object(name).alias("why"), titles.generic_reason(name)["reason"].alias("reason"))


#: Model, settings, compatible printers and code of files, and what they tell: family, brand, confidence, method, conflict.
_FILES = (
    ("Bambu Lab P2S", "", "", "N7", "bambu-p2s", "Bambu Lab", "high", "model_code", False),
    ("Creality K1C", "Creality K1C 0.4 nozzle", "", "", "creality-k1c", "Creality", "high", "model+settings", False),
    ("Creality_K1 Max", "", "", "", None, "Creality", "low", "brand_only", False),
    ("Creality K1 SE", "", "", "", None, "Creality", "low", "brand_only", False),
    ("Creality K1", "", "", "", "creality-k1", "Creality", "high", "model", False),
    ("Creality Ender-3 V3 KE", "Creality Ender-3 V3 Plus", "", "", "creality-ender3-v3-ke", "Creality", "medium", "model_contradicted", True),
    ("Generic Klipper Printer", "0.20mm Standard @Creality Ender-3 V3 Plus", "", "", "creality-ender3-v3-plus", "Creality", "medium", "settings", False),
    ("My Klipper K1C", "", "Flashforge AD5X", "", "flashforge-ad5x", "FlashForge", "medium", "settings", False),
    ("Flashforge Adventurer 5M Pro", "", "Flashforge Adventurer 5M", "", "flashforge-5m-pro", "FlashForge", "medium", "model_contradicted", True),
    ("Snapmaker U1", "", "", "X9", "snapmaker-u1", "SnapMaker", "high", "model", False),
    ("", "SPARKX i7 or P2S", "", "", None, None, "low", "none", False),
    ("Generic", "", "K1C;AD5X", "", None, None, "low", "none", True),
    ("", " ", "", "", None, None, None, None, False),
)


def _sql(value) -> str:
    return "NULL" if value is None else str(value).upper() if isinstance(value, bool) else f"'{value}'"


@query("family_by_label", f"""
SELECT p_partkey, family, brand, confidence, method, conflict FROM part JOIN (VALUES {', '.join(f"({i}, {', '.join(map(_sql, f[4:]))})" for i, f in enumerate(_FILES))}) t(i, family, brand, confidence, method, conflict) ON p_partkey % {len(_FILES)} = i""")
def family_by_label(spark, sf_dir):
    told = [F.get(F.array(*[F.lit(f[k]) for f in _FILES]), (F.col("p_partkey") % len(_FILES)).cast("int")) for k in range(4)]
    part = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    return part.select("p_partkey", identity.identify_file(*told).alias("x")).select("p_partkey", "x.family", "x.brand", "x.confidence", "x.method", "x.conflict")


@query("printer_fit", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'match' WHEN 1 THEN 'model_mismatch' WHEN 2 THEN 'brand_mismatch' ELSE 'unknown' END AS status, p_partkey % 5 IN (0, 1) AND p_size % 2 = 0 OR p_partkey % 5 = 2 AS confident,
  CASE p_partkey % 5 WHEN 0 THEN 'connector' WHEN 1 THEN 'detected_model' WHEN 2 THEN 'reported_model' END AS method FROM part""")
def printer_fit(spark, sf_dir):
    of = lambda *values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("p_partkey") % 5).cast("int"))
    printer = identity.identify_printer(of("creality-k1c", "other", None, None, None), of(None, "Creality K1", "?", "", None), of("AD5X", None, "Flashforge AD5X", "K1C and AD5X", None), of(None, None, None, "Creality", None))
    rows = table(spark, sf_dir, "part").select("p_partkey", printer.alias("p"), F.when(F.col("p_size") % 2 == 0, "high").otherwise("medium").alias("sure"))
    fit = identity.fits(F.lit("creality-k1c"), F.lit("Creality"), F.col("sure"), F.col("p.key"), F.col("p.brand"))
    return rows.select("p_partkey", fit.alias("f"), "p.method").select("p_partkey", "f.status", "f.confident", "method")


@query("families_like_name", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'creality-k1c' WHEN 1 THEN 'flashforge-5m,flashforge-5m-pro' WHEN 2 THEN 'flashforge-5m-pro' WHEN 3 THEN 'creality-ender3-v3-ke,creality-ender3-v3-plus' ELSE '' END AS families FROM part""")
def families_like_name(spark, sf_dir):
    name = F.get(F.array(*[F.lit(v) for v in ("K1 C", "5m", "5M_Pro", "v3", "Pro", "3")]), (F.col("p_partkey") % 6).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(identity.families_like(name)), ",").alias("families"))


@query("title_rules")
def title_rules(spark, sf_dir):
    """Ordered, recorded rules without SQL form; tests hold them against named cases."""
    rows = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.concat(F.lit("2x "), F.col("p_name"), F.lit(" (5h11m, 102g)_PLA.gcode")).alias("name"))
    return titles.with_titles(rows, "name").select("p_partkey", "title.normalized", "title.token_count", "title.display")
