"""String expressions: names, titles, search words, addresses, small formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_key(x: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "")


def camel_split(x: Column) -> Column:
    """Blanks at borders between lower and upper case, before the last capital of a run, and between a number and a word."""
    x = F.regexp_replace(x, r"(\p{Ll})(\p{Lu})", "$1 $2")
    x = F.regexp_replace(x, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.regexp_replace(x, r"(\p{N})(\p{L}{2,})", "$1 $2")


def words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def search_forms(x: Column, most: int = 400) -> Column:
    """Words parted at capitals, and joins of two and three neighbours of these and of the words as they are; of more than one character, each once."""

    def joined(list_: Column) -> Column:
        n = F.size(list_)
        run = lambda i, k: F.array_join(F.slice(list_, i, k), "")
        each = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.when(i + 2 <= n, F.array(run(i, 2), run(i, 3))).otherwise(F.array(run(i, 2))))
        return F.when(n > 1, F.flatten(each)).otherwise(F.array().cast("array<string>"))

    parted = words(camel_split(x))
    all_ = F.concat(parted, joined(parted), joined(words(x)))
    return F.slice(F.array_distinct(F.filter(all_, lambda w: F.length(w) > 1)), 1, most)


def object_name(x: Column) -> Column:
    """Instance suffix and model extension taken off, separators folded, lower case."""
    x = F.regexp_replace(F.trim(x), r"^[\"']|[\"']$", "")
    x = F.regexp_replace(x, r"^(.*?)[ _]id[:_]\d+[ _]copy[ _]\d+$", "$1")
    x = F.regexp_replace(x, r"(?i)\.(stl|obj|3mf|step|stp|amf|ply)$", "")
    return F.lower(F.trim(F.regexp_replace(x, r"[_\s]+", " ")))


def object_instance(x: Column) -> Column:
    """id:copy of a placed instance; null for names without one."""
    found = F.regexp_extract(x, r"[ _]id[:_](\d+)[ _]copy[ _](\d+)$", 1)
    return F.when(found != "", F.concat_ws(":", found, F.regexp_extract(x, r"[ _]id[:_](\d+)[ _]copy[ _](\d+)$", 2)))


def duration_seconds(x: Column) -> Column:
    """Seconds of texts such as ``1d 2h 3m 4s``; null if none is named."""
    pattern = r"(\d+(?:\.\d+)?)\s*([dhms])"
    number = F.regexp_extract_all(F.lower(x), F.lit(pattern), F.lit(1))
    unit = F.regexp_extract_all(F.lower(x), F.lit(pattern), F.lit(2))
    worth = lambda u: F.when(u == "d", 86400).when(u == "h", 3600).when(u == "m", 60).otherwise(1)
    total = F.aggregate(F.zip_with(number, unit, lambda n, u: n.cast("double") * worth(u)), F.lit(0.0), lambda a, b: a + b)
    return F.when(F.size(number) > 0, F.floor(total + 0.5).cast("bigint"))


def generator_name(x: Column) -> Column:
    has_version = F.trim(x).rlike(r"(?i)\sv?\d\S*$")
    return F.when(has_version, F.regexp_replace(F.trim(x), r"\s+\S+$", "")).otherwise(F.trim(x))


def generator_version(x: Column) -> Column:
    found = F.regexp_extract(F.trim(x), r"(?i)\sv?(\d\S*)$", 1)
    return F.when(found != "", found)


def config_key(line: Column) -> Column:
    """Key of a ``; key = value`` line, by the first ``=``; null for other lines."""
    at = F.instr(line, "=")
    key = F.trim(line.substr(F.lit(2), at - 2))
    return F.when((F.substring(line, 1, 1) == ";") & (at > 2) & key.rlike(r"^[A-Za-z0-9_\- ()\[\]/%]+$"), key)


def config_value(line: Column) -> Column:
    at = F.instr(line, "=")
    return F.when(config_key(line).isNotNull(), F.trim(line.substr(at + 1, F.length(line))))


def split_aligned(x: Column) -> Column:
    """Parts by ``;`` if there is one, else by ``,``; trimmed."""
    parts = F.when(F.contains(x, F.lit(";")), F.split(x, ";")).otherwise(F.split(x, ","))
    return F.transform(parts, lambda p: F.trim(p))


def norm_hex(x: Column) -> Column:
    """#RRGGBB in upper case from #RGB, #RRGGBB or #RRGGBBAA, with or without #; null for others."""
    bare = F.upper(F.regexp_replace(F.trim(x), "^#", ""))
    short = F.regexp_replace(bare, "^(.)(.)(.)$", "$1$1$2$2$3$3")
    return F.when(bare.rlike("^[0-9A-F]{3}$"), F.concat(F.lit("#"), short)).when(bare.rlike("^[0-9A-F]{6}([0-9A-F]{2})?$"), F.concat(F.lit("#"), F.substring(bare, 1, 6)))


def job_name(x: Column) -> Column:
    """A file's base name without its path and print extensions, lower case."""
    base = F.regexp_replace(x, r"^.*[\\/]", "")
    return F.lower(F.regexp_replace(base, r"(?i)(\.gcode)?\.(gcode|gco|g|3mf|bgcode)$", ""))


def redact_url(x: Column) -> Column:
    """Scheme and host stay, everything after is hidden."""
    return F.regexp_replace(x, r"^([a-z]+://[^/?#]+).+$", "$1/…")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1))


def xml_text(doc: Column, tag: str) -> Column:
    """Text of the first such element, entities resolved."""
    inner = F.regexp_extract(doc, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)
    return unescape(inner)


def unescape(x: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def xml_attributes(doc: Column, tag: str, attribute: str) -> Column:
    return F.regexp_extract_all(doc, F.lit(rf'<{tag}\s[^>]*?{attribute}="([^"]*)"'), F.lit(1))


def placeholders(x: Column) -> Column:
    """The distinct {names} of a message, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(r"\{(\w+)\}"), F.lit(1))))


def layer_count(x: Column) -> Column:
    """Total layers by the first of three comment styles that has them."""
    styles = (r"(?im)^;\s*total layer number:\s*(\d+)", r"(?im)^;\s*LAYER_COUNT:\s*(\d+)", r"(?im)^;\s*total_layers\s*=\s*(\d+)")
    return F.coalesce(*[F.when(F.regexp_extract(x, p, 1) != "", F.regexp_extract(x, p, 1).cast("int")) for p in styles])


def printed_stats(x: Column) -> tuple[Column, Column]:
    """(seconds, grams) from the comments of either of two dialects."""
    first = lambda *patterns: F.coalesce(*[F.when(F.regexp_extract(x, p, 1) != "", F.regexp_extract(x, p, 1)) for p in patterns])
    seconds = duration_seconds(first(r"(?im)^;\s*estimated printing time[^=]*=\s*(.+)$", r"(?im)^;\s*model printing time:\s*([^;]+)"))
    grams = first(r"(?im)^;\s*(?:total )?filament used \[g\]\s*=\s*([\d.]+)", r"(?im)^;\s*total filament weight \[g\]\s*:\s*([\d.]+)").cast("double")
    return seconds, grams


def file_role(name: Column) -> Column:
    """What a file is for, by its extension; .gcode.3mf is sliced."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    out = F.when(F.lower(name).endswith(".gcode.3mf") | ext.isin("gcode", "gco", "g", "gx", "bgcode"), "sliced")
    for role, list_ in (("project", ["3mf"]), ("source", ["stl", "obj", "step", "stp", "amf", "ply"]), ("image", ["png", "jpg", "jpeg", "webp", "gif"]), ("document", ["pdf", "txt", "md", "html"]), ("archive", ["zip", "7z", "rar", "gz"])):
        out = out.when(ext.isin(list_), role)
    return out.otherwise("other")


def safe_segment(x: Column, most: int = 120) -> Column:
    """A name that any file system takes; reserved device names get an underscore."""
    x = F.trim(F.regexp_replace(x, r'[\x00-\x1f<>:"/\\|?*]', "_"))
    x = F.regexp_replace(x, r"[. ]+$", "")
    x = F.when(x.rlike(r"(?i)^(con|prn|aux|nul|com\d|lpt\d)(\..*)?$"), F.concat(F.lit("_"), x)).otherwise(x)
    return F.substring(F.when(x == "", "_").otherwise(x), 1, most)


def firmware_parts(x: Column) -> tuple[Column, Column]:
    """(model, version) of names such as ``Model_V1.2.3.bin``; nulls if it has another form."""
    pattern = r"(?i)^(.+?)[_-]v?(\d+(?:\.\d+)+).*\.(bin|img|zip|swu)$"
    return tuple(F.when(F.regexp_extract(x, pattern, g) != "", F.regexp_extract(x, pattern, g)) for g in (1, 2))


def firmware_build(x: Column) -> Column:
    """Struct (product, version, build_time, build_id) of an upgrade image's name, product_version_time_upgrade.bin; nulls for other names."""
    pattern = r"(?i)^([a-z0-9]+)_(\d+(?:\.\d+){2,3})_(\d{14})_upgrade\.bin$"
    part = lambda g: F.when(x.rlike(pattern), F.regexp_extract(x, pattern, g))
    return F.struct(part(1).alias("product"), part(2).alias("version"), part(3).alias("build_time"), F.concat(part(2), F.lit("_"), part(3)).alias("build_id"))


def reported_version(x: Column) -> Column:
    """The version of a build id that a machine reports."""
    return F.when(x != "", F.substring_index(x, "_", 1))
