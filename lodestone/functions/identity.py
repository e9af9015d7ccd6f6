"""Printer families named in texts, files and settings.

Only families that the table names are ever told; what names none, or two, is
told as unknown.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Family(NamedTuple):
    key: str
    brand: str
    label: str
    pattern: str


# Families, the brand and label of each, and the patterns that name them.
FAMILIES = (
    Family("snapmaker-u1", "SnapMaker", "Snapmaker U1", r"\bsnapmaker\s*u1\b"),
    Family("flashforge-ad5x", "FlashForge", "Flashforge AD5X", r"\bad5x\b"),
    Family("flashforge-5m-pro", "FlashForge", "Flashforge Adventurer 5M Pro", r"\b(?:adventurer\s*5m|ad5m)\s*pro\b"),
    Family("flashforge-5m", "FlashForge", "Flashforge Adventurer 5M", r"\b(?:adventurer\s*5m|ad5m)\b(?!\s*pro)"),
    Family("creality-ender3-v3-plus", "Creality", "Creality Ender-3 V3 Plus", r"\bender-?3\s*v3\s*plus\b"),
    Family("creality-ender3-v3-ke", "Creality", "Creality Ender-3 V3 KE", r"\bender-?3\s*v3\s*ke\b"),
    Family("creality-k1c", "Creality", "Creality K1C", r"\bk1\s*c\b"),
    Family("creality-sparkx-i7", "Creality", "Creality SPARKX i7", r"\bsparkx\s*i7\b"),
    Family("creality-k1", "Creality", "Creality K1", r"\bk1\b(?!\s*(?:c|max|se)\b)"),
    Family("bambu-p2s", "Bambu Lab", "Bambu Lab P2S", r"\bp2s\b"),
)
# Model codes and the family of each; what marks a model as generic; the brands.
MODEL_CODES = {"N7": "bambu-p2s"}
GENERIC = r"\bgeneric\b|^\s*my\s?klipper\b"
BRANDS = ("SnapMaker", "FlashForge", "Creality", "Bambu Lab")


def folded(x: Column) -> Column:
    """Lower case, underscores as blanks, null as empty."""
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "_+", " ")


def told(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit(""))) != ""


def once(of: Callable[[Column], Column], **values: Column) -> Column:
    """What ``of`` makes of a struct of values, each of which is worked out once a row, however often ``of`` names it."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), of), 0)


def families_in(x: Column) -> Column:
    """All families that a text names."""
    return once(lambda v: F.array_compact(F.array(*[F.when(v["low"].rlike(f.pattern), F.lit(f.key)) for f in FAMILIES])), low=folded(x))


def only(found: Column) -> Column:
    """The one of a list that holds exactly one."""
    return F.when(F.size(found) == 1, F.get(found, 0))


def family_of(x: Column) -> Column:
    """The family, if a text names exactly one."""
    return once(lambda v: only(v["found"]), found=families_in(x))


def of_family(key: Column, field: str) -> Column:
    """Brand or label of a family; null for what is none."""
    table = F.create_map(*[F.lit(v) for f in FAMILIES for v in (f.key, getattr(f, field))])
    return F.try_element_at(table, key)


def brand_in(settings: Column, model: Column, brands: tuple[str, ...] = BRANDS) -> Column:
    """The first brand that the settings' vendor (before an @) names, else the first that the model names."""
    texts = (F.lower(F.substring_index(settings, "@", 1)), F.lower(model))
    return F.coalesce(*[F.coalesce(*[F.when(F.contains(t, F.lit(b.lower())), F.lit(b)) for b in brands]) for t in texts])


def identify_file(model: Column, settings: Column, compatible: Column, code: Column, brands: tuple[str, ...] = BRANDS) -> Column:
    """(has_data, family, label, brand, confidence, method, conflict) of a file.

    A known model code decides. A model that is not generic and names one family
    does so too, with less confidence where the settings or the compatible
    printers name another; without it, what these two agree on is likely. Else
    the brand is all that can be told.
    """
    by_code = F.try_element_at(F.create_map(*[F.lit(v) for pair in MODEL_CODES.items() for v in pair]), F.trim(code))
    own = F.when(told(model) & ~folded(model).rlike(GENERIC), family_of(model))
    is_told = told(model) | told(settings) | told(compatible) | told(code)
    brand = brand_in(settings, model, brands)
    values = lambda v: {k: v[k] for k in ("told", "by_code", "own", "brand", "hits")}
    others = lambda v: F.array_distinct(F.array_compact(F.array(v["of_settings"], only(v["hits"]))))
    return once(lambda v: once(_decided, others=others(v), **values(v)), told=is_told, by_code=by_code, own=own, brand=brand, of_settings=family_of(settings), hits=families_in(compatible))


def _decided(v: Column) -> Column:
    by_code, own, others, brand = v["by_code"], v["own"], v["others"], v["brand"]
    many, agrees = F.size(v["hits"]) > 1, F.size(F.array_except(others, F.array(own))) == 0
    nothing = F.lit(None).cast("string")

    def told_as(family: Column, confidence: str, method: Column, conflict: Column, brand_: Column | None = None) -> Column:
        of_brand = of_family(family, "brand") if brand_ is None else brand_
        return F.struct(F.lit(True).alias("has_data"), family.alias("family"), of_family(family, "label").alias("label"), of_brand.alias("brand"), F.lit(confidence).alias("confidence"), method.alias("method"), conflict.alias("conflict"))

    none = F.struct(F.lit(False).alias("has_data"), *[nothing.alias(n) for n in ("family", "label", "brand", "confidence", "method")], F.lit(False).alias("conflict"))
    no, yes = F.lit(False), F.lit(True)
    out = F.when(~v["told"], none)
    out = out.when(by_code.isNotNull(), told_as(by_code, "high", F.lit("model_code"), no))
    out = out.when(own.isNotNull() & agrees, told_as(own, "high", F.when(F.size(others) > 0, "model+settings").otherwise("model"), many))
    out = out.when(own.isNotNull(), told_as(own, "medium", F.lit("model_contradicted"), yes))
    out = out.when((F.size(others) == 1) & ~many, told_as(F.get(others, 0), "medium", F.lit("settings"), no))
    return out.otherwise(told_as(nothing, "low", F.when(brand.isNotNull(), "brand_only").otherwise("none"), many | (F.size(others) > 1), brand))


def identify_printer(connector: Column, detected: Column, reported: Column, brand: Column) -> Column:
    """(key, brand, label, method): the family its connector is for, else what its detected or reported model names, else its brand alone."""
    ways = [(F.when(connector.isin(*[f.key for f in FAMILIES]), connector), "connector"), (family_of(detected), "detected_model"), (family_of(reported), "reported_model")]
    nothing = F.lit(None).cast("string")
    out = F.struct(nothing.alias("key"), brand.alias("brand"), nothing.alias("label"), nothing.alias("method"))
    for key, method in reversed(ways):
        out = F.when(key.isNotNull(), F.struct(key.alias("key"), of_family(key, "brand").alias("brand"), of_family(key, "label").alias("label"), F.lit(method).alias("method"))).otherwise(out)
    return out


def fits(file_family: Column, file_brand: Column, file_confidence: Column, printer_family: Column, printer_brand: Column, known: tuple[str, ...] | None = None) -> Column:
    """(status, confident): brand_mismatch of known brands first, then match or model_mismatch by family, else unknown."""
    sure = F.coalesce(file_confidence == "high", F.lit(False))
    item = lambda status, confident: F.struct(F.lit(status).alias("status"), confident.alias("confident"))
    is_known = F.lit(True) if known is None else printer_brand.isin(*known)
    out = F.when(is_known & (file_brand != printer_brand), item("brand_mismatch", F.lit(True)))
    return out.when(file_family == printer_family, item("match", sure)).when(file_family != printer_family, item("model_mismatch", sure)).otherwise(item("unknown", F.lit(False)))


def _short_names(f: Family) -> list[str]:
    """Runs of neighbouring words of a label without its brand, written together."""
    label = f.label.lower()
    words = [w for w in re.split(r"[\s_-]+", label.removeprefix(f.brand.lower())) if w]
    return sorted({"".join(words[a:b]) for a in range(len(words)) for b in range(a + 1, len(words) + 1)})


def families_like(name: Column) -> Column:
    """Families that a short name such as ``K1C`` or ``5M Pro`` means; a name needs a letter and a digit."""
    compact = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]", "")
    found = F.array_compact(F.array(*[F.when(compact.isin(*_short_names(f)), F.lit(f.key)) for f in FAMILIES]))
    return F.when(compact.rlike("[a-z]") & compact.rlike("[0-9]"), found).otherwise(F.array().cast("array<string>"))
