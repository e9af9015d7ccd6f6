"""Searching and summing up a fleet of printers, and nested settings as rows."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .browse import top_within

# Where a family of hues ends, in degrees; red also begins at 345.
HUES = (("red", 15), ("orange", 45), ("yellow", 70), ("green", 165), ("cyan", 195), ("blue", 250), ("violet", 290), ("magenta", 345), ("red", 361))
NAMES = ("white", "black", "grey", *dict.fromkeys(n for n, _ in HUES))


def colour_family(code: Column) -> Column:
    """The one family of a #RRGGBB colour: white, black or grey if it has little hue, else by hue; null for other texts."""
    r, g, b = (F.conv(F.substring(code, i, 2), 16, 10).cast("double") / 255 for i in (2, 4, 6))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    spread, light = top - low, (top + low) / 2
    full = F.when((light > 0) & (light < 1), spread / (1 - F.abs(2 * light - 1))).otherwise(0.0)
    hue = F.when(top == r, (g - b) / spread % 6).when(top == g, (b - r) / spread + 2).otherwise((r - g) / spread + 4) * 60
    hue = F.when(hue < 0, hue + 360).otherwise(hue)
    plain = (spread == 0) | (full < 0.12) | (light < 0.08) | (light > 0.95)
    out = F.when(~code.rlike("^#[0-9A-Fa-f]{6}$"), None).when(plain & (light > 0.85), "white").when(plain & (light < 0.15), "black").when(plain, "grey")
    for name, end in HUES:
        out = out.when(hue <= end, name)
    return out


def fleet_search(printers: DataFrame, text: str) -> DataFrame:
    """Printers that a query finds: name, brand, online, state, progress, heads array<struct<hex>>.

    ``>40%`` compares progress of those online; ``@white,black`` asks for a head
    of its own for each colour, an unknown colour finds nothing; a colour's name
    finds heads of its family as well as names; other words are looked for in
    name, brand and status. A colour has one family, so counting the heads of
    each is an exact assignment.
    """
    text = text.strip().lower()
    families = F.transform("heads", lambda h: colour_family(h["hex"]))
    held = lambda family: F.size(F.filter(families, lambda f: f == family))
    percent = re.fullmatch(r"([<>])\s*(\d+)\s*%", text)
    if percent:
        bound, at = int(percent[2]) / 100, F.col("progress")
        return printers.where(F.col("online") & ((at > bound) if percent[1] == ">" else (at < bound)))
    if text.startswith("@"):
        wanted = [w.strip() for w in text[1:].split(",") if w.strip()]
        found = F.lit(bool(wanted) and all(w in NAMES for w in wanted))
        for w in sorted(set(wanted)):
            found = found & (held(w) >= wanted.count(w))
        return printers.where(found)
    status = F.when(F.col("online"), F.col("state")).otherwise("offline")
    found = F.contains(F.lower(F.concat_ws(" ", "name", "brand", status)), F.lit(text))
    if text in NAMES:
        found = found | F.array_contains(families, text)
    return printers.where(found)


def snapshot(printers: DataFrame, status: DataFrame, queues: DataFrame) -> DataFrame:
    """One row a printer with its latest status and queue; printers that never reported go."""
    last = status.groupBy("printer_id").agg(F.max_by(F.struct("state", "progress"), "ts").alias("s"))
    return printers.join(last, "printer_id").join(queues, "printer_id", "left").select("printer_id", "name", "s.state", "s.progress", F.coalesce("waiting", F.lit(0)).alias("waiting"))


def flattened(rows: DataFrame, key: str, document: str) -> DataFrame:
    """(key, name, value) of a JSON document's leaves under dotted names."""

    def leaves(value, name=""):
        if isinstance(value, dict):
            for k, v in value.items():
                yield from leaves(v, f"{name}.{k}" if name else k)
        else:
            yield name, value if isinstance(value, str) else json.dumps(value)

    def run(frames):
        for frame in frames:
            out = [(k, n, v) for k, text in zip(frame["k"], frame["d"], strict=True) for n, v in leaves(json.loads(text or "{}"))]
            yield pd.DataFrame(out, columns=["k", "name", "value"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("k"), F.col(document).alias("d")).mapInPandas(run, f"k {kind}, name string, value string").withColumnRenamed("k", key)


def covers(candidates: DataFrame) -> DataFrame:
    """(model_id, picture): a person's choice, then a project's picture, a plate's, an image file; ties to the smallest.

    candidates: model_id, kind, picture.
    """
    rank = F.when(F.col("kind") == "chosen", 0).when(F.col("kind") == "project", 1).when(F.col("kind") == "plate", 2).otherwise(3)
    return candidates.groupBy("model_id").agg(F.min_by("picture", F.struct(rank, "picture")).alias("picture"))


def model_page(model: DataFrame, files: DataFrame, prints: DataFrame, latest: int = 20) -> DataFrame:
    """One row a model with its files and latest prints as nested lists."""
    own = files.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("rel_path", "role", "state"))).alias("files"))
    last = top_within(prints, ["model_id"], [F.desc("ended_at"), F.desc("outcome")], latest)
    rows = last.groupBy("model_id").agg(F.sort_array(F.collect_list(F.struct("ended_at", "outcome")), asc=False).alias("prints"))
    return model.join(own, "model_id", "left").join(rows, "model_id", "left")
