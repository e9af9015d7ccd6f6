"""Tables of archives: their directories, their entries' hashes, and the facts of 3MF projects.

Files are read by ranges where they lie, or from a column that holds them. What
cannot be read comes out as a row with its error.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from xml.parsers import expat

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .zipped import Archive, ArchiveError, Entry

# Entries that are read, by what they hold, and how large they may be.
MODEL, SETTINGS, PARTS, SLICED = "3D/3dmodel.model", "Metadata/project_settings.config", "Metadata/model_settings.config", "Metadata/slice_info.config"
SLIC3R = "Metadata/Slic3r_PE.config"
COVER = "Auxiliaries/.thumbnails/thumbnail_3mf.png"
PLATE_ENTRY = re.compile(r"Metadata/plate_(\d+)(\.gcode|\.png|_small\.png)")
SETTINGS_MOST, MD5_MOST, PICTURE_MOST, ADDED_PICTURE_MOST = 16 << 20, 1024, 2 << 20, 300 << 10
_JSON = json.JSONEncoder(separators=(",", ":"), check_circular=False)
PICTURE_NAME, MD5 = re.compile(r"\.(png|jpe?g|webp|gif)$", re.I), re.compile("[0-9a-f]{32}")
MESH_NAME = re.compile(r"\.(stl|obj|step|stp|3mf|amf|ply)$", re.I)


def _opened(row: tuple) -> Archive:
    path, size, content = row
    if content is not None:
        return Archive.of(bytes(content))
    if size is None:
        raise ArchiveError("no content")
    system, place = FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else FileSystem.from_uri("file://" + path)
    file = system.open_input_file(place)
    return Archive(lambda at, n: file.read_at(n, at), int(size))


def _table(files: DataFrame, key: str, content: str | None, of: Callable[[Archive], list[dict]], schema: str) -> DataFrame:
    """The rows that ``of`` makes of each archive beside the key; ``error`` alone where it cannot be read.

    Contents go to Python by the hundred (a plain UDF's batch), not by the ten
    thousand of an Arrow batch, so what a task holds does not grow with its rows.
    If a plain UDF makes them, both run in one go and contents stay in the worker,
    for which this one may have no argument but them.
    Rows come back as one text, which takes less of either side than nested rows one by one.
    """

    def run(data: bytes | None, path=None, size: int | None = None) -> str:
        archive = None
        try:
            archive = _opened((path, size, data))
            rows = of(archive)
        except (ValueError, OSError) as error:
            rows = [{"error": str(error)}]
        read = archive.bytes_read if archive else 0
        for row in rows:
            row["bytes_read"] = read
        return _JSON.encode(rows)

    place = [F.col(key), F.col("size").cast("bigint")] if "size" in files.columns else []
    told = F.udf(run, "string", useArrow=False)(F.col(content) if content else F.lit(None).cast("binary"), *place)
    rows = F.from_json("told", f"array<struct<{schema}, bytes_read bigint>>", {"maxStringLen": str((1 << 31) - 1)})
    # The texts are a column of their own, as what explode is given is not run together with what makes the contents.
    return files.select(F.col(key), told.alias("told")).select(F.col(key), F.explode(rows).alias("told")).select(key, "told.*")


def directories(files: DataFrame, key: str = "path", content: str | None = None) -> DataFrame:
    """(key, name, size, packed, crc, method, encrypted, zip64, error, bytes_read): every entry of every archive, from its directory alone.

    files: path and size, whose bytes are read by ranges, or a column with the
    content. An empty archive gives no row, one that cannot be read one with
    ``error``. ``bytes_read`` is what its archive took so far.
    """
    of = lambda archive: [e._asdict() | {"error": None} for e in archive.entries.values() if not e.is_folder]
    return _table(files, key, content, of, "name string, size bigint, packed bigint, crc bigint, method int, encrypted boolean, zip64 boolean, error string")


def _hashed(archive: Archive, wanted: re.Pattern | None) -> list[dict]:
    rows = []
    for e in archive.entries.values():
        if not e.is_folder and (wanted is None or wanted.search(e.name)):
            made, error = hashlib.sha256(), None
            try:
                for chunk in archive.chunks(e):
                    made.update(chunk)
            except ArchiveError as problem:
                error = str(problem)
            rows.append({"name": e.name, "size": e.size, "crc": e.crc, "sha256": None if error else made.hexdigest(), "error": error})
    return rows


def with_entries(files: DataFrame, key: str = "path", content: str | None = "content", wanted: str | None = None) -> DataFrame:
    """(key, name, size, crc, sha256, error, bytes_read) of every entry, inflated in chunks whatever its size; an entry that cannot be read has only its error.

    wanted: a regular expression; entries in whose names it is not found give no row and are not read.
    """
    names = re.compile(wanted) if wanted is not None else None
    return _table(files, key, content, lambda archive: _hashed(archive, names), "name string, size bigint, crc bigint, sha256 string, error string")


class _Enough(Exception):
    """The rest of an entry, even of a chunk, is not wanted."""


class _Xml:
    """Feeds an entry's chunks to a parser whose handlers are called as elements begin and end; stops where one raises ``_Enough``."""

    def __init__(self, begin: Callable[[str, dict], None], end: Callable[[str], None], text: Callable[[str], None] | None = None):
        parser = self.parser = expat.ParserCreate()
        parser.StartElementHandler, parser.EndElementHandler = begin, end
        if text:
            parser.buffer_text = True
            parser.CharacterDataHandler = text

    def feed(self, chunks: Iterator[bytes]) -> None:
        try:
            for chunk in chunks:
                self.parser.Parse(chunk, False)
            self.parser.Parse(b"", True)
        except _Enough:
            pass


def _model_facts() -> tuple[dict, _Xml]:
    """A project's own metadata, which stands before its meshes: reading ends where these begin."""
    facts: dict[str, str] = {}
    path: list[str] = []
    held: list[str] = []
    of = ""

    def begin(name: str, attributes: dict) -> None:
        nonlocal of
        if name == "resources":  # nothing after it is wanted
            raise _Enough
        path.append(name)
        held.clear()
        if name == "metadata":
            of = attributes.get("name", "")

    def end(name: str) -> None:
        if name == "metadata" and of:
            facts[of] = "".join(held).strip()
        path.pop()
        held.clear()

    return facts, _Xml(begin, end, lambda text: held.append(text) if path and path[-1] == "metadata" else None)


def _parts_facts() -> tuple[dict, _Xml]:
    """Objects with their parts, and plates with the objects on them."""
    objects: list[dict] = []
    plates: list[dict] = []
    lists = {"object": objects, "plate": plates}
    owners = frozenset(("object", "plate", "part", "model_instance"))
    inside: list[str] = []  # the open ones of the owners
    takes: list[dict | None] = []  # what takes their metadata

    def begin(name: str, attributes: dict) -> None:
        if name == "metadata":
            if takes and (to := takes[-1]) is not None and "key" in attributes:
                to.setdefault(attributes["key"], attributes.get("value"))
        elif name in owners:
            inside.append(name)
            if name in lists:
                lists[name].append({"id": attributes.get("id"), "meta": {}, "part": [], "model_instance": []})
            elif name == "part" and "object" in inside:
                objects[-1]["part"].append({})
            elif name == "model_instance" and "plate" in inside:
                plates[-1]["model_instance"].append({})
            holders = objects if "object" in inside else plates
            if name in lists:
                takes.append(holders[-1]["meta"])
            else:
                takes.append(holders[-1][name][-1] if holders and holders[-1][name] else None)

    def end(name: str) -> None:
        if name in owners:
            inside.pop()
            takes.pop()

    return {"objects": objects, "plates": plates}, _Xml(begin, end)


def _sliced_facts() -> tuple[dict, _Xml]:
    """What the slicer tells of each plate that it sliced."""
    plates: list[dict] = []
    facts: dict = {"plates": plates, "client": None}
    opened = 0  # plates that are open

    def begin(name: str, attributes: dict) -> None:
        nonlocal opened
        if name == "plate":
            plates.append({"meta": {}, "filament": [], "object": []})
            opened += 1
        elif name == "header_item":
            if attributes.get("key") == "X-BBL-Client-Version":
                facts["client"] = attributes.get("value") or None
        elif not opened:
            pass
        elif name == "metadata":
            if "key" in attributes:
                plates[-1]["meta"][attributes["key"]] = attributes.get("value")
        elif name in ("filament", "object"):
            plates[-1][name].append(attributes)

    def end(name: str) -> None:
        nonlocal opened
        if name == "plate":
            opened -= 1

    return facts, _Xml(begin, end)


def flavour(application: str | None, names: set[str], printer: str | None) -> tuple[str, str]:
    """What wrote a project, and by what that is told: the application that it names, the form of its version, or a file."""
    app = (application or "").strip().lower()
    if re.match(r"orca\s*slicer", app):
        return "orca", "application"
    for word, kind in (("snapmaker", "snapmaker_orca"), ("creality", "creality"), ("prusa", "prusa"), ("slic3r", "prusa")):
        if word in app:
            return kind, "application"
    if SLIC3R in names:
        return "prusa", "application" if app else "slic3r_config"
    own = re.match(r"bambu\s*studio-(.+)$", app)
    if not own:
        return "other", "unrecognised_application" if app else "no_application"
    if re.fullmatch(r"\d\d(\.\d\d){3}", own[1]):
        return "bambu", "application_version_form"
    if re.fullmatch(r"\d+\.\d+\.\d+", own[1]) and "snapmaker" in (printer or "").lower():
        return "snapmaker_orca", "bambu_name_three_part_version+snapmaker_printer"
    return "other", "bambu_name_unknown_fork"


def picture_kind(data: bytes) -> str | None:
    """The kind of a picture by its first bytes."""
    for kind, begins in (("image/png", data.startswith(b"\x89PNG")), ("image/jpeg", data.startswith(b"\xff\xd8")), ("image/webp", data[:4] == b"RIFF" and data[8:12] == b"WEBP"), ("image/gif", data.startswith(b"GIF"))):
        if begins:
            return kind
    return None


def _number(value) -> float | None:
    if value is None:
        return None
    try:
        return float(value[0] if isinstance(value, list) else value)
    except (TypeError, ValueError, IndexError):
        return None


def _is_added(name: str) -> bool:
    """Whether a person put it into the project: no cached picture of the program's."""
    return name.startswith("Auxiliaries/") and "/." not in name


class _Reader:
    """Entries of one project, with what went wrong in ``problems``."""

    def __init__(self, archive: Archive):
        self.archive, self.problems = archive, []

    def bytes_of(self, name: str, most: int) -> bytes | None:
        if name not in self.archive.entries:
            return None
        try:
            return self.archive.read(name, most)
        except ArchiveError as error:
            self.problems.append({"entry": name, "error": str(error)})
            return None

    def facts(self, name: str, told: tuple[dict, _Xml], most: int | None = None) -> dict:
        """What a parser finds in an entry; up to the fault in one that is broken."""
        entry: Entry | None = self.archive.entries.get(name)
        facts, parser = told
        if entry is not None:
            try:
                if most is not None and entry.size > most:
                    raise ArchiveError(f"{entry.size} bytes are more than {most}")
                # One whose reading ends early may be larger than what is read of others.
                parser.feed(self.archive.chunks(entry, None if most is not None else entry.size))
            except (ArchiveError, expat.ExpatError) as error:
                self.problems.append({"entry": name, "error": str(error)})
        return facts


def project(archive: Archive) -> dict:
    """Facts of a 3MF project; what is missing or broken is left out, the latter with a row in ``problems``."""
    reader, names = _Reader(archive), {n for n, e in archive.entries.items() if not e.is_folder}
    model = reader.facts(MODEL, _model_facts())
    parts = reader.facts(PARTS, _parts_facts(), SETTINGS_MOST)
    sliced = reader.facts(SLICED, _sliced_facts(), SETTINGS_MOST)
    settings = {}
    try:
        if held := reader.bytes_of(SETTINGS, SETTINGS_MOST):
            settings = json.loads(held)
    except ValueError as error:
        reader.problems.append({"entry": SETTINGS, "error": f"not JSON: {error}"})
    settings = settings if isinstance(settings, dict) else {}
    text = lambda key: str(settings[key]) if settings.get(key) else None
    kind, basis = flavour(model.get("Application"), names, text("printer_model"))
    named = {o["id"]: o["meta"].get("name") for o in parts["objects"]}
    on_plate = {int(p["meta"]["plater_id"]): p for p in parts["plates"] if (p["meta"].get("plater_id") or "").isdigit()}
    told = {int(p["meta"]["index"]): p for p in sliced["plates"] if (p["meta"].get("index") or "").isdigit()}
    numbers = set(on_plate) | set(told) | {int(m[1]) for n in names if (m := PLATE_ENTRY.fullmatch(n))}
    plates = [_plate(reader, number, on_plate.get(number), told.get(number), named) for number in sorted(numbers)]
    copies: dict[str, int] = {}
    for p in parts["plates"]:
        for i in p["model_instance"]:
            copies[i.get("object_id")] = copies.get(i.get("object_id"), 0) + 1
    objects, sources, meshes = [], {}, {}  # distinct ones in the order of their first mention
    for o in parts["objects"]:
        pieces = {}
        for p in o["part"]:
            if name := p.get("name"):
                pieces[name] = None
                if MESH_NAME.search(name):
                    meshes[name] = None
            if source := p.get("source_file"):
                sources[source] = None
        objects.append({"id": o["id"], "name": o["meta"].get("name"), "copies": copies.get(o["id"], 0), "parts": list(pieces)})
    cover = next((p["picture"] for p in plates if p["picture"]), None)
    if cover is None and COVER in names and picture_kind(reader.bytes_of(COVER, PICTURE_MOST) or b""):
        cover = COVER
    return {
        "flavour": kind, "flavour_basis": basis, "application": model.get("Application") or None, "client_version": sliced["client"],
        "title": model.get("Title") or None, "designer": model.get("Designer") or None, "license": model.get("License") or None, "design_model_id": model.get("DesignModelId") or None,
        "printer_model": text("printer_model"), "layer_height": _number(settings.get("layer_height")),
        "objects": objects, "source_files": list(sources), "mesh_names": list(meshes),
        "plates": plates, "cover": cover, "auxiliaries": [_added(reader, archive.entries[n]) for n in sorted(names) if _is_added(n)], "problems": reader.problems, "error": None,
    }


def _plate(reader: _Reader, number: int, laid: dict | None, told: dict | None, named: dict) -> dict:
    entries = reader.archive.entries
    at = f"Metadata/plate_{number}"
    gcode = entries.get(f"{at}.gcode")
    md5 = (reader.bytes_of(f"{at}.gcode.md5", MD5_MOST) or b"").decode("latin-1").strip().lower()
    picture = next((n for n in (f"{at}_small.png", f"{at}.png") if n in entries and entries[n].size <= PICTURE_MOST), None)
    if picture and not picture_kind(reader.bytes_of(picture, PICTURE_MOST) or b""):
        picture = None
    meta = told["meta"] if told else {}
    seconds = _number(meta.get("prediction"))
    return {
        "plate_no": number, "name": (laid["meta"].get("plater_name") or None) if laid else None, "sliced": gcode is not None,
        "objects": [name for i in laid["model_instance"] if (name := named.get(i.get("object_id")))] if laid else [],
        "sliced_objects": [o["name"] for o in told["object"] if o.get("name")] if told else [],
        "seconds": None if seconds is None else int(seconds), "weight_g": _number(meta.get("weight")),
        "gcode_md5": md5 if md5 and MD5.fullmatch(md5) else None, "gcode_size": gcode.size if gcode else None, "picture": picture,
        "filaments": [_filament(f) for f in told["filament"]] if told else [],
    }


def _filament(f: dict) -> dict:
    return {"i": int(_number(f.get("id")) or 0) or None, "type": f.get("type"), "hex": (f.get("color") or "")[:7].upper() or None, "g": _number(f.get("used_g")), "m": _number(f.get("used_m"))}


def _added(reader: _Reader, entry: Entry) -> dict:
    is_small_picture = entry.size <= ADDED_PICTURE_MOST and PICTURE_NAME.search(entry.name)
    data = reader.bytes_of(entry.name, ADDED_PICTURE_MOST) if is_small_picture else None
    return {"entry": entry.name, "name": entry.name.rsplit("/", 1)[-1], "size": entry.size, "crc": entry.crc, "picture": picture_kind(data) if data else None}


_SCHEMA = (
    "flavour string, flavour_basis string, application string, client_version string, title string, designer string, license string, design_model_id string, printer_model string, layer_height double, "
    "objects array<struct<id:string,name:string,copies:int,parts:array<string>>>, source_files array<string>, mesh_names array<string>, "
    "plates array<struct<plate_no:int,name:string,sliced:boolean,objects:array<string>,sliced_objects:array<string>,seconds:bigint,weight_g:double,gcode_md5:string,gcode_size:bigint,picture:string,"
    "filaments:array<struct<i:int,type:string,hex:string,g:double,m:double>>>>, "
    "cover string, auxiliaries array<struct<entry:string,name:string,size:bigint,crc:bigint,picture:string>>, problems array<struct<entry:string,error:string>>, error string"
)


def with_projects(files: DataFrame, key: str = "path", content: str | None = "content") -> DataFrame:
    """(key, facts..., error, bytes_read) of 3MF files; one that cannot be read has only ``error``.

    Meshes are never read: the model's metadata come first, and reading stops
    there. Entries that are broken or too large are named in ``problems``.
    """
    return _table(files, key, content, lambda archive: [project(archive)], _SCHEMA)
