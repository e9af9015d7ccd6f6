"""Ranged archive reading and the facts of projects."""

import io
import struct
import zipfile
import zlib

import pytest

from lodestone.functions import titles
from lodestone.operators import prints
from lodestone.plans import projects
from lodestone.sources import archives, files, zipped
from lodestone.sources.zipped import Archive, ArchiveError


def packed(entries, method=zipfile.ZIP_DEFLATED, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in entries.items():
            z.writestr(name, data)
        z.comment = comment
    return out.getvalue()


MODEL = '<?xml version="1.0"?><model xmlns:p="x"><metadata name="Title">A &amp; B</metadata><metadata name="Application">{app}</metadata><resources>{mesh}</resources></model>'
PARTS = (
    '<config><object id="2"><metadata key="name" value="lid"/><part id="1"><metadata key="name" value="lid top.STL"/><metadata key="source_file" value="c:/lid.step"/></part><part id="3"><metadata key="name" value="text"/></part></object>'
    '<object id="5"><metadata key="name" value="box"/></object>'
    '<plate><metadata key="plater_id" value="1"/><metadata key="plater_name" value="both"/><model_instance><metadata key="object_id" value="2"/></model_instance><model_instance><metadata key="object_id" value="2"/></model_instance>'
    '<model_instance><metadata key="object_id" value="5"/></model_instance></plate></config>'
)
SLICED = '<config><header><header_item key="X-BBL-Client-Version" value="02.06"/></header><plate><metadata key="index" value="1"/><metadata key="prediction" value="60"/><metadata key="weight" value="2.5"/><object name="lid" skipped="false"/><filament id="1" type="PLA" color="#00ff00FF" used_g="2.5" used_m="1"/></plate></config>'


def test_projects(spark):
    md5 = "0123456789ABCDEF0123456789abcdef"
    whole = packed({
        "3D/3dmodel.model": MODEL.format(app="BambuStudio-02.06.00.51", mesh="<vertex/>" * 100_000), "Metadata/model_settings.config": PARTS, "Metadata/slice_info.config": SLICED,
        "Metadata/project_settings.config": '{"printer_model": "P1", "layer_height": ["0.2"]}', "Metadata/plate_1.gcode": "G1", "Metadata/plate_1.gcode.md5": md5 + "\n", "Metadata/plate_1.png": b"\x89PNG\r\n\x1a\n", "Metadata/plate_2.gcode.md5": "ABC",
        "Metadata/plate_2_small.png": b"no picture", "Auxiliaries/Pictures/a.jpg": b"\xff\xd8\xff", "Auxiliaries/guide.pdf": b"%PDF", "Auxiliaries/.thumbnails/x.png": b"x", "Auxiliaries/": b"",
    })
    broken = packed({"3D/3dmodel.model": "<model><metadata name='Title'>kept</metadata><oops", "Metadata/project_settings.config": "{", "Metadata/slice_info.config": "<config><plate></config>"})
    rows = spark.createDataFrame([("p", bytearray(whole)), ("half", bytearray(broken)), ("bad", bytearray(b"nozip")), ("none", None)], "path string, content binary")
    got = {r.path: r for r in archives.with_projects(rows).collect()}
    p = got["p"]
    assert (p.title, p.flavour, p.flavour_basis, p.client_version, p.printer_model, p.layer_height) == ("A & B", "bambu", "application_version_form", "02.06", "P1", 0.2)
    assert [(o.name, o.copies, o.parts) for o in p.objects] == [("lid", 2, ["lid top.STL", "text"]), ("box", 1, [])]
    assert (p.source_files, p.mesh_names, p.cover, p.problems) == (["c:/lid.step"], ["lid top.STL"], "Metadata/plate_1.png", [])
    one, two = p.plates
    assert (one.plate_no, one.name, one.sliced, one.objects, one.sliced_objects, one.seconds, one.weight_g, one.gcode_md5, one.gcode_size) == (1, "both", True, ["lid", "lid", "box"], ["lid"], 60, 2.5, md5.lower(), 2)
    assert one.filaments[0].asDict() == {"i": 1, "type": "PLA", "hex": "#00FF00", "g": 2.5, "m": 1.0} and (two.plate_no, two.sliced, two.picture, two.gcode_md5) == (2, False, None, None)
    assert [(a.name, a.picture) for a in p.auxiliaries] == [("a.jpg", "image/jpeg"), ("guide.pdf", None)]
    half = got["half"]
    assert half.title == "kept" and sorted(x.entry for x in half.problems) == ["3D/3dmodel.model", "Metadata/project_settings.config", "Metadata/slice_info.config"] and half.error is None
    assert got["bad"].error and got["none"].error and got["bad"].title is None


@pytest.mark.parametrize("app, printer, names, want", [
    ("OrcaSlicer-2.1", None, set(), "orca"), ("CrealityPrint-5", None, set(), "creality"), ("Snapmaker Orca", None, set(), "snapmaker_orca"), ("PrusaSlicer-2.7", None, set(), "prusa"), (None, None, {"Metadata/Slic3r_PE.config"}, "prusa"),
    ("BambuStudio-2.3.5", "Snapmaker U1", set(), "snapmaker_orca"), ("BambuStudio-2.3.5", "P1", set(), "other"), ("Cura", None, set(), "other"), (None, None, set(), "other"),
])
def test_flavours(app, printer, names, want):
    assert archives.flavour(app, names, printer)[0] == want


def test_ranged_reads_take_a_small_part_of_a_file(spark, tmp_path):
    mesh = "".join(f'<vertex x="{i * 7919 % 9973}" y="{i * 31 % 977}"/>' for i in range(200_000))
    (tmp_path / "big.3mf").write_bytes(packed({"3D/3dmodel.model": MODEL.format(app="", mesh=mesh), "Metadata/plate_1.gcode": mesh, "Metadata/model_settings.config": PARTS}))
    (tmp_path / "cut.3mf").write_bytes(packed({"a": "x" * 1000})[:-30])
    listed = files.listing(spark, f"file://{tmp_path}")
    got = {r.path.rsplit("/", 1)[1]: r for r in archives.with_projects(listed, content=None).collect()}
    size = (tmp_path / "big.3mf").stat().st_size
    assert size > 1_500_000 and got["big.3mf"].title == "A & B" and got["big.3mf"].plates[0].gcode_size == len(mesh)
    assert got["big.3mf"].bytes_read < 0.15 * size  # the tail that may hold a comment, the directory, and what is wanted
    assert got["cut.3mf"].error and got["cut.3mf"].title is None
    names = [r.name for r in archives.directories(listed, content=None).orderBy("path", "name").collect()]
    assert names == ["3D/3dmodel.model", "Metadata/model_settings.config", "Metadata/plate_1.gcode", None]


def test_entries_of_any_size_are_hashed_and_faults_are_rows(spark):
    good, zeros = packed({"é/a.txt": "hello", "zeros": b"\0" * 70_000_000}), None
    flipped = bytearray(packed({"a": b"abcdef" * 100, "b": b"fine"}, zipfile.ZIP_STORED))
    flipped[40] ^= 1
    rows = spark.createDataFrame([("good", bytearray(good)), ("flipped", flipped), ("bad", bytearray(b"PK"))], "path string, content binary")
    got = {(r.path, r.name): r for r in archives.with_entries(rows).collect()}
    assert got["good", "zeros"].size == 70_000_000 and got["good", "zeros"].sha256 and got["good", "é/a.txt"].error is None
    assert "checksum" in got["flipped", "a"].error and got["flipped", "a"].sha256 is None and got["flipped", "b"].sha256
    assert got["bad", None].error and zeros is None


def test_zip64_comments_unicode_paths_and_descriptors():
    with_comment = packed({"a": b"x"}, comment=b"PK\x05\x06 in a comment")
    assert Archive.of(with_comment).read("a", 9) == b"x"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z, z.open("big", "w", force_zip64=True) as e:
        e.write(b"12345")
    assert Archive.of(out.getvalue()).read("big", 9) == b"12345"

    class Pipe(io.BytesIO):  # cannot go back, so sizes follow the data
        def seekable(self):
            return False

        def tell(self):
            raise OSError

    out = Pipe()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("late", b"sizes come after")
    assert Archive.of(out.getvalue()).read("late", 99) == b"sizes come after"
    # all three full fields, their values in a zip64 field; and a second name, trusted for the raw name that it was made for
    raw, real = b"n", "naïve".encode()
    for crc, want in ((zlib.crc32(raw), "naïve"), (1, "n")):
        longs = struct.pack("<HHQQQ", 1, 24, 3, 3, 0)
        path = struct.pack("<HHBI", 0x7075, 5 + len(real), 1, crc) + real
        local = struct.pack("<4s5H3I2H", b"PK\3\4", 20, 0, 0, 0, 0, zlib.crc32(b"abc"), 3, 3, 1, 0) + raw + b"abc"
        listed = struct.pack("<4s6H3I5H2I", b"PK\1\2", 20, 20, 0, 0, 0, 0, zlib.crc32(b"abc"), 0xFFFFFFFF, 0xFFFFFFFF, 1, len(longs + path), 0, 0, 0, 0, 0xFFFFFFFF) + raw + longs + path
        end64 = struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(listed), len(local))
        at64 = struct.pack("<4sIQI", b"PK\6\7", 0, len(local) + len(listed), 1)
        data = local + listed + end64 + at64 + struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
        archive = Archive.of(data)
        assert list(archive.entries) == [want] and archive.entries[want].zip64 and archive.read(want, 9) == b"abc"


def test_hostile_archives_raise_one_kind_of_error():
    whole = packed({"a": b"abc" * 1000, "b": b"d"})
    for n in range(0, len(whole)):
        with pytest.raises(ArchiveError):
            Archive.of(whole[:n])
    for k in range(len(whole)):
        for bit in (0, 3, 7):
            data = bytearray(whole)
            data[k] ^= 1 << bit
            try:
                archive = Archive.of(bytes(data))
                for name in archive.entries:
                    assert len(archive.read(name, 10_000)) <= 10_000
            except ArchiveError:
                pass
    bomb = bytearray(packed({"z": b"\0" * 10_000_000}))
    at = bytes(bomb).index(zipped.LISTED) + 24
    bomb[at : at + 4] = (100).to_bytes(4, "little")  # claims 100 bytes
    archive, made = Archive.of(bytes(bomb)), 0
    with pytest.raises(ArchiveError, match="claims"):
        for chunk in archive.chunks(archive.entries["z"]):
            made += len(chunk)
    assert made <= zipped.CHUNK
    with pytest.raises(ArchiveError):
        Archive.of(whole).read("a", 10)


@pytest.mark.parametrize("name, score", [("Stand v2", 0.5), ("Calibration", 1.0), ("Box Lid top", 0.0), ("the", 1.0), ("Test on head", 1.0), ("single red cube", 0.67)])
def test_generic_scores(name, score):
    assert titles.normalise(name)["generic_score"] == score


@pytest.mark.parametrize("name, want", [
    ("Dragon (FR10-12).stl", "dragon"), ("Dragon (fr10-12).stl", "dragon fr10-12"), ("((((((((((deep (9g)))))))))))) x.stl", "deep x"), ("a" + "".join(f" ({i}g)" for i in range(1, 12)) + " b", "a b"),
    ("[CP] TinyTREX_PLA_3h55m.gcode.3mf", "tinytrex"), ("Cat WHT 418g, GRD 156g", "cat"), ("4xx fox", "fox"), ("Owl_9h22m.gcode", "owl"), ("Vase @ 190", "vase"),
])
def test_titles_of_every_rule(name, want):
    assert titles.normalise(name)["normalized"] == want


def test_contents_go_to_python_in_small_batches(spark):
    files = spark.range(3000, numPartitions=1).selectExpr("id", "unhex('504B') AS content")
    found = archives.with_entries(files, "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "InArrow" not in plan and "ArrowEval" not in plan  # those take 10,000 contents at once
    assert found.where("error IS NOT NULL AND bytes_read = 0").count() == 3000


@pytest.mark.parametrize("method", [zipped.STORED, zipped.DEFLATED])
def test_archives_that_are_made_are_read_by_others(method):
    entries = {"a": b"", "é/b.gcode": b"G1 X1\n", "c": b"<x/>" * 1024, "d": bytes(range(256)) * 17, "e": b"<vertex/>" * 20_000}
    made = zipped.archive([zipped.packed(n, d, method) for n, d in entries.items()])
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        assert z.testzip() is None and {i.filename: z.read(i) for i in z.infolist()} == entries and all(i.compress_type == method for i in z.infolist())
    own = Archive.of(made)
    assert {n: own.read(n, 1 << 20) for n in own.entries} == entries


def test_no_byte_is_left_in_the_inflater():
    for n in [*range(1000, 1300), *range(3000, 3400), *range(65_536, 66_000)]:
        held = Archive.of(packed({"a": b"\0" * n}))
        assert sum(map(len, held.chunks(held.entries["a"], n))) == n and len(held.read("a", n)) == n


def test_projects_are_made_and_read_in_one_go_by_as_many_tasks_as_shuffles_have(spark, tmp_path):
    spark.range(100).selectExpr("id AS o_orderkey", "'1-URGENT' AS o_orderpriority", "'F' AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(300).selectExpr("id % 100 AS l_orderkey", "id AS l_partkey", "CAST(id AS INT) AS l_linenumber", "2.0D AS l_quantity", "'R' AS l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    for query, rows in ((projects.project_facts, 100), (projects.archive_entries, 2 + 98 * 3)):
        found = query(spark, str(tmp_path))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("+- BatchEvalPython") == 1 and "MapInPandas" not in plan  # contents stay in the worker
        assert "REPARTITION_BY_NUM" in plan  # and tasks are not coalesced by the few bytes that they read
        assert found.count() == rows


def test_only_wanted_entries_are_read(spark, tmp_path):
    (tmp_path / "one.3mf").write_bytes(packed({"m.model": "<vertex/>" * 300_000, "a.gcode": "G1", "b.gcode.md5": "x", "é/c.gcode": "G2"}, zipfile.ZIP_STORED))
    (tmp_path / "none.3mf").write_bytes(packed({"m.model": "x"}))
    (tmp_path / "cut.3mf").write_bytes(packed({"a.gcode": "x" * 1000})[:-30])
    listed = files.listing(spark, f"file://{tmp_path}")
    every = archives.with_entries(listed, content=None)
    some = archives.with_entries(listed, content=None, wanted=r"\.gcode\Z").drop("bytes_read").orderBy("path", "name").collect()
    assert some == every.where("name LIKE '%.gcode' OR name IS NULL").drop("bytes_read").orderBy("path", "name").collect() and [r.name for r in some] == [None, "a.gcode", "é/c.gcode"]
    read = lambda found: found.agg({"bytes_read": "max"}).first()[0]
    assert read(every) > 2_700_000 and read(archives.with_entries(listed, content=None, wanted=r"\.gcode\Z")) < 100_000


def test_tasks_that_make_projects_grow_with_the_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prints, "MOST_ROWS", 50)
    spark.range(100).selectExpr("id AS o_orderkey", "'1-URGENT' AS o_orderpriority", "'F' AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(450).selectExpr("id % 100 AS l_orderkey", "id AS l_partkey", "CAST(id AS INT) AS l_linenumber", "2.0D AS l_quantity", "'A' AS l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = projects.project_facts(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) < 9 and ", 9), REPARTITION_BY_NUM" in plan and found.where("plates IN (4, 5)").count() == 98
