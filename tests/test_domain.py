"""Titles, text expressions, ordered folds, queues, extraction, archives, links."""

import base64
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.functions import codes, identity, text, titles
from lodestone.operators import actions, manifest, queue, search, temporal
from lodestone.sources import files, gcode, storage
from lodestone.streaming import status


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("3x Lampion (2h05m, 4.10$, 88g).gcode", "lampion"),
        ("[AB] Paper Crane_PETG_1h20m.gcode.3mf", "paper crane"),
        ("Tea Light (Gold-Black).stl", "tea light"),
        ("Tea Light (spare, 12g (2)).stl", "tea light spare"),
        ("Crate - Plate 2 @215.gcode", "crate"),
        ("Fox - red-white-black.3mf", "fox"),
        ("Gear 7_4h10m_PLA.gcode", "gear 7"),
        ("Owl R12g B7g.gcode", "owl"),
        ("x4 bracket.stl", "bracket"),
        ("", ""),
    ],
)
def test_titles(name, want):
    assert titles.normalise(name)["normalized"] == want


def test_title_records_and_display(spark):
    found = titles.normalise("Nora Lind Heron (2 Colors (Teal), 9h30m).3mf", ("Nora Lind",))
    assert ("designer", "Nora Lind") in found["removed"] and found["normalized"].startswith("heron")
    row = titles.with_titles(spark.createDataFrame([("2x PaperKite (1h11m, 52g).gcode",)], "name string"), "name").first().title
    assert (row.display, row.normalized, row.generic_score) == ("PaperKite", "paperkite", 0.0)
    assert titles.display_noise_only(titles.normalise("3x The Plate 1 (12g).gcode")) == "The Plate 1"
    assert titles.normalise("plate stand")["generic_score"] == 1.0


def test_text_expressions(spark):
    c = F.col("v")
    assert one(spark, text.duration_seconds(c), v="1d 2h 3m 4.5s") == 93785
    assert one(spark, text.duration_seconds(c), v="none") is None
    assert one(spark, text.norm_hex(c), v="#a1b") == "#AA11BB"
    assert one(spark, text.norm_hex(c), v="a1b2c3ff") == "#A1B2C3"
    assert one(spark, text.norm_hex(c), v="xyz") is None
    assert one(spark, text.config_key(c), v="; a_key = x = y") == "a_key"
    assert one(spark, text.config_value(c), v="; a_key = x = y") == "x = y"
    assert one(spark, text.generator_name(c), v="Snapmaker Orca 2.1.1") == "Snapmaker Orca"
    assert one(spark, text.generator_version(c), v="Creality_Print V7.0") == "7.0"
    assert one(spark, text.object_name(c), v="My_Part.stl_id_0_copy_2") == "my part"
    assert one(spark, text.object_instance(c), v="p_id_3_copy_1") == "3:1"
    assert one(spark, text.words(text.camel_split(c)), v="TinyTREX2 héLlo") == ["tiny", "trex2", "hé", "llo"]
    assert one(spark, text.search_forms(c), v="t rex toy") == ["rex", "toy", "trex", "trextoy", "rextoy"]
    assert one(spark, text.safe_segment(c), v='a<b>:"c. ') == "a_b___c"
    assert one(spark, text.safe_segment(c), v="con.txt") == "_con.txt"
    assert one(spark, text.file_role(c), v="x.gcode.3mf") == "sliced"
    assert one(spark, text.layer_count(c), v=";LAYER_COUNT:42") == 42
    assert one(spark, text.printed_stats(c)[0], v="; estimated printing time (normal mode) = 1h 2m") == 3720
    assert one(spark, text.firmware_parts(c)[1], v="Model_V1.2.3_x.bin") == "1.2.3"


def test_code_expressions(spark):
    c = F.col("v")
    assert one(spark, codes.error_code(c), v=0x0300_8004) == "0300-8004"
    assert one(spark, codes.high16(c), v=0x12345_8004) == 0x12345 and one(spark, codes.error_code(c), v=0x12345_8004) == "1234-8004"
    assert one(spark, codes.bit_set(c, F.lit(5)), v="20") is True
    assert one(spark, codes.bit_set(c, F.lit(70)), v="20") is False
    assert one(spark, codes.ip_text(codes.ip_number(c)), v="10.1.2.255") == "10.1.2.255"
    assert one(spark, codes.mask_length(c), v="255.255.252.0") == 22
    assert len(one(spark, codes.network_hosts(codes.ip_number(c), F.lit(29)), v="10.0.0.9")) == 6
    assert one(spark, codes.version_key(F.lit("1.10")) > codes.version_key(c), v="1.9.9") is None
    assert one(spark, codes.version_key(F.lit("1.0.0-beta.10")) > codes.version_key(c), v="1.0.0-beta.2") is True
    assert one(spark, codes.version_key(F.lit("1.0.0-beta")) < codes.version_key(c), v="v1.0.0-beta.2+b7") is True
    assert one(spark, codes.version_key(F.lit("1.0.0")) > codes.version_key(c), v="1.0.0-beta") is True
    assert one(spark, codes.floor_percentile(c, 0.9), v=[5, 1, 4, 2, 3]) == 5
    assert one(spark, codes.duration_text(c), v=7380) == "2h 3m"
    assert one(spark, codes.picture_kind(c), v=bytearray(b"\x89PNG\r\n\x1a\n0000")) == "png"
    assert one(spark, codes.ratio_suspect(c, F.lit(1.0)), v=9.0) is True


def test_identity(spark):
    got = one(spark, identity.identify_file(F.col("m"), F.col("s"), F.lit(""), F.lit("")), m="Creality K1C", s="0.20mm P2S")
    assert (got.family, got.confidence, got.method, got.conflict) == ("creality-k1c", "medium", "model_contradicted", True)
    assert one(spark, identity.family_of(F.col("m")), m="K1C or P2S") is None
    assert one(spark, identity.fits(F.lit(None).cast("string"), F.lit("Creality"), F.lit("high"), F.lit("bambu-p2s"), F.col("b")), b="Bambu Lab").status == "brand_mismatch"


def test_search_needs_every_word_or_the_join(spark):
    docs = spark.createDataFrame([(1, "TinyTREX toy"), (2, "t rex"), (3, "Café table"), (4, "trex")], "id int, name string")
    posts = search.postings(docs, "id", F.col("name"))
    ids = lambda q: sorted(r.id for r in search.search(posts, "id", q).collect())
    assert ids("tiny to") == [1] and ids("t rex") == [1, 2, 4] and ids("cafe") == [3] and ids("") == []


def test_debounce_equals_a_plain_loop(spark):
    values = [20.0, 20.5, 20.5, 20.9, 20.5, 25.0, 25.4, 24.9, 24.9, None]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "p int, i int, v double")
    got = [r.shown for r in temporal.debounced(rows, "p", ["i"], "v").orderBy("i").collect()]
    assert got == [20.0, 20.0, 20.5, 20.5, 20.5, 25.0, 25.0, 25.0, 24.9, 24.9]


def test_jobs_fold(spark):
    day = 86_400_000
    rows = [(1, 0, "print-started", "p", "a.gcode", None), (2, 10, "print-started", "p", "b.gcode", None), (3, 20, "print-completed", "p", "b.gcode", 9.0), (4, 30, "print-error", "p", "c.gcode", 1.0),
            (5, 40, "queue-print-started", "p", "d.gcode", None), (6, 0, "print-started", "q", "x.gcode", None), (7, 4 * day, "print-completed", "q", "other.gcode", 2.0), (8, 5, "print-started", "r", "y.gcode", None)]
    got = {r.job_key: (r.started_at, r.ended_at, r.outcome) for r in temporal.jobs(spark.createDataFrame(rows, "id bigint, ts bigint, event string, printer_id string, file string, elapsed_sec double"), day).collect()}
    assert got == {"audit:1": (0, None, "unknown"), "audit:2": (10, 20, "completed"), "audit:4": (None, 30, "failed"), "audit:5": (40, None, "printing"), "audit:6": (0, None, "unknown"), "audit:7": (None, 4 * day, "completed"), "audit:8": (5, None, "printing")}


def test_reports_merge_and_reset():
    old = {"a": 1, "ams": [{"id": 1, "t": 2, "c": "x"}, {"id": 2}], "n": {"x": 1}, "l": [1, 2]}
    new = {"ams": [{"id": 1, "t": 3}, {"id": 2, "t": 5}, {"id": 3}], "n": {"y": 2}, "l": [3]}
    assert status.merged(old, new) == {"a": 1, "ams": [{"id": 1, "t": 3, "c": "x"}, {"id": 2, "t": 5}, {"id": 3}], "n": {"x": 1, "y": 2}, "l": [3]}
    assert status.merged(old, {"ams": [{"id": 1}]})["ams"][0] == {"id": 1}


def test_balance(spark):
    rows = [("g", "p1", "x", True, []), ("g", "p2", "x", False, ["i1", "i2"]), ("g", "p3", "x", False, ["i3"]), ("g", "p4", "y", True, []), ("g", "p5", "x", True, [])]
    got = queue.balanced(spark.createDataFrame(rows, "pool string, printer_id string, connector string, idle boolean, queue array<string>")).collect()
    assert [(r["item"], r.from_printer, r.to_printer) for r in got] == [("i1", "p2", "p1"), ("i2", "p2", "p5")]


GCODE = "; generated by OrcaSlicer 2.4.2 on x\n; thumbnail begin 4x4 8\n; {pic}\n; thumbnail end\nEXCLUDE_OBJECT_DEFINE NAME=Lid.stl_id_0_copy_0\nEXCLUDE_OBJECT_DEFINE NAME=Lid.stl_id_0_copy_1\nT0\nG1 X1 Y2\nT2\n; filament_colour = #ff0000;00f\n; filament_type = PLA;PETG\n; filament used [g] = 1.5 g, 2.25\n; estimated printing time (normal mode) = 1h 30m\n; printer_model = Bambu X1C\n"


def test_gcode(spark):
    source = GCODE.replace("{pic}", base64.b64encode(b"\x89PNG1234").decode())
    rows = spark.createDataFrame([("f", bytearray(source.encode())), ("e", bytearray(b""))], "path string, content binary")
    got = {r.path: r for r in gcode.with_facts(rows).collect()}
    f = got["f"]
    assert (f.generator, f.est_seconds, f.weight_g, f.copies, f.tools, f.printer_model) == ("OrcaSlicer 2.4.2", 5400, 3.75, 2, [0, 2], "Bambu X1C")
    assert [(o.name_norm, o.copies) for o in f.objects] == [("lid", 2)] and len(f.pictures) == 1 and got["e"].objects == []
    found = gcode.settings(spark.createDataFrame([("f", source.replace("g, 2.25", "g; 2.25"))], "path string, text string"), "path", "text")
    assert [(r.slot, r.hex, r.type, r.used_g) for r in gcode.palette(found, "path").orderBy("slot").collect()] == [(0, "#FF0000", "PLA", 1.5), (1, "#0000FF", "PETG", 2.25)]
    assert gcode.window_needs(b"; png begin 4*4\n", b"x") == (True, True)
    assert gcode.window_needs(b"; thumbnail_JPG begin 4x4 9\n; thumbnail_JPG end\nG1 F9 X-3\n", b"; printer_model=x\n") == (False, False)
    assert gcode.picture_mark("; thumbnail begin 300 200 5") == ("begin", 300, 200) and gcode.picture_mark("; begin") is None


def test_windows_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "HEAD", 64)
    monkeypatch.setattr(files, "TAIL", 32)
    monkeypatch.setattr(files, "MOST", 256)
    body = "; thumbnail begin 4x4 9\n" + "; " + "A" * 150 + "\n; thumbnail end\nG1 X1 Y2\n" + "G1 X2\n" * 60 + "; printer_model = Own\n"
    (tmp_path / "a.gcode").write_text(body)
    (tmp_path / "b.gcode").write_text("G1 X1\n")
    rows = [(f"file://{tmp_path}/{n}.gcode", (tmp_path / f"{n}.gcode").stat().st_size) for n in "ab"]
    # The sizes are read when a window is, so they are tried in this process.
    head, tail, grew = files.read_window(*rows[0])
    assert grew == ["head:256"] and head.decode() == body[:256] and tail.decode() == body[-32:]
    got = {r.path: r for r in files.windows(spark.createDataFrame(rows, "path string, size bigint")).collect()}
    assert got[rows[1][0]]["head"] == b"G1 X1\n" and got[rows[1][0]].tail is None and got[rows[0][0]].grew == []


def test_documents_and_event_log(spark, tmp_path):
    folder = f"{tmp_path}/doc"
    assert storage.document(spark, folder, "a int").count() == 0
    for n in range(3):
        storage.write_document(spark.createDataFrame([(n,)], "a int"), folder)
    assert [r.a for r in storage.document(spark, folder, "a int").collect()] == [2]
    (tmp_path / "doc" / "v000000000009").mkdir()  # a write that did not end
    assert [r.a for r in storage.document(spark, folder, "a int").collect()] == [2]
    events = spark.createDataFrame([(1, "x"), (2, "y")], "id int, what string")
    for _ in range(2):
        storage.append_events(events, f"{tmp_path}/log", F.lit("2024-01-01"))
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4


def test_bulk_changes_are_whole(spark):
    queues = spark.createDataFrame([("a", "idle", ["x"]), ("b", "dispatching", ["y"]), ("c", "idle", [])], "printer_id string, state string, queue array<string>")
    ok = spark.createDataFrame([("a", ["z"]), ("c", ["w"])], "printer_id string, queue array<string>")
    assert {r.printer_id: r.queue for r in queue.bulk_applied(queues, ok).collect()} == {"a": ["z"], "b": ["y"], "c": ["w"]}
    no = spark.createDataFrame([("a", ["z"]), ("b", ["w"])], "printer_id string, queue array<string>")
    assert {r.printer_id: r.queue for r in queue.bulk_applied(queues, no).collect()} == {"a": ["x"], "b": ["y"], "c": []}



def test_files_and_fingerprints(spark, tmp_path):
    for name in ("a.stl", ".hidden", "b.tmp", "sub/c.gcode.3mf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode() * 3)
    found = files.listing(spark, str(tmp_path))
    assert sorted((r.name, r.role) for r in found.collect()) == [("a.stl", "source"), ("c.gcode.3mf", "sliced")]
    assert files.find_files(found, "C.G").count() == 1
    content = spark.read.format("binaryFile").load(str(tmp_path / "a.stl")).select("path", "content")
    row = files.with_fingerprints(content).first()
    assert len(row.quick_fp) == 32 and row.quick_fp == files.fingerprint(b"a.stl" * 3) != files.fingerprint(b"a.stl" * 4)


def test_manifest(spark):
    now = F.lit(100 * 86_400_000)
    known = spark.createDataFrame([("a", "present", 99 * 86_400_000), ("b", "present", 95 * 86_400_000), ("c", "missing", 1)], "rel_path string, state string, last_seen bigint")
    seen = spark.createDataFrame([("a",)], "rel_path string")
    assert {r.rel_path: r.state for r in manifest.after_scan(known, seen, True, now).collect()} == {"a": "present", "b": "missing"}
    assert manifest.after_scan(known, seen, False, now).count() == 3
    assert one(spark, manifest.identical(F.col("s"), F.lit(3), F.array(F.lit("h")), F.lit(None).cast("array<string>")), s=3) is False
    remote = spark.createDataFrame([("p", "f1", 1, 1.0), ("p", "f2", 2, 1.0)], "printer string, path string, size int, modified double")
    synced = spark.createDataFrame([("p", "f1", 1, 1.0, "synced", True)], "printer string, path string, remoteSize int, remoteModified double, status string, local_verified boolean")
    assert [r.path for r in manifest.to_download(remote, synced, ["printer", "path"]).collect()] == ["f2"]
    assert [r.path for r in manifest.may_delete(remote, synced, ["printer", "path"], F.lit(2.0)).collect()] == ["f1"]


def test_decisions_links_and_stats(spark):
    log = spark.createDataFrame([(1, "s", "r", None, 10), (2, "s", "r", None, 11), (3, "s", "r", 5, 12)], "id int, subject_key string, relation string, withdrawn_at int, action_id int")
    assert {r.id: r.superseded_by for r in actions.superseded(log).collect()} == {1: 2, 2: None, 3: None}
    acts = spark.createDataFrame([(10, False), (11, False), (12, True)], "id int, undone boolean")
    assert {r.id: r.undoable for r in actions.undoable(acts, log.select("action_id", "subject_key")).collect()} == {10: False, 11: True, 12: False}
    assert actions.undone(log, 11, 99).where("withdrawn_at = 99").count() == 1
    fs = spark.createDataFrame([("k1", "h1", "r", "a", 1, 5.0, "A.gcode", "present", False), ("k2", None, "r", "b", 2, 5.0, "b.gcode", "present", False), ("k3", None, "r", "c", 2, 5.0, "same", "present", False), ("k4", None, "r", "d", 2, 5.0, "same", "present", False)], "content_key string, sha256 string, root_id string, rel_path string, size int, mtime_ms double, name string, state string, generic boolean")
    ps = spark.createDataFrame([(1, "h1", None, None, 0, 0.0, "x"), (2, None, "r", "b", 2, 5.5, "x"), (3, None, None, None, 0, 0.0, "a.GCODE"), (4, None, None, None, 0, 0.0, "same"), (5, None, None, None, 0, 0.0, "no")], "id int, sha256 string, root_id string, rel_path string, size int, mtime_ms double, name string")
    assert {r.id: (r.content_key, r.method, r.confidence) for r in actions.linked_prints(ps, fs).collect()} == {1: ("k1", "sha256", "exact"), 2: ("k2", "location", "high"), 3: ("k1", "name", "medium"), 4: (None, "name", "low"), 5: (None, "none", "none")}
    links = spark.createDataFrame([("m", "exact", False, 1), ("m", "medium", False, 2), ("n", "low", True, 3), ("n", "low", False, 9)], "model_id string, confidence string, by_decision boolean, ended_at int")
    full = actions.print_stats(links)
    assert {r.model_id: (r.n, r.confirmed, r.by_name, r["last"]) for r in full.collect()} == {"m": (2, 1, 1, 2), "n": (1, 1, 0, 3)}
    touched = spark.createDataFrame([("n",)], "model_id string")
    assert sorted(actions.refreshed_stats(full, links, touched).collect()) == sorted(full.collect())


def test_small_operators(spark, tmp_path):
    diff = actions.settings_diff(spark.createDataFrame([("a", "1"), ("key", "s")], "name string, value string"), spark.createDataFrame([("a", "2"), ("b", "x")], "name string, value string"), ["b"], F.col("name") == "key")
    assert {tuple(r) for r in diff.collect()} == {("a", "1", "2"), ("key", "•••", None)}
    assert actions.nearest_colour(spark.createDataFrame([("#FE0101",)], "h string"), "h", [("red", "#FF0000"), ("blue", "#0000FF")]).first().colour == "red"
    slots = spark.createDataFrame([("p", 1, "PLA"), ("p", 3, "PETG"), ("p", 99, "x")], "k string, slot int, material string")
    assert actions.tray_list(slots, "k").first().trays == ["PLA", None, "PETG"]
    boxes = spark.createDataFrame([("p", [("", [("X", "000000")]), ("s1", [("PLA", "0ff00ff")])])], "k string, boxes array<struct<serial:string,materials:array<struct<type:string,color:string>>>>")
    assert [(r.material, r.hex) for r in actions.decoded_boxes(boxes, "k").collect()] == [("PLA", "#FF00FF")]
    sick = spark.createDataFrame([("p", True, 95, None, False)], "printer_id string, throttled boolean, disk_percent int, fault string, fan_flagged boolean")
    assert sorted(r.issue for r in actions.health(sick).collect()) == ["disk", "throttled"]
    (tmp_path / "b.json").write_text('{"a": 1}')
    assert storage.read_document(spark, str(tmp_path / "none.json"), str(tmp_path / "b.json")).first().a == 1


def test_contained_finds_short_and_cut_items(spark):
    texts = ["The quick brown fox jumps over the lazy dog and then it sleeps all day long", "a quick brown cat", "brown", "", "Unrelated words, of no use here at all to anyone who is looking"]
    needles = ["quick brown", "ick brown fox jumps over the lazy dog and then it sle", "brown", "row", "lazy dog", ", of no", "quick brown fox jumps over the lazy dog", "nothing", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    items = spark.createDataFrame(list(enumerate(needles)), "item_id int, text string")
    want = {(i, d, sum(n.lower() in t.lower() for t in texts) == 1) for i, n in enumerate(needles) if n is not None for d, t in enumerate(texts) if n.lower() in t.lower()}
    from lodestone.operators import search

    got = [tuple(r) for r in search.contained(items, docs, "item_id", "doc_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
