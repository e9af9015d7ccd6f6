"""Hashing by ranged reads, commits of several tables, re-keying, protected names."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import membership, rekey
from lodestone.sources import files, gcode, hashing
from lodestone.sources.commits import Tables


def listed(spark, folder):
    return files.listing(spark, f"file://{folder}").withColumn("modified_ms", hashing.listed_ms(F.col("modified")))


def test_pass_hashes_smallest_first_within_its_budget_and_carries_on(spark, tmp_path):
    for n in (10, 200_000, 70_000, 1):
        (tmp_path / f"{n}.stl").write_bytes(os.urandom(n))
    seen = listed(spark, tmp_path).persist()
    first = hashing.hash_pass(seen, most=100_000).persist()
    assert {r.path.rsplit("/", 1)[1] for r in first.collect()} == {"1.stl", "10.stl", "70000.stl"}
    rest = hashing.hash_pass(seen, first).collect()
    assert [r.size for r in rest] == [200_000]
    for r in [*first.collect(), *rest]:
        data = (tmp_path / r.path.rsplit("/", 1)[1]).read_bytes()
        assert (r.outcome, r.sha256, r.md5) == ("hashed", hashlib.sha256(data).hexdigest(), hashlib.md5(data).hexdigest())
        assert r.quick_fp == files.fingerprint(data)
    assert hashing.hash_pass(seen, first.unionByName(spark.createDataFrame(rest, first.schema))).count() == 0
    quick = hashing.hash_pass(seen, full=False).where("size = 200000").first()
    assert quick.sha256 is None and quick.quick_fp == rest[0].quick_fp


def test_nothing_is_told_of_files_that_change_or_go(spark, tmp_path):
    for name in ("during", "before", "gone", "calm"):
        (tmp_path / f"{name}.stl").write_bytes(b"x" * 5000)
    seen = listed(spark, tmp_path).persist()
    seen.count()
    (tmp_path / "before.stl").write_bytes(b"y" * 5001)
    (tmp_path / "gone.stl").unlink()

    def moment(place):
        if place.endswith("during.stl"):
            with open(place, "ab") as file:
                file.write(b"more")

    got = {r.path.rsplit("/", 1)[1]: r for r in hashing.hash_pass(seen, moment=moment).collect()}
    assert {n: r.outcome for n, r in got.items()} == {"during.stl": "changed", "before.stl": "changed", "gone.stl": "gone", "calm.stl": "hashed"}
    assert all(r.sha256 is None and r.quick_fp is None for n, r in got.items() if n != "calm.stl")


@pytest.mark.parametrize("size", [0, 1, 65_535, 65_536, 65_537, 131_073, 400_000])
def test_fingerprints_by_ranges_equal_those_of_whole_contents(size):
    data, reads = os.urandom(size), []

    def read_at(at, n):
        reads.append(n)
        return data[at : at + n]

    assert hashing.ranged_fingerprint(read_at, size) == files.fingerprint(data)
    assert sum(reads) <= 3 * hashing.WINDOW


def test_running_sums_over_ranges(spark):
    rows = spark.createDataFrame([(f"f{i}", (i * 37) % 100) for i in range(300)], "path string, size bigint")
    for most in (0, 1, 50, 777, 10**6):
        got = sorted((r.size, r.path) for r in hashing.within_budget(rows, most, ["size", "path"]).collect())
        want, total = [], 0
        for r in sorted((r.size, r.path) for r in rows.collect()):
            total += r[0]
            if total <= most:
                want.append(r)
        assert got == want


def test_a_commit_that_fails_changes_nothing(spark, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/t")
    rows = lambda *n: spark.createDataFrame([(i,) for i in n], "n int")
    tables.commit(a=rows(1), b=rows(2))
    broken = rows(3).select(F.raise_error(F.lit("no")).cast("int").alias("n"))
    with pytest.raises(Exception, match="no"):
        tables.commit(a=rows(9), b=broken)
    assert [tables.read(t).first().n for t in ("a", "b")] == [1, 2]
    tables.commit(b=rows(4), c=rows(5))
    assert [tables.read(t).first().n for t in tables.names()] == [1, 4, 5]
    assert len([p for p in (tmp_path / "t").iterdir() if p.name != "list"]) == 4  # three in force and the one before


FILES = "id bigint, size bigint, mtime_ms bigint, quick_fp string, content_key string, sha256 string"
CLAIMS = "subject_type string, subject_key string, relation string, object_type string, object_key string, automatic boolean, state string"


def test_rekeying_by_each_verdict(spark, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/t")
    own = [
        (1, 5, 1, "f1", "q:f1", None), (2, 5, 1, "f2", "q:f2", None), (3, 5, 1, "f2", "q:f2", None), (4, 5, 1, "f2", "q:f2", None), (5, 9, 1, "f5", "old5", None),
        (6, 9, 1, "f6", "s6", None), (7, 9, 1, "f7", "s7", "s7"), (8, 9, 1, "f8", "q:f8", None),
    ]
    claims = [
        ("file", "q:f1", "member_of", "model", "m", True, "applied"), ("variant", "q:f1#2", "targets_printer", "printer_family", "p", False, "applied"), ("file", "q:f2", "sliced_from", "file", "q:f1", True, "suggested"),
        ("file", "old5", "member_of", "model", "m", True, "applied"), ("file", "old5", "duplicate_of", "file", "x", False, "applied"), ("file", "s1", "member_of", "model", "m", True, "was there"), ("file", "z", "member_of", "model", "m", True, "applied"),
    ]
    table = spark.createDataFrame
    tables.commit(
        files=table(own, FILES), claims=table(claims, CLAIMS).withColumn("claim_key", rekey.claim_key()), content_aliases=table([("q:f5", "old5"), ("q:zz", "z")], "alias string, content_key string"),
        model_anchors=table([(1, "q:f1"), (1, "s1"), (2, "q:f2"), (3, "old5")], "model bigint, content_key string"), decisions=table([("q:f1#2", "p"), ("q:f2", "old5")], "subject_key string, object_key string"), prints=table([("q:f1",), ("q:f8",)], "content_key string"),
    )
    hashes = [(1, 5, 1, "f1", "s1"), (2, 5, 1, "f2", "s2"), (3, 5, 1, "f2", "s3"), (5, 9, 1, "f5", "s5"), (6, 9, 1, "f6", "s6"), (7, 9, 1, "f7", "s7"), (8, 9, 2, "f8", "s8")]
    arrived = table(hashes, "id bigint, size bigint, mtime_ms bigint, quick_fp string, sha256 string")
    assert {r.id: r.verdict for r in rekey.verdicts(tables.read("files"), arrived).collect()} == {1: "rekeyed", 2: "rekeyed", 3: "rekeyed", 5: "contradicted", 6: "confirmed", 7: "same", 8: "changed"}
    rekey.apply_hashes(tables, arrived)
    assert {r.id: r.content_key for r in tables.read("files").collect()} == {1: "s1", 2: "s2", 3: "s3", 4: "q:f2", 5: "s5", 6: "s6", 7: "s7", 8: "q:f8"}
    got = {(r.subject_key, r.relation, r.object_key): r.state for r in tables.read("claims").collect()}
    assert got[("s1", "member_of", "m")] == "was there" and got[("s1#2", "targets_printer", "p")] == "applied"
    assert {k for k in got if k[1] == "sliced_from"} == {("s2", "sliced_from", "s1"), ("s3", "sliced_from", "s1")}
    assert ("s5", "member_of", "m") in got and ("old5", "member_of", "m") not in got and ("old5", "duplicate_of", "x") in got and ("z", "member_of", "m") in got
    assert {(r.alias, r.content_key) for r in tables.read("content_aliases").collect()} == {("q:zz", "z"), ("q:f1", "s1"), ("q:f2", "s3")}
    assert {(r.model, r.content_key) for r in tables.read("model_anchors").collect()} == {(1, "s1"), (2, "q:f2"), (3, "old5")}  # a file still has q:f2, and what was decided stays with old5
    assert {(r.subject_key, r.object_key) for r in tables.read("decisions").collect()} == {("s1#2", "p"), ("q:f2", "old5")}
    assert {r.content_key for r in tables.read("prints").collect()} == {"s1", "q:f8"}


def test_protected_names_of_equal_sets_without_gathering(spark):
    rows = [("a", k) for k in "xyz"] + [("b", k) for k in "xyz"] + [("c", k) for k in "xy"] + [("d", "x")] + [("e", k) for k in "uv"] + [("a", "x"), (None, "x")]
    models = spark.createDataFrame([("x", 1), ("y", 2), ("z", 1), ("u", 3), ("v", 3)], "key string, model int")
    got = {tuple(r.terms): (r["keys"], r.models) for r in membership.protected_names(spark.createDataFrame(rows, "term string, key string"), models).collect()}
    assert got == {("a", "b"): (3, 2), ("c",): (2, 2)}


def test_copies_are_verified_by_windows(spark, tmp_path):
    data = bytearray(os.urandom(100_000))
    other = bytearray(data)
    other[50_000] ^= 1
    between = bytearray(data)
    between[30_000] ^= 1  # in no window
    for name, d in (("a", data), ("same", data), ("other", other), ("between", between), ("short", data[:-1]), ("empty", b"")):
        (tmp_path / name).write_bytes(d)
    path = lambda n: f"file://{tmp_path}/{n}"
    pairs = spark.createDataFrame([(path("a"), path(n)) for n in ("same", "other", "between", "short", "gone")] + [(path("empty"), path("empty"))], "a string, b string")
    got = {r.b.rsplit("/", 1)[1]: r for r in hashing.verified_copies(pairs, 4096, 5).collect()}
    assert {n: (r.ok, (r.reason or "").split(":")[0]) for n, r in got.items()} == {"same": (True, ""), "other": (False, "content"), "between": (True, ""), "short": (False, "size"), "gone": (False, "error"), "empty": (True, "")}
    assert got["other"].offset == hashing.spread_starts(100_000, 4096, 5)[2]


def test_used_slots_and_builds(spark):
    slots = spark.createDataFrame([("w", 0, 1.5), ("w", 1, 0.0), ("w", 2, None), ("t", 0, 0.0), ("t", 1, None), ("n", 0, None)], "path string, slot int, used_g double")
    facts = spark.createDataFrame([("w", [1, 2]), ("t", [1]), ("n", [])], "path string, tools array<int>")
    used = gcode.with_used(slots, facts, "path")
    assert {(r.path, r.slot) for r in used.where("used").collect()} == {("w", 0), ("t", 1)}
    assert {r.path: r.colors for r in gcode.used_colours(used, "path").collect()} == {"w": 1, "t": 1, "n": None}
    names = spark.createDataFrame([("U1_1.6.0.267_20260815150420_upgrade.bin",), ("x_1.2_1_upgrade.bin",), (None,)], "n string").select(text.firmware_build(F.col("n")).alias("b"), text.reported_version(F.col("n")).alias("v")).collect()
    assert names[0].b.asDict() == {"product": "U1", "version": "1.6.0.267", "build_time": "20260815150420", "build_id": "1.6.0.267_20260815150420"} and names[0].v == "U1"
    assert names[1].b.build_id is None and names[2].b.product is None and names[2].v is None
