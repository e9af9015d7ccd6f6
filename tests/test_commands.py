"""Commands: what is refused, what each does, rounds over shared subjects, undoing, a batch sent twice."""

import pytest

from lodestone.operators import commands
from lodestone.operators.commands import COMMAND, SCHEMAS
from lodestone.sources.commits import Tables


def command(id_, kind, model=None, other=None, review=None, files=None, name=None, auto=None, plate=None, keep=None):
    return (id_, kind, model, other, review, files, name, auto, plate, keep)


@pytest.fixture
def state(spark):
    facts = [(m, "name", f"Model {m}") for m in "ABCDEFG"] + [("G", "merged_into", "A"), ("A", "designer", "ann"), ("B", "designer", "bob"), ("B", "notes", "mind"), ("B", "cover_source", "user"), ("B", "cover_content_key", "b2"), ("A", "cover_plate", "3")]
    files = [(f"{m.lower()}{i}", None, m, ("sliced", "project")[i - 1], f"{m}{i}.gcode", i == 2, [1, 2] if i == 2 else None) for m in "ABCDEF" for i in (1, 2)] + [("a9", None, "A", "image", "a.png", True, None), ("in", "b2", "B", "source", "x.stl", False, None)]
    decisions = [("old", 1, "file", "b1", "member_of", "affirm", "B", None, None), ("apart", 1, "model", "B", "distinct_from", "affirm", "C", None, None), ("ab", 1, "model", "A", "distinct_from", "affirm", "B", None, None), ("gone", 1, "file", "c1", "hidden", "affirm", None, None, 1)]
    reviews = [(1, "suggested_match", "A", "B", "open", None), (2, "suggested_match", "C", "D", "open", None), (3, "ambiguous_grouping", "E", None, "open", None), (4, "suggested_match", "E", "F", "resolved", 1)]
    labels = [("A", "t:x"), ("B", "t:x"), ("B", "c:y")]
    given = {"facts": facts, "files": files, "decisions": decisions, "reviews": reviews, "labels": labels}
    return commands.fresh(**{n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in given.items()})


def rows(spark, *given):
    return spark.createDataFrame(list(given), COMMAND)


def test_refusals(spark, state):
    cases = [
        ("unknown_action", command(0, "burn", "A")), ("model_not_found", command(0, "hide", "Z")), ("model_merged", command(0, "hide", "G")), ("model_merged", command(0, "merge", "A", "G")),
        ("same_model", command(0, "merge", "A", "A")), ("review_not_found", command(0, "dismiss", review=9)), ("review_resolved", command(0, "reject", review=4)), ("wrong_review_kind", command(0, "reject", review=3)),
        ("bad_survivor", command(0, "approve", "F", review=1)), ("no_files", command(0, "move", "A", "B")), ("structural", command(0, "move", "A", "B", files=["a2#1"])), ("structural", command(0, "move", "B", "A", files=["in"])),
        ("stale_file", command(0, "move", "A", "B", files=["a1", "c1"])), ("not_model_file", command(0, "split", "A", files=["a9"])), ("wrong_review_kind", command(0, "move", "A", "B", files=["a1"], review=1)), ("not_hidden", command(0, "unhide_file", "C", files=["c1"])),
        ("name_required", command(0, "rename", "A", name=" \t ")), ("name_too_long", command(0, "rename", "A", name="x" * 121)), (None, command(0, "rename", "A", name=" " + "x" * 120)), ("stale_cover", command(0, "cover", "A", files=["a1"])),
        (None, command(0, "cover", "A", files=["a9"])), (None, command(0, "cover", "A", files=["a2"], plate=2)), ("stale_cover", command(0, "cover", "A", files=["a2"], plate=3)), ("stale_variant", command(0, "set_printer", "A", files=["a2"])),
        ("unknown_family", command(0, "set_printer", "A", files=["a1"], name="toaster")), ("not_set", command(0, "set_printer", "A", files=["a1"])), (None, command(0, "set_printer", "A", files=["a2"], plate=1, name="snapmaker-u1")), (None, command(0, "dismiss", review=1)),
    ]
    given = rows(spark, *[(n, *c[1:]) for n, (_, c) in enumerate(cases)])
    assert {r.id: r.refused for r in commands.judged(given, state).collect()} == {n: why for n, (why, _) in enumerate(cases)}


def test_commands_in_rounds_and_undone(spark, state, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/t")
    commands.create(tables, state)
    batch = rows(
        spark,
        command(10, "approve", "A", review=1, keep=["name", "cover"]),
        command(11, "reject", review=2),
        command(12, "split", "E", files=["e2"]),
        command(13, "rename", "A", name="  New \n name "),
        command(14, "hide", "B"),
        command(15, "set_printer", "F", files=["f1"], name="snapmaker-u1"),
        command(16, "set_printer", "F", files=["f1"], name="flashforge-5m"),
        command(17, "move", "F", "D", files=["f2"]),
    )
    told = {r.id: r.refused for r in commands.apply(tables, batch).collect()}
    assert told == {10: None, 11: None, 12: None, 13: None, 14: "model_merged", 15: None, 16: None, 17: None}
    s = commands.read(tables)
    facts = {(r.model, r.field): r.value for r in s.facts.collect()}
    assert facts["A", "name"] == "New name" and facts["A", "designer"] == "ann" and facts["A", "notes"] == "mind" and facts["A", "cover_content_key"] == "b2" and ("A", "cover_plate") not in facts
    assert facts["B", "merged_into"] == "A" and facts["split-12", "name"] == "E2"
    places = {r.content_key: r.model for r in s.files.collect()}
    assert (places["b1"], places["b2"], places["in"], places["e2"], places["e1"], places["f2"]) == ("A", "A", "A", "split-12", "E", "D")
    found = {r.id: (r.superseded_by, r.withdrawn_by) for r in s.decisions.collect()}
    assert found["old"] == (10, None) and found["ab"] == (10, None) and found["apart"] == (None, None)
    assert found["10/distinct_from/affirm/A/C"] == (None, None) and found["11/distinct_from/affirm/C/D"] == (None, None)
    assert found["12/member_of/affirm/e2/split-12"] == (None, None) and found["12/member_of/reject/e2/E"] == (None, None)
    assert found["15/targets_printer/affirm/f1/snapmaker-u1"] == (16, None) and found["16/targets_printer/affirm/f1/flashforge-5m"] == (None, None)
    assert {(r.id, r.status, r.resolved_by) for r in s.reviews.collect()} == {(1, "resolved", 10), (2, "resolved", 11), (3, "open", None), (4, "resolved", 1)}
    assert {(r.model, r.label) for r in s.labels.where("model = 'A'").collect()} == {("A", "t:x"), ("A", "c:y")}
    versions = sorted(tmp_path.joinpath("t").iterdir())
    assert {r.id: r.refused for r in commands.apply(tables, batch).collect()} == told  # sent again: nothing runs
    assert sorted(tmp_path.joinpath("t").iterdir()) == versions
    assert {r.id: r.undoable for r in commands.history(s, "A").collect()} == {13: True, 10: False}

    undos = spark.createDataFrame([(20, 10), (21, 13), (22, 12), (23, 15), (24, 99), (25, 17)], "id bigint, action bigint")
    assert {r.id: r.refused for r in commands.undo(tables, undos).collect()} == {20: "undo_blocked", 21: None, 22: None, 23: "undo_blocked", 24: "action_not_found", 25: None}
    again = spark.createDataFrame([(30, 10), (31, 13)], "id bigint, action bigint")
    assert {r.id: r.refused for r in commands.undo(tables, again).collect()} == {30: None, 31: "already_undone"}
    s = commands.read(tables)
    facts = {(r.model, r.field): r.value for r in s.facts.collect()}
    was = {(r.model, r.field): r.value for r in state.facts.collect()}
    assert {k: v for k, v in facts.items() if k[0] != "split-12"} == was
    assert facts["split-12", "merged_into"] == "E"
    assert {r.content_key: r.model for r in s.files.collect()} == {r.content_key: r.model for r in state.files.collect()}
    assert {(r.model, r.label) for r in s.labels.collect()} == {(r.model, r.label) for r in state.labels.collect()}
    found = {r.id: (r.superseded_by, r.withdrawn_by) for r in s.decisions.collect()}
    assert found["old"] == found["ab"] == (None, None) and found["10/distinct_from/affirm/A/C"] == (None, 30) and found["12/member_of/affirm/e2/split-12"] == (None, 22)
    assert {r.id: r.status for r in s.reviews.collect()} == {1: "open", 2: "resolved", 3: "open", 4: "resolved"}
    assert commands.judged(rows(spark).limit(0), s).count() == 0
