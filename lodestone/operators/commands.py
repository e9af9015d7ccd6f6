"""What people do to a catalogue: commands checked against its state, their effects, and their undoing.

The state is seven tables:

* ``facts`` (model, field, value): authored facts of models; each model has a ``name``;
* ``files`` (content_key, container, model, role, name, pictured, plates): container is the key of the file that an entry lies in;
* ``decisions`` (id, action_id, subject_type, subject_key, relation, polarity, object_key, superseded_by, withdrawn_by);
* ``reviews`` (id, kind, model, other, status, resolved_by);
* ``labels`` (model, label);
* ``actions`` (id, kind, model, other, undone_by);
* ``changes`` (action_id, what, key, field, before, after): what undoing needs.

Nothing is deleted from decisions: they are superseded or withdrawn by an action. A command is id, kind, model, other,
review, files, name, auto, plate, keep: see ``COMMAND``. Commands that share a subject take effect by id, one a round;
all others of a round at once.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import FAMILIES
from ..sources.commits import Tables
from ..sources.storage import removed, written

COMMAND = "id bigint, kind string, model string, other string, review bigint, files array<string>, name string, auto boolean, plate int, keep array<string>"
SCHEMAS = {
    "facts": "model string, field string, value string",
    "files": "content_key string, container string, model string, role string, name string, pictured boolean, plates array<int>",
    "decisions": "id string, action_id bigint, subject_type string, subject_key string, relation string, polarity string, object_key string, superseded_by bigint, withdrawn_by bigint",
    "reviews": "id bigint, kind string, model string, other string, status string, resolved_by bigint",
    "labels": "model string, label string",
    "actions": "id bigint, kind string, model string, other string, undone_by bigint",
    "changes": "action_id bigint, what string, key string, field string, before string, after string",
}
#: Kinds of commands, roles of files that can be placed, facts that a merge fills in.
KINDS = ("merge", "approve", "reject", "dismiss", "move", "split", "hide", "unhide", "hide_file", "unhide_file", "rename", "cover", "set_printer")
ROLES = ("sliced", "project", "source")
FILLED = ("designer", "license", "source_url", "notes", "design_model_id")
NAME_MOST = 120
_COVER = ("cover_content_key", "cover_plate", "cover_source")
_ACTIVE = "superseded_by IS NULL AND withdrawn_by IS NULL"


@dataclass
class State:
    facts: DataFrame
    files: DataFrame
    decisions: DataFrame
    reviews: DataFrame
    labels: DataFrame
    actions: DataFrame
    changes: DataFrame


def fresh(facts: DataFrame, files: DataFrame, **others: DataFrame) -> State:
    """A state; tables that are not given are empty."""
    spark = facts.sparkSession
    return State(facts, files, **{n: others.get(n, spark.createDataFrame([], ddl)) for n, ddl in SCHEMAS.items() if n not in ("facts", "files")})


def _clean(name):
    return F.trim(F.regexp_replace(name, r"[\x00-\x1f\x7f\s]+", " "))


def _files_told(c: DataFrame, s: State) -> DataFrame:
    """(id, structural, stale, wrong_role, no_picture, no_variant, in_force array, first_name) over the files that each command names."""
    named = c.select("id", "kind", "a", "plate", F.col("files")[0].alias("_first"), F.explode(F.array_distinct("files")).alias("content_key"))
    here = (F.col("model") == F.col("a")) & F.col("container").isNull()
    mine = F.col("model") == F.col("a")
    on_plate = F.array_contains("plates", F.col("plate"))
    some = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    each = named.join(s.files, "content_key", "left").groupBy("id", "kind", "plate", "content_key", "_first").agg(
        F.coalesce(F.bool_and(F.col("container").isNotNull()) & (F.count("role") > 0), F.lit(False)).alias("_inner"),
        some(here).alias("_here"),
        some(here & F.col("role").isin(*ROLES)).alias("_role"),
        some(mine & F.when(F.col("plate").isNull(), F.col("pictured")).otherwise(on_plate)).alias("_picture"),
        some(mine & F.when(F.col("plate").isNull(), F.col("role") == "sliced").otherwise(on_plate)).alias("_variant"),
        F.min(F.when(F.col("content_key") == F.col("_first"), F.col("name"))).alias("_name"),
    )
    relation = F.when(F.col("kind") == "set_printer", "targets_printer").otherwise("hidden")
    each = each.withColumn("subject_key", F.concat_ws("#", "content_key", F.col("plate").cast("string"))).withColumn("relation", relation)
    now = s.decisions.where(f"relation IN ('hidden', 'targets_printer') AND {_ACTIVE}").select("subject_key", "relation", F.col("id").alias("_did"))
    return each.join(now, ["subject_key", "relation"], "left").groupBy("id").agg(
        F.bool_or(F.col("content_key").contains("#") | F.col("_inner")).alias("structural"),
        F.bool_or(~F.col("_here")).alias("stale"),
        F.bool_or(~F.col("_role")).alias("wrong_role"),
        F.bool_or(~F.col("_picture")).alias("no_picture"),
        F.bool_or(~F.col("_variant")).alias("no_variant"),
        F.collect_set(F.when(F.col("content_key") == F.col("_first"), F.col("_did"))).alias("in_force"),
        F.max("_name").alias("first_name"),
    )


def judged(commands: DataFrame, s: State) -> DataFrame:
    """Commands with ``a``, ``b`` (the models they are about) and ``refused``: why one does not apply to this state, null if it does."""
    kind = F.col("kind")
    asked = s.reviews.select(F.col("id").cast("string").alias("_review"), F.col("kind").alias("r_kind"), F.col("status").alias("r_status"), F.col("model").alias("r_x"), F.col("other").alias("r_y"))
    lost = F.when(F.col("model") == F.col("r_x"), F.col("r_y")).when(F.col("model") == F.col("r_y"), F.col("r_x"))
    a = F.when(kind == "approve", lost).when(kind.isin("reject", "dismiss"), F.col("r_x")).otherwise(F.col("model"))
    b = F.when(kind == "approve", F.col("model")).when(kind.isin("reject", "dismiss"), F.col("r_y")).when(kind == "split", F.concat(F.lit("split-"), F.col("id").cast("string"))).when(kind.isin("merge", "move"), F.col("other"))
    # Commands without a review or second model get a key of their own, so that these don't meet in one task.
    alone = F.concat(F.lit("\u0000"), F.col("id").cast("string"))
    c = commands.withColumn("_review", F.coalesce(F.col("review").cast("string"), alone)).join(asked, "_review", "left").withColumn("a", a).withColumn("b", b)
    models = s.facts.groupBy("model").agg(F.max(F.when(F.col("field") == "merged_into", F.col("value"))).alias("m"))
    for side in "ab":
        told = models.select(F.col("model").alias("_side"), F.lit(True).alias(f"{side}_there"), F.col("m").alias(f"{side}_merged"))
        c = c.withColumn("_side", F.coalesce(side, alone)).join(told, "_side", "left").drop("_side")
    c = c.join(_files_told(c, s), "id", "left")
    files_named = F.coalesce(F.size("files"), F.lit(0)) > 0
    by_file = kind.isin("move", "split", "hide_file", "unhide_file", "set_printer")
    two = kind.isin("merge", "approve", "reject", "move")
    review_of = F.when(kind == "move", F.col("r_kind") == "ambiguous_grouping").when(kind == "dismiss", True).otherwise(F.col("r_kind") == "suggested_match")
    auto, name, none_set = F.coalesce("auto", F.lit(False)), F.coalesce("name", F.lit("")), F.coalesce(F.size("in_force"), F.lit(0)) == 0
    rules = [
        ("unknown_action", ~kind.isin(*KINDS) | kind.isNull()),
        ("review_not_found", kind.isin("approve", "reject", "dismiss") & F.col("r_kind").isNull()),
        ("review_resolved", kind.isin("approve", "reject", "dismiss") & (F.col("r_status") != "open")),
        ("wrong_review_kind", kind.isin("approve", "reject") & ~review_of),
        ("bad_survivor", (kind == "approve") & F.col("a").isNull()),
        ("model_not_found", ((kind != "dismiss") & F.col("a_there").isNull()) | (two & F.col("b_there").isNull())),
        ("model_merged", ((kind != "dismiss") & F.col("a_merged").isNotNull()) | (two & F.col("b_merged").isNotNull())),
        ("same_model", kind.isin("merge", "move") & (F.col("a") == F.col("b"))),
        ("no_files", by_file & ~files_named),
        ("structural", by_file & F.col("structural")),
        ("stale_file", by_file & F.col("stale")),
        ("not_model_file", by_file & F.col("wrong_role")),
        ("review_not_found", (kind == "move") & F.col("review").isNotNull() & F.col("r_kind").isNull()),
        ("review_resolved", (kind == "move") & (F.col("r_status") != "open")),
        ("wrong_review_kind", (kind == "move") & F.col("review").isNotNull() & ~review_of),
        ("not_hidden", (kind == "unhide_file") & none_set),
        ("name_required", (kind == "rename") & ~auto & (_clean(name) == "")),
        ("name_too_long", (kind == "rename") & ~auto & (F.char_length(_clean(name)) > NAME_MOST)),
        ("stale_cover", (kind == "cover") & ~auto & (~files_named | F.col("no_picture"))),
        ("stale_variant", (kind == "set_printer") & F.col("no_variant")),
        ("unknown_family", (kind == "set_printer") & (name != "") & ~name.isin(*[f.key for f in FAMILIES])),
        ("not_set", (kind == "set_printer") & (name == "") & none_set),
    ]
    why = F.coalesce(*[F.when(test, F.lit(code)) for code, test in rules])
    return c.withColumn("refused", why).select(*commands.columns, "a", "b", "in_force", "first_name", "refused")


def ready(commands: DataFrame, s: State) -> DataFrame:
    """The commands that are the first to touch each of their subjects: models, reviews, contents, and models kept apart from a merged one."""
    c = judged(commands, s)
    own = c.select("id", "kind", "a", "b", F.array_compact(F.array_union(
        F.array(F.concat(F.lit("m:"), "a"), F.concat(F.lit("m:"), "b"), F.concat(F.lit("m:"), "model"), F.concat(F.lit("r:"), F.col("review").cast("string"))),
        F.transform(F.coalesce("files", F.array().cast("array<string>")), lambda k: F.concat(F.lit("f:"), k)))).alias("s"))
    subjects = own.select("id", F.explode("s").alias("subject"))
    merging = own.where("kind IN ('merge', 'approve')").select("id", "a")
    held = s.files.where("container IS NULL").select(F.col("model").alias("a"), F.concat(F.lit("f:"), "content_key").alias("subject"))
    apart = _apart(s).select(F.col("one").alias("a"), F.concat(F.lit("m:"), "two").alias("subject"))
    subjects = subjects.union(merging.join(held.union(apart), "a").select("id", "subject")).distinct()
    first = subjects.groupBy("subject").agg(F.min("id").alias("first"))
    blocked = subjects.join(first, "subject").where("id > first").select("id").distinct()
    return c.join(blocked, "id", "left_anti")


def _apart(s: State) -> DataFrame:
    """(one, two, did): pairs of models that are kept apart, both ways round."""
    d = s.decisions.where(f"relation = 'distinct_from' AND {_ACTIVE}")
    return d.select(F.col("subject_key").alias("one"), F.col("object_key").alias("two"), F.col("id").alias("did")).union(d.select("object_key", "subject_key", "id"))


def _placed(ok: DataFrame, s: State) -> DataFrame:
    """(by, key, to, out_of): files that commands put into a model; out_of: the model that they are to stay out of."""
    whole = s.files.where(F.col("container").isNull() & F.col("role").isin(*ROLES)).select(F.col("model").alias("a"), F.col("content_key").alias("key"))
    merged = ok.where("kind IN ('merge', 'approve')").select(F.col("id").alias("by"), "a", F.col("b").alias("to")).join(whole, "a").select("by", "key", "to", F.lit(None).cast("string").alias("out_of"))
    moved = ok.where("kind IN ('move', 'split')").select(F.col("id").alias("by"), F.explode("files").alias("key"), F.col("b").alias("to"), F.col("a").alias("out_of"))
    return merged.union(moved).distinct()


def _made(ok: DataFrame, placed: DataFrame, s: State) -> DataFrame:
    """New decisions."""
    active = s.decisions.where(_ACTIVE)

    def rows(source, by, type_, key, relation, polarity, about):
        return source.select(F.col(by).alias("action_id"), F.lit(type_).alias("subject_type"), F.col(key).alias("subject_key"), F.lit(relation).alias("relation"), F.lit(polarity).alias("polarity"), about.cast("string").alias("object_key"))

    kept_out = active.where("relation = 'member_of' AND polarity = 'reject'").select(F.col("subject_key").alias("key"), F.col("object_key").alias("out_of"))
    rejects = placed.where("out_of IS NOT NULL").join(kept_out, ["key", "out_of"], "left_anti")
    third = ok.where("kind IN ('merge', 'approve')").select("id", F.col("a").alias("one"), "b").join(_apart(s).drop("did"), "one").where("two <> b").select("id", "b", "two")
    third = third.join(_apart(s).select(F.col("one").alias("b"), "two"), ["b", "two"], "left_anti").distinct()
    shown = ok.where("kind = 'hide_file' AND size(in_force) = 0").withColumn("key", F.col("files")[0])
    printer = ok.where("kind = 'set_printer' AND name <> ''").withColumn("key", F.concat_ws("#", F.col("files")[0], F.col("plate").cast("string")))
    made = rows(placed, "by", "file", "key", "member_of", "affirm", F.col("to"))
    made = made.union(rows(rejects, "by", "file", "key", "member_of", "reject", F.col("out_of")))
    made = made.union(rows(third, "id", "model", "b", "distinct_from", "affirm", F.col("two")))
    made = made.union(rows(ok.where("kind = 'reject'"), "id", "model", "a", "distinct_from", "affirm", F.col("b")))
    made = made.union(rows(shown, "id", "file", "key", "hidden", "affirm", F.lit(None)))
    made = made.union(rows(printer, "id", "variant", "key", "targets_printer", "affirm", F.col("name")))
    nothing = F.lit(None).cast("bigint")
    own = F.concat_ws("/", F.col("action_id").cast("string"), "relation", "polarity", "subject_key", "object_key")
    return made.select(own.alias("id"), *made.columns, nothing.alias("superseded_by"), nothing.alias("withdrawn_by"))


def _ended(ok: DataFrame, placed: DataFrame, s: State) -> DataFrame:
    """(did, superseded_by, withdrawn_by) of decisions that commands replace or take back."""
    d = s.decisions.where(f"relation = 'member_of' AND {_ACTIVE}").select(F.col("id").alias("did"), F.col("subject_key").alias("key"), "polarity", "object_key")
    gone = placed.join(d, "key").where("polarity = 'affirm' OR object_key = to").select("did", F.col("by").alias("s"), F.lit(None).cast("bigint").alias("w"))
    between = ok.where("kind IN ('merge', 'approve')").select("id", F.col("a").alias("one"), F.col("b").alias("two")).join(_apart(s), ["one", "two"])
    gone = gone.union(between.select("did", "id", F.lit(None)))
    back = (F.col("kind") == "unhide_file") | (F.coalesce("name", F.lit("")) == "")
    old = ok.where("kind IN ('set_printer', 'unhide_file')").select(F.explode("in_force").alias("did"), "id", back.alias("back"))
    gone = gone.union(old.select("did", F.expr("CASE WHEN NOT back THEN id END"), F.expr("CASE WHEN back THEN id END")))
    return gone.groupBy("did").agg(F.max("s").alias("s"), F.max("w").alias("w"))


def _facts_set(ok: DataFrame, s: State) -> DataFrame:
    """(by, model, field, before, after) of facts that commands change; after null: the fact goes."""
    text = lambda c: c.cast("string")
    none = F.lit(None)
    pair = lambda field, value: F.struct(F.lit(field).alias("field"), text(value).alias("after"))
    kind, auto = F.col("kind"), F.coalesce("auto", F.lit(False))
    named = F.coalesce(F.nullif(F.left(_clean(F.coalesce("name", F.lit(""))), F.lit(NAME_MOST)), F.lit("")), _clean(F.regexp_replace("first_name", r"\.[^.]+$", "")))
    sets = (
        F.when(kind.isin("merge", "approve"), F.array(pair("merged_into", F.col("b"))))
        .when(kind.isin("hide", "unhide"), F.array(pair("hidden", F.when(kind == "hide", "1").otherwise("0"))))
        .when((kind == "rename") & auto, F.array(pair("name_source", F.lit("auto"))))
        .when(kind == "rename", F.array(pair("name", _clean(F.col("name"))), pair("name_source", F.lit("user"))))
        .when((kind == "cover") & auto, F.array(pair("cover_source", F.lit("auto")), pair("cover_content_key", none), pair("cover_plate", none)))
        .when(kind == "cover", F.array(pair("cover_source", F.lit("user")), pair("cover_content_key", F.col("files")[0]), pair("cover_plate", F.col("plate"))))
        .when(kind == "split", F.array(pair("name", named), pair("name_source", F.lit("user"))))
    )
    direct = ok.select(F.col("id").alias("by"), F.when(kind == "split", F.col("b")).otherwise(F.col("a")).alias("model"), F.inline(sets))
    own = s.facts.select(F.col("model").alias("a"), "field", "value")
    taken = ok.where("kind IN ('merge', 'approve')").select(F.col("id").alias("by"), "a", "b", F.coalesce("keep", F.array().cast("array<string>")).alias("keep")).join(own, "a")
    field = F.col("field")
    held = s.facts.select(F.col("model").alias("b"), "field", F.lit(True).alias("_held"))
    taken = taken.join(held, ["b", "field"], "left")
    wanted = ((field == "name") & F.array_contains("keep", F.lit("name"))) | (field.isin(*FILLED) & F.col("_held").isNull())
    taken = taken.where(wanted).select("by", F.col("b").alias("model"), "field", F.col("value").alias("after"))
    chosen_cover = own.where("field = 'cover_source' AND value = 'user'").select("a")
    covers = ok.where("kind IN ('merge', 'approve') AND array_contains(keep, 'cover')").select(F.col("id").alias("by"), "a", "b").join(chosen_cover, "a", "left_semi")
    covers = covers.select("by", "a", "b", F.explode(F.array(*[F.lit(f) for f in _COVER])).alias("field")).join(own, ["a", "field"], "left").select("by", F.col("b").alias("model"), "field", F.col("value").alias("after"))
    chosen = taken.where("field = 'name'").select("by", "model", F.lit("name_source"), F.lit("user"))
    every = direct.union(taken).union(chosen).union(covers)
    return every.join(s.facts.withColumnRenamed("value", "before"), ["model", "field"], "left").where("NOT (before <=> after)").select("by", "model", "field", "before", "after")


def _closed(ok: DataFrame, s: State) -> DataFrame:
    """(review, status, by) of reviews that commands answer."""
    own = ok.where("review IS NOT NULL AND kind IN ('approve', 'reject', 'dismiss', 'move')").select("review", F.when(F.col("kind") == "dismiss", "dismissed").otherwise("resolved").alias("status"), F.col("id").alias("by"))
    open_ = s.reviews.where("status = 'open' AND kind = 'suggested_match'").select(F.col("id").alias("review"), F.least("model", "other").alias("lo"), F.greatest("model", "other").alias("hi"))
    merged = ok.where("kind IN ('merge', 'approve')").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.col("id").alias("by"))
    return own.union(open_.join(merged, ["lo", "hi"]).select("review", F.lit("resolved"), "by")).distinct()


def after(done: DataFrame, s: State) -> State:
    """The state after a round: ``done`` is judged commands of which no two share a subject; refused ones change nothing.

    It is read for each table, so it should be a written one.
    """
    ok = done.where("refused IS NULL")
    placed, sets, closed = _placed(ok, s), _facts_set(ok, s), _closed(ok, s)
    ended = _ended(ok, placed, s)
    decisions = s.decisions.join(ended.withColumnRenamed("did", "id"), "id", "left").withColumn("superseded_by", F.coalesce("superseded_by", "s")).withColumn("withdrawn_by", F.coalesce("withdrawn_by", "w")).drop("s", "w")
    facts = s.facts.join(sets.select("model", "field"), ["model", "field"], "left_anti").unionByName(sets.where("after IS NOT NULL").select("model", "field", F.col("after").alias("value")))
    to = placed.select(F.col("key").alias("_key"), "to")
    files = s.files.join(to, F.coalesce("container", "content_key") == F.col("_key"), "left").withColumn("model", F.coalesce("to", "model")).drop("_key", "to")
    gained = ok.where("kind IN ('merge', 'approve')").select(F.col("id").alias("by"), F.col("a").alias("model"), "b").join(s.labels, "model").select("by", F.col("b").alias("model"), "label").join(s.labels, ["model", "label"], "left_anti").distinct()
    reviews = s.reviews.join(closed.select(F.col("review").alias("id"), F.col("status").alias("_s"), "by"), "id", "left").withColumn("status", F.coalesce("_s", "status")).withColumn("resolved_by", F.coalesce("by", "resolved_by")).drop("_s", "by")
    was = s.files.where("container IS NULL").groupBy(F.col("content_key").alias("key")).agg(F.min("model").alias("was"))
    text = lambda c: F.col(c).cast("string")
    log = sets.select("by", F.lit("fact"), "model", "field", "before", "after")
    log = log.union(placed.join(was, "key", "left").select("by", F.lit("file"), "key", F.lit("model"), "was", "to"))
    log = log.union(gained.select("by", F.lit("label"), "model", "label", F.lit(None).cast("string"), F.lit("1")))
    log = log.union(closed.select("by", F.lit("review"), text("review"), F.lit("status"), F.lit("open"), "status")).toDF(*s.changes.columns)
    acted = ok.select("id", "kind", F.when(F.col("kind").isin("merge", "approve"), F.col("b")).otherwise(F.col("a")).alias("model"), F.when(F.col("kind").isin("merge", "approve"), F.col("a")).otherwise(F.col("b")).alias("other"), F.lit(None).cast("bigint").alias("undone_by"))
    return State(facts.select(*s.facts.columns), files.select(*s.files.columns), decisions.select(*s.decisions.columns).union(_made(ok, placed, s)), reviews.select(*s.reviews.columns),
                 s.labels.unionByName(gained.select("model", "label")), s.actions.unionByName(acted), s.changes.union(log))


def undo_judged(wanted: DataFrame, s: State) -> DataFrame:
    """(id, action, refused) of undos (id, action): refused if the action is unknown, undone, or something later depends on it."""
    acts = s.actions.select(F.col("id").alias("action"), "kind", F.col("undone_by").isNotNull().alias("undone"))
    later = s.decisions.where("superseded_by IS NOT NULL OR withdrawn_by IS NOT NULL").select(F.col("action_id").alias("action"))
    splits = s.actions.where("kind = 'split'").select(F.col("id").alias("action_id"))
    set_now = s.changes.where("what = 'fact'").join(splits, "action_id", "left_anti").select(F.col("action_id").alias("action"), F.col("key").alias("model"), "field", "after")
    moved_on = set_now.join(s.facts, ["model", "field"], "left").where("NOT (value <=> after)").select("action")
    joined = s.decisions.where(f"relation = 'member_of' AND polarity = 'affirm' AND object_key LIKE 'split-%' AND {_ACTIVE}").select(F.substring_index("object_key", "-", -1).cast("bigint").alias("action"), "action_id").where("action <> action_id").select("action")
    blocked = later.union(moved_on).union(joined).distinct().withColumn("blocked", F.lit(True))
    why = F.when(F.col("kind").isNull(), "action_not_found").when(F.col("undone"), "already_undone").when(F.col("blocked"), "undo_blocked")
    return wanted.select("id", "action").join(acts, "action", "left").join(blocked, "action", "left").select("id", "action", why.alias("refused"))


def after_undo(done: DataFrame, s: State) -> State:
    """The state after undos (judged, of different actions): what each wrote is withdrawn, what it replaced is in force again."""
    ok = done.where("refused IS NULL").select("id", F.col("action").alias("action_id"))
    by = ok.select(F.col("action_id").alias("_a"), F.col("id").alias("_by"))
    d = s.decisions.join(by, F.col("action_id") == F.col("_a"), "left").withColumn("withdrawn_by", F.coalesce("_by", "withdrawn_by")).drop("_a", "_by")
    for column in ("superseded_by", "withdrawn_by"):
        d = d.join(by, F.col(column) == F.col("_a"), "left").withColumn(column, F.when(F.col("_a").isNull(), F.col(column))).drop("_a", "_by")
    undone = s.changes.join(ok, "action_id")
    last = undone.groupBy("what", "key", "field").agg(F.max_by(F.struct("before", "after"), "action_id").alias("x")).select("what", "key", "field", "x.before", "x.after")
    back = last.where("what = 'fact'").select(F.col("key").alias("model"), "field", F.col("before").alias("value"))
    retired = s.actions.where("kind = 'split'").select(F.col("id").alias("action_id"), "model", "other").join(ok, "action_id").select(F.col("other").alias("model"), F.lit("merged_into").alias("field"), F.col("model").alias("value"))
    back = back.join(retired.select("model"), "model", "left_anti").union(retired)  # a retired model keeps its name
    facts = s.facts.join(back.select("model", "field"), ["model", "field"], "left_anti").unionByName(back.where("value IS NOT NULL"))
    put = last.where("what = 'file'").select(F.col("key").alias("_key"), "before", F.col("after").alias("_to"))
    files = s.files.join(put, (F.coalesce("container", "content_key") == F.col("_key")) & (F.col("model") == F.col("_to")), "left").withColumn("model", F.coalesce("before", "model")).drop("_key", "before", "_to")
    labels = s.labels.join(last.where("what = 'label'").select(F.col("key").alias("model"), F.col("field").alias("label")), ["model", "label"], "left_anti")
    reopened = last.where("what = 'review'").select(F.col("key").cast("bigint").alias("id"), F.lit(True).alias("_open"))
    reviews = s.reviews.join(reopened, "id", "left").withColumn("status", F.when(F.col("_open"), "open").otherwise(F.col("status"))).withColumn("resolved_by", F.when(F.col("_open").isNull(), F.col("resolved_by"))).drop("_open")
    actions = s.actions.join(ok.select(F.col("action_id").alias("id"), F.col("id").alias("_by")), "id", "left").withColumn("undone_by", F.coalesce("undone_by", "_by")).drop("_by")
    return State(facts.select(*s.facts.columns), files.select(*s.files.columns), d.select(*s.decisions.columns), reviews.select(*s.reviews.columns), labels.select(*s.labels.columns), actions.select(*s.actions.columns), s.changes)


def history(s: State, model: str) -> DataFrame:
    """Actions about a model, newest first, with ``undoable``."""
    of = s.actions.where((F.col("model") == model) | (F.col("other") == model))
    told = undo_judged(of.select("id", F.col("id").alias("action")), s).select("id", F.col("refused").isNull().alias("undoable"))
    return of.join(told, "id").orderBy(F.col("id").desc())


def read(tables: Tables) -> State:
    return State(**{f.name: tables.read(f.name) for f in fields(State)})


def create(tables: Tables, s: State) -> None:
    """Put a first state in force."""
    results = s.facts.sparkSession.createDataFrame([], "id bigint, refused string")
    tables.commit(**{f.name: getattr(s, f.name) for f in fields(State)}, results=results)


def apply(tables: Tables, commands: DataFrame) -> DataFrame:
    """Run commands by id and return (id, refused). Each round is one commit of all tables.

    A command whose id has a result is not run again, so a batch that broke off
    can be sent anew. There are as many rounds as the longest chain of commands
    that share a subject.
    """
    while True:
        s, results = read(tables), tables.read("results")
        waiting = commands.join(results.select("id"), "id", "left_anti")
        done = written(ready(waiting, s), "round")
        try:
            if done.isEmpty():
                return results.join(commands.select("id"), "id", "left_semi")
            _commit(tables, after(done, s), results, done)
        finally:
            removed(done)


def undo(tables: Tables, wanted: DataFrame) -> DataFrame:
    """Undo actions (id, action), all judged against the state as it is, and return (id, refused)."""
    s, results = read(tables), tables.read("results")
    done = written(undo_judged(wanted.join(results.select("id"), "id", "left_anti"), s), "undo")
    try:
        _commit(tables, after_undo(done, s), results, done)
    finally:
        removed(done)
    return tables.read("results").join(wanted.select("id"), "id", "left_semi")


def _commit(tables: Tables, s: State, results: DataFrame, done: DataFrame) -> None:
    tables.commit(**{f.name: getattr(s, f.name) for f in fields(State)}, results=results.unionByName(done.select("id", "refused")))
