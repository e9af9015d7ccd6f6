"""Chat formatting: records of many layouts to canonical turns, turns to one template, and back.

Built-in functions only. A record's layout is told by its schema fingerprint:
the hash of its nested field paths, as far as any layout speaks of them, looks up
the declarative mapping that reads its turns. A turn is rendered as

    <turn>role
    text</turn>

In roles and texts each backslash is doubled and the two marks get a single
backslash inside, which nothing else can have there; so the text comes back
exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import md5
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

OPEN, CLOSE = "<turn>", "</turn>"
#: What stands for a control string inside a role or text; a role's line end is one as well.
_HIDDEN = {CLOSE: "</\\turn>", OPEN: "<\\turn>"}
_LINE = "<\\line>"


@dataclass(frozen=True)
class Layout:
    """How the turns of one kind of record are read.

    ``turns``: (role, paths) in their order, where a turn's text is that of its
    paths, those present joined by an empty line; the turn goes if none is
    there. ``each``: instead, a list's path and its items' fields for role and
    text. ``may``: fields that may be there too; ``names`` renames roles.
    """

    name: str
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: tuple[str, str, str] | None = None
    row: tuple[str, str] | None = None
    may: tuple[str, ...] = ()
    names: dict[str, str] = field(default_factory=dict)

    def paths(self) -> tuple[list[str], list[str]]:
        """Field paths that must and that may be there."""
        if self.each:
            items, role, text = self.each
            return [items, f"{items}[].{role}", f"{items}[].{text}"], list(self.may)
        if self.row:
            return list(self.row), list(self.may)
        return [p for _, paths in self.turns for p in paths if p not in self.may], list(self.may)

    def fingerprints(self) -> Iterator[str]:
        must, may = self.paths()
        for k in range(len(may) + 1):
            for some in combinations(may, k):
                yield md5("\n".join(sorted([*must, *some])).encode()).hexdigest()


_SHARED = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Layouts by what they are called in public instruction sets; of two that share a fingerprint the first counts.
LAYOUTS = (
    Layout("row_text", row=("role", "text")),
    Layout("row_content", row=("role", "content")),
    Layout("messages_content", each=("messages", "role", "content"), may=("prompt", "system")),
    Layout("messages_text", each=("messages", "role", "text"), may=("prompt", "system")),
    Layout("conversations_value", each=("conversations", "from", "value"), may=("system",), names=_SHARED),
    Layout("conversations_content", each=("conversations", "role", "content"), may=("system",)),
    Layout("prompt_completion", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), may=("system",)),
    Layout("prompt_response", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), may=("system",)),
    Layout("question_answer", turns=(("system", ("system",)), ("user", ("context", "question")), ("assistant", ("answer",))), may=("system", "context")),
    Layout("instruction_output", turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), may=("system", "input")),
    Layout("instruction_response", turns=(("system", ("system",)), ("user", ("instruction", "context")), ("assistant", ("response",))), may=("system", "context")),
)
_TURNS = "array<struct<role:string,text:string>>"


def _known(layouts: tuple[Layout, ...]) -> list[str]:
    return sorted({p for layout in layouts for group in layout.paths() for p in group})


def field_paths(record: Column, lists: list[str]) -> Column:
    """Names of an object's fields, and of the fields that the objects in each of ``lists`` have, as ``list[].field``."""
    top = F.map_keys(F.try_variant_get(record, "$", "map<string,variant>"))
    below = []
    for name in lists:
        items = F.try_variant_get(record, f"$.{name}", "array<map<string,variant>>")
        below.append(F.coalesce(F.flatten(F.transform(items, lambda m: F.transform(F.map_keys(m), lambda k: F.concat(F.lit(f"{name}[]."), k)))), F.array().cast("array<string>")))  # noqa: B023
    return F.array_distinct(F.concat(F.coalesce(top, F.array().cast("array<string>")), *below))


def fingerprint(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of the record's field paths, those that no layout speaks of left out."""
    known = F.array(*[F.lit(p) for p in _known(layouts)])
    lists = sorted({layout.each[0] for layout in layouts if layout.each})
    return F.md5(F.array_join(F.array_sort(F.array_intersect(field_paths(record, lists), known)), "\n"))


def _text(value: Column) -> Column:
    """A text, or the texts of a list of parts one after the other; null if there is none."""
    parts = F.try_variant_get(value, "$", "array<map<string,variant>>")
    return F.coalesce(F.array_join(F.transform(parts, lambda m: F.coalesce(F.try_variant_get(m["text"], "$", "string"), F.lit(""))), ""), F.try_variant_get(value, "$", "string"))


def _at(record: Column, name: str) -> Column:
    return F.try_variant_get(record, f"$.{name}", "variant")


def _turns(record: Column, layout: Layout) -> Column:
    names = F.create_map(*[F.lit(x) for pair in layout.names.items() for x in pair]) if layout.names else None
    named = lambda role: F.coalesce(F.try_element_at(names, role), role) if names is not None else role
    turn = lambda role, text: F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    if layout.row:
        role, text = layout.row
        return F.array(turn(named(_text(_at(record, role))), _text(_at(record, text))))
    if layout.each:
        items, role, text = layout.each
        found = F.transform(F.try_variant_get(record, f"$.{items}", "array<map<string,variant>>"), lambda m: turn(named(_text(m[role])), _text(m[text])))
        if "system" not in layout.may:
            return found
        lead = _text(_at(record, "system"))
        return F.when(F.coalesce(lead, F.lit("")) == "", found).otherwise(F.concat(F.array(turn(F.lit("system"), lead)), found))
    told = []
    for role, paths in layout.turns:
        texts = [_text(_at(record, p)) for p in paths]
        optional = [F.when(t != "", t) if p in layout.may else F.coalesce(t, F.lit("")) for p, t in zip(paths, texts, strict=True)]
        there = F.lit(True) if any(p not in layout.may for p in paths) else F.coalesce(*optional).isNotNull()
        told.append(F.when(there, turn(F.lit(role), F.concat_ws("\n\n", *optional))))
    return F.filter(F.array(*told), lambda t: t.isNotNull())


def canonical(records: DataFrame, conv: Column, record: Column, at: Column | None = None, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, at, place, role, text, layout, fingerprint): a row for each turn.

    ``record`` is a variant, or a string of JSON. ``at`` orders the records of a
    conversation, ``place`` the turns of a record, from 0. A null role or text
    becomes empty. A record of an unknown layout, that is no object or no JSON,
    or that holds no turns gives one row without role and text, so that nothing
    is lost in silence; ``layout`` is null where none was found.
    """
    if isinstance(records.select(record.alias("r")).schema["r"].dataType, StringType):
        record = F.try_parse_json(record)
    chosen: dict[str, str] = {}
    for layout in layouts:
        for mark in layout.fingerprints():
            chosen.setdefault(mark, layout.name)
    by_mark = F.create_map(*[F.lit(x) for pair in chosen.items() for x in pair])
    told = records.select(conv.alias("conv_id"), (F.lit(0) if at is None else at).cast("bigint").alias("at"), record.alias("record"))
    told = told.withColumn("fingerprint", fingerprint(F.col("record"), layouts))
    told = told.withColumn("layout", F.try_element_at(by_mark, F.col("fingerprint")))
    read = F.lit(None).cast(_TURNS)
    for layout in reversed(layouts):
        read = F.when(F.col("layout") == layout.name, _turns(F.col("record"), layout)).otherwise(read)
    return told.select("conv_id", "at", "layout", "fingerprint", F.posexplode_outer(read).alias("place", "turn")).select("conv_id", "at", "place", "turn.role", "turn.text", "layout", "fingerprint")


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark, hidden in _HIDDEN.items():
        out = F.replace(out, F.lit(mark), F.lit(hidden))
    return F.replace(out, F.lit("\n"), F.lit(_LINE)) if role else out


def unescaped(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit(_LINE), F.lit("\n")) if role else text
    for mark, hidden in _HIDDEN.items():
        out = F.replace(out, F.lit(hidden), F.lit(mark))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def render(turns: DataFrame, learns: Column | None = None) -> DataFrame:
    """Adds ``piece``, a turn in the template, and ``start`` and ``length`` of its loss, null without.

    The loss covers the escaped text of turns where ``learns`` holds, those of
    the assistant if it is not given. Positions count code points from the
    piece's beginning. One row at a time: no shuffle. A row without a turn gets
    no piece.
    """
    learns = F.col("role") == "assistant" if learns is None else learns
    head = F.concat(F.lit(OPEN), escaped(F.col("role"), role=True), F.lit("\n"))
    body = escaped(F.col("text"))
    return turns.withColumn("piece", F.concat(head, body, F.lit(f"{CLOSE}\n"))).withColumns({"start": F.when(learns, F.char_length(head)), "length": F.when(learns, F.char_length(body))})


def assemble(rendered: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss, unknown): a row for each conversation.

    ``formatted`` is its pieces by (at, place), ties by their own text, null
    ``at`` first; ``loss`` array<struct<turn, start, length>> gives the spans
    under the loss mask, positions from the beginning of that turn, so that a
    long conversation is read in one pass; ``unknown`` counts records without a
    turn. Records without conv_id form one conversation. A conversation is one
    value, so Spark's limit of 2 GB holds for it; ``render`` has none.
    """
    entry = F.when(F.col("piece").isNotNull(), F.struct("at", "place", "piece", "start", "length"))  # collect_list passes nulls over
    whole = rendered.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("e"), F.count_if(F.col("piece").isNull()).alias("unknown"))
    spans = F.transform("e", lambda e, i: F.struct(i.alias("turn"), e["start"].alias("start"), e["length"].alias("length")))
    return whole.select("conv_id", F.array_join(F.col("e.piece"), "").alias("formatted"), F.filter(spans, lambda s: s["length"].isNotNull()).alias("loss"), "unknown")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> from a formatted conversation."""

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        text = F.substring(piece, F.char_length(role) + 2, F.char_length(piece))
        return F.struct(unescaped(F.substring(role, F.lit(len(OPEN) + 1), F.char_length(role)), role=True).alias("role"), unescaped(text).alias("text"))

    return F.transform(_pieces(formatted), turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    under = lambda pieces: F.transform(loss, lambda s: unescaped(F.substring(F.get(pieces, s["turn"]), s["start"] + 1, s["length"])))
    return F.get(F.transform(F.array(_pieces(formatted)), under), F.lit(0))  # parted once, not for every span


def _pieces(formatted: Column) -> Column:
    """A formatted conversation's turns without their closing marks."""
    return F.filter(F.split(formatted, f"{CLOSE}\n"), lambda p: p != "")
