"""Merkle manifest of a table: one tree a group, one tree over the groups' roots.

Leaves are dealt by ranges of their order, so a group of any size spreads over
many partitions, and every leaf gets its place in its group from the counts of
the partitions before. Each partition then runs a mountain-range stack: a full
run of FANOUT nodes is hashed and carried up, and what a border of the partition
leaves open comes out as loose nodes. The loose nodes of all partitions, few a
partition, meet level by level; only there can a group's last run be short, and
it is hashed as it is, without padding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, stored

FANOUT = 16
_PATH = "array<struct<pos:int,children:array<string>>>"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """Hash of a row: of each field `-` if null, else its bytes' number, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


class Mountains:
    """Stack of peaks over consecutive leaves of one group, whose first may be any place.

    ``run(level, number, children, docs)`` is called for every full run,
    ``loose(level, place, digest, doc)`` for every node whose run reaches beyond
    these leaves.
    """

    def __init__(self, run: Callable, loose: Callable, fanout: int = FANOUT):
        self.run, self.loose, self.fanout = run, loose, fanout
        self.open: list[list[str]] = []
        self.next: list[int] = []
        self.docs: list = []

    def push(self, place: int, node: str, doc) -> None:
        self.docs.append(doc)
        level = 0
        while True:
            if level == len(self.open):
                self.open.append([])
                self.next.append(place)
            self.open[level].append(node)
            self.next[level] = place + 1
            if (place + 1) % self.fanout:
                return
            children = self.open[level]
            if len(children) < self.fanout:  # the run began before these leaves
                self._spill(level)
                return
            self.run(level, place // self.fanout, children, self.docs if level == 0 else None)
            self.open[level] = []
            if level == 0:
                self.docs = []
            level, place, node = level + 1, place // self.fanout, digest("".join(children))

    def _spill(self, level: int) -> None:
        first = self.next[level] - len(self.open[level])
        for k, node in enumerate(self.open[level]):
            self.loose(level, first + k, node, self.docs[k] if level == 0 else None)
        self.open[level] = []
        if level == 0:
            self.docs = []

    def finish(self) -> None:
        for level in range(len(self.open)):
            self._spill(level)


@dataclass
class Tree:
    """``runs``: by level, (g, n, at, children, docs), at being the number of the run; ``roots``: (g, n, digest); ``alone``: groups of one leaf."""

    runs: list[DataFrame]
    roots: DataFrame
    alone: DataFrame


def _indexed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``at``, the leaf's place in its group ``g``, and ``n``, the group's size; no task holds a whole group."""
    parts = partitions_for(leaves)
    ranged = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, "g", *order, "tie")
    dealt = stored(ranged.withColumn("part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("g", "part").agg(F.count("*").alias("have"))
    whole = Window.partitionBy("g")
    before = F.sum("have").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("g", "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("have").over(whole).alias("n"))
    place = F.row_number().over(Window.partitionBy("g", "part").orderBy(*order, "tie"))
    return dealt.join(counts, ["g", "part"]).select("g", "n", (F.col("before") + place - 1).alias("at"), "leaf", "doc")


def _nodes(n: str, level: int) -> Column:
    """How many nodes a tree of ``n`` leaves has at a level."""
    width = FANOUT**level
    return F.expr(f"({n} + {width - 1}L) div {width}L")


def build(leaves: DataFrame, order: list[str]) -> Tree:
    """The tree of every group of ``leaves`` (g string, leaf string, doc any struct, and the columns of ``order``).

    Equal leaves are ordered at will. An empty table has no tree.
    """
    kind = leaves.schema["doc"].dataType.simpleString()
    arrow = f"g string, n bigint, level int, at bigint, whole boolean, children array<string>, docs array<{kind}>"

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {k: [] for k in ("g", "n", "level", "at", "whole", "children", "docs")}
        here: tuple = (None, None)
        follows = -1
        range_: Mountains | None = None

        def add(level: int, at: int, whole: bool, children: list[str], docs) -> None:
            for column, value in zip(rows.values(), (*here, level, at, whole, children, docs), strict=True):
                column.append(value)

        def begun() -> Mountains:
            return Mountains(lambda level, at, children, docs: add(level, at, True, children, docs), lambda level, at, node, doc: add(level, at, False, [node], None if doc is None else [doc]))

        for batch in batches:
            types = pa.schema([("g", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("whole", pa.bool_()), ("children", pa.list_(pa.string())), ("docs", pa.list_(batch.schema.field("doc").type))])
            for g, n, at, leaf, doc in zip(*[batch.column(c).to_pylist() for c in ("g", "n", "at", "leaf", "doc")], strict=True):
                if g != here[0] or at != follows:
                    if range_:
                        range_.finish()
                    here, range_ = (g, n), begun()
                range_.push(at, leaf, doc)
                follows = at + 1
            yield pa.RecordBatch.from_pydict(rows, types)
            for column in rows.values():
                column.clear()
        if range_:
            range_.finish()
            yield pa.RecordBatch.from_pydict(rows, types)

    first = stored(_indexed(leaves, order).mapInArrow(stack, arrow), "peaks")
    largest = first.agg(F.max("n")).first()[0] or 0
    alone = first.where("n = 1").select("g", "n", F.col("children").alias("node"), "docs")
    runs, tops, carried, level = [], [], None, 0
    while True:
        loose = first.where(~F.col("whole") & (F.col("level") == level)).select("g", "n", "at", F.col("children")[0].alias("node"), F.col("docs")[0].alias("doc"))
        if carried is not None:
            loose = loose.unionByName(carried)
        tops.append(loose.where(_nodes("n", level) == 1).select("g", "n", F.col("node").alias("digest")))
        if FANOUT**level >= largest:
            break
        keyed = loose.where(_nodes("n", level) > 1).withColumn("run", F.expr(f"at div {FANOUT}L"))
        met = keyed.groupBy("g", "n", "run").agg(F.array_sort(F.collect_list(F.struct("at", "node", "doc"))).alias("e"))
        met = stored(met.select("g", "n", F.col("run").alias("at"), F.col("e.node").alias("children"), F.col("e.doc").alias("docs")), f"level{level}")
        ready = first.where(F.col("whole") & (F.col("level") == level)).select("g", "n", "at", "children", "docs")
        runs.append(ready.unionByName(met))
        carried = met.select("g", "n", "at", F.sha2(F.array_join("children", ""), 256).alias("node"), F.lit(None).cast(kind).alias("doc"))
        level += 1
    roots = tops[0]
    for t in tops[1:]:
        roots = roots.unionByName(t)
    return Tree(runs, roots, alone.withColumnRenamed("node", "children"))


def paths(tree: Tree, above: DataFrame) -> DataFrame:
    """Every leaf run with the runs over it: (children, docs, path, alone and the further columns of ``above``).

    ``above`` has a row for each group: g, n, ``path`` from the group's root
    upwards, and any others. The way is from the top down, where each run meets
    its at most FANOUT children; ``alone`` marks a group's only leaf.
    """
    kept = [c for c in above.columns if c not in ("g", "n", "path")]
    over = None
    for level in range(len(tree.runs) - 1, -1, -1):
        top = above.where((_nodes("n", level + 1) == 1) & (_nodes("n", level) > 1)).select("g", F.lit(0).cast("bigint").alias("up"), "path", *kept)
        if over is not None:
            # one row for each child of an upper run, so that the join below finds one partner
            reached = over.select("g", "at", "children", "path", *kept, F.explode(F.sequence(F.lit(0), F.size("children") - 1)).alias("pos"))
            down = reached.select("g", (F.col("at") * FANOUT + F.col("pos")).alias("up"), F.concat(F.array(F.struct("pos", "children")), F.col("path")).alias("path"), *kept)
            top = down.unionByName(top)
        runs = tree.runs[level].select("g", F.col("at").alias("up"), "children", "docs")
        over = runs.join(top, ["g", "up"]).select("g", F.col("up").alias("at"), "children", "docs", "path", *kept)
    alone = tree.alone.join(above.drop("n"), "g").select("children", "docs", "path", *kept, F.lit(True).alias("alone"))
    return alone if over is None else over.select("children", "docs", "path", *kept, F.lit(False).alias("alone")).unionByName(alone)


def manifest(docs: DataFrame, fields: list[str], key: str = "doc_id", group: str = "source", is_altered: Column | None = None, altered: dict[str, Column] | None = None, with_proof: bool = True) -> DataFrame:
    """(key, leaf, subroot, root, proof, proof_sha256, folded_root, verified) for every row of ``docs``.

    A row's leaf is the hash of ``fields``. The leaves of a group ascend by
    ``key``, null first, then by their hash; groups ascend bytewise, null first.
    ``proof`` lists, level by level up to the root, the siblings' digests joined
    to a text; it is null unless ``with_proof``, being larger than many texts. ``folded_root`` is worked out again from the leaf and its proof,
    the leaf being that of the ``altered`` fields where ``is_altered`` holds;
    ``verified`` says whether it equals the root. A null key or field is part of
    the leaf like any other value, repeated rows are leaves of their own,
    columns beyond ``fields`` are not read, and an empty table gives no rows.
    """
    columns = {f: F.col(f"`{f}`") for f in fields}
    leaf = leaf_digest(*columns.values())
    changed = F.lit(None).cast("string") if is_altered is None else F.when(is_altered, leaf_digest(*(columns | (altered or {})).values()))
    kind = docs.schema[key].dataType.simpleString()
    own = F.col(f"`{group}`").cast("string")
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), own), F.lit("")).alias("g"),  # null before all others
        F.col(f"`{key}`").alias("key"),
        leaf.alias("leaf"),
        F.struct(F.col(f"`{key}`").alias("key"), changed.alias("changed")).alias("doc"),
    )
    tree = build(stored(leaves, "leaves"), ["key", "leaf"])
    groups = stored(tree.roots.withColumnRenamed("digest", "leaf"), "roots")
    crown = build(groups.select(F.lit("").alias("g"), F.col("g").alias("name"), "leaf", F.struct(F.col("g").alias("name")).alias("doc")), ["name"])
    top = crown.roots.select("g", "n", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    placed = paths(crown, top).withColumn("e", F.explode(F.arrays_zip(F.col("docs.name").alias("name"), F.sequence(F.lit(0), F.size("docs") - 1).alias("pos"))))
    step = F.when(F.col("alone"), F.array().cast(_PATH)).otherwise(F.array(F.struct(F.col("e.pos").cast("int").alias("pos"), "children")))
    placed = placed.select(F.col("e.name").alias("g"), F.concat(step, "path").cast(_PATH).alias("path"), "root")
    above = stored(groups.join(placed, "g").select("g", "n", "path", F.col("leaf").alias("subroot"), "root"), "above")

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            out: list[tuple] = []
            for row in batch.to_pylist():
                children, steps = row["children"], []
                for s in row["path"]:
                    steps.append(("".join(s["children"][: s["pos"]]), "".join(s["children"][s["pos"] + 1 :])))
                upper = [a + b for a, b in steps]
                for pos, doc in enumerate(row["docs"]):
                    left, right = ("", "") if row["alone"] else ("".join(children[:pos]), "".join(children[pos + 1 :]))
                    folded = doc["changed"] or children[pos]
                    if not row["alone"]:
                        folded = digest(left + folded + right)
                    for a, b in steps:
                        folded = digest(a + folded + b)
                    proof = upper if row["alone"] else [left + right, *upper]
                    out.append((doc["key"], children[pos], row["subroot"], row["root"], proof if with_proof else None, digest("".join(proof)), folded, folded == row["root"]))
            types = [batch.schema.field("docs").type.value_type.field("key").type, pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.bool_()]
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"])

    found = paths(tree, above).mapInArrow(prove, f"key {kind}, leaf string, subroot string, root string, proof array<string>, proof_sha256 string, folded_root string, verified boolean")
    return found.withColumnRenamed("key", key)
