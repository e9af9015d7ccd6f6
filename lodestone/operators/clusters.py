"""Constrained clustering and assignment to models, in rounds over tables.

Both rules are sequential: edges, or claims on models, are taken in a fixed
order. The rounds here take at once what the order cannot change, so no
component is held in one task.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import removed, written
from .graph import components

_SETS = ("models", "rejects", "apart")
#: Edges between clusters that decisions divide; so many or fewer are folded one by one, as rounds would cost more.
FOLD_MOST = 100_000


def _relevant(place: DataFrame, pins: DataFrame, rejects: DataFrame, anchors: DataFrame, distinct: DataFrame) -> DataFrame:
    """(component, key, kind, model): what decisions say of keys, without all that nothing in its component could ever stand against.

    kind: pin, models (owned by), rejects (separated from), apart (models that one of its own is kept apart from).
    """
    at = lambda table: table.select("key", "model").where("key IS NOT NULL AND model IS NOT NULL").distinct().join(place, "key")
    pin = at(pins.groupBy("key").agg(F.min("model").alias("model")))
    owned = at(pins.select("key", "model").unionByName(anchors.select("key", "model")))
    own = owned.select("component", "model").distinct()
    reject = at(rejects).join(own, ["component", "model"], "left_semi")
    both_ways = distinct.select(F.col("a").alias("model"), F.col("b").alias("other")).union(distinct.select("b", "a")).where("model <> other").distinct()
    pairs = own.join(both_ways, "model").join(own.withColumnRenamed("model", "other"), ["component", "other"])
    apart = owned.join(pairs, ["component", "model"]).select("component", "key", F.col("other").alias("model"))
    met = reject.select("component", "model").union(pairs.select("component", "model")).distinct()
    split = pin.groupBy("component").agg(F.count_distinct("model").alias("n")).where("n > 1").select("component")
    told = {"pin": pin.join(split, "component", "left_semi"), "models": owned.join(met, ["component", "model"], "left_semi"), "rejects": reject, "apart": apart}
    return reduce(DataFrame.unionByName, [rows.select("component", "key", F.lit(kind).alias("kind"), F.col("model").cast("bigint").alias("model")).distinct() for kind, rows in told.items()])


def _sets(a: str, b: str) -> tuple[Column, Column]:
    """(refused, adds nothing): of two sides' marks, whether they may not be joined, and whether all that ``a`` has is in ``b``."""
    of = lambda side, name: F.coalesce(F.col(f"{side}_{name}"), F.array().cast("array<bigint>"))
    refused = F.coalesce(F.col(f"{a}_pin") != F.col(f"{b}_pin"), F.lit(False))
    for x, y in (("rejects", "models"), ("models", "rejects"), ("apart", "models")):
        refused = refused | F.arrays_overlap(of(a, x), of(b, y))
    within = F.coalesce(F.col(f"{a}_pin") == F.col(f"{b}_pin"), F.col(f"{a}_pin").isNull())
    for name in _SETS:
        within = within & (F.size(F.array_except(of(a, name), of(b, name))) == 0)
    return refused, within


def _beside(marks: DataFrame, side: str) -> DataFrame:
    return marks.select(F.col("cluster").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("pin", *_SETS)])


def _folded(edges: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
    """The sequential rule over a few edges between clusters."""
    of = {row.cluster: [None if row.pin != row.pin else row.pin, *[set(getattr(row, c)) for c in _SETS]] for row in marks.itertuples()}
    side = {c: c for c in (*edges["a"], *edges["b"])}

    def root(c: str) -> str:
        while side[c] != c:
            side[c] = side[side[c]]
            c = side[c]
        return c

    for a, b in edges.sort_values(["n", "ab", "first"])[["a", "b"]].itertuples(index=False):
        x, y = sorted((root(a), root(b)))
        if x == y:
            continue
        (pin, own, out, apart), (pin2, own2, out2, apart2) = (of.get(c, [None, set(), set(), set()]) for c in (x, y))
        if pin is not None and pin2 is not None and pin != pin2 or out & own2 or out2 & own or apart & own2:
            continue
        side[y] = x
        of[x] = [pin2 if pin is None else pin, own | own2, out | out2, apart | apart2]
    return pd.DataFrame([(c, root(c)) for c in side], columns=["cluster", "into"])


def constrained_clusters(keys: DataFrame, edges: DataFrame, pins: DataFrame, rejects: DataFrame, anchors: DataFrame, distinct: DataFrame, fold_most: int = FOLD_MOST) -> DataFrame:
    """(key, cluster): automatic edges joined in order, except where a decision forbids it; a cluster is named by its least key.

    edges: a, b, confidence (exact before all others, then by a and b written
    together); pins, rejects, anchors: key, model, a key with several pins
    having the least; distinct: a, b (models kept apart). A join is refused if
    the sides are pinned to different models, if a member of one was separated
    from a model of the other, or if their models are kept apart. Edges with an
    end that is no key count for nothing.

    A refusal stays one however the sides grow. So in each round a side may take
    its least edge that is not refused if that edge is the other side's least
    too, or if all that decisions say of it holds for the other side already,
    since then nothing before could have turned the edge down. Components that
    no decision divides are done without rounds; the others take about as many
    as the decisions that meet in one of them, until ``fold_most`` edges or
    fewer are left, which one task folds.
    """
    known = lambda c: keys.select(F.col("key").alias(c)).distinct()
    links = edges.where("a <> b").join(known("a"), "a", "left_semi").join(known("b"), "b", "left_semi")
    links = written(links.select(F.when(F.col("confidence") == "exact", 0).otherwise(1).alias("n"), F.concat("a", "b").alias("ab"), "a", "b").distinct(), "edges")
    place = written(components(known("key"), links), "places")
    said = written(_relevant(place, pins, rejects, anchors, distinct), "marks")
    divided = said.select("component").distinct()
    of = written(place.join(divided, "component", "left_semi").select("key", F.col("key").alias("cluster")), "members")
    sets = [F.collect_set(F.when(F.col("kind") == k, F.col("model"))).alias(k) for k in _SETS]
    marks = written(said.groupBy(F.col("key").alias("cluster")).agg(F.min(F.when(F.col("kind") == "pin", F.col("model"))).alias("pin"), *sets), "sets")
    ends = of.select(F.col("key").alias("a"))
    open_ = written(links.join(ends, "a", "left_semi").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.struct("n", "ab", F.col("a").alias("first")).alias("rank")), "open")
    while not open_.isEmpty():
        refused, _ = _sets("a", "b")
        tested = open_.groupBy("a", "b").agg(F.min("rank").alias("rank")).join(_beside(marks, "a"), "a", "left").join(_beside(marks, "b"), "b", "left")
        left = written(tested.where(~refused).select("a", "b", "rank"), "open")
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"), "rank"))
        if left.count() <= fold_most:
            one = lambda rows: rows.withColumn("one", F.lit(0)).groupBy("one")
            ends = left.select(F.col("a").alias("cluster")).union(left.select("b")).distinct()
            few = left.select("a", "b", "rank.*")
            into = one(few).cogroup(one(marks.join(ends, "cluster", "left_semi"))).applyInPandas(_folded, "cluster string, into string")
            of = of.join(into, "cluster", "left").select("key", F.coalesce("into", "cluster").alias("cluster"))
            break
        best = written(both.groupBy("a").agg(F.min(F.struct("rank", "b")).alias("m")).select("a", "m.b", "m.rank"), "best")
        _, within = _sets("a", "b")
        sides = best.join(best.select(F.col("a").alias("b"), F.col("rank").alias("theirs")), "b").join(_beside(marks, "a"), "a", "left").join(_beside(marks, "b"), "b", "left")
        taken = written(sides.where((F.col("rank") == F.col("theirs")) | within).select("a", "b"), "taken")
        into = written(components(taken.select(F.col("a").alias("key")).union(taken.select("b")).distinct(), taken).withColumnsRenamed({"key": "cluster", "component": "into"}), "into")
        newer = lambda rows, c="cluster", into=into: rows.join(into.withColumnRenamed("cluster", c), c, "left").withColumn(c, F.coalesce("into", c)).drop("into")
        moved = newer(newer(left, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "rank")
        grown = newer(marks).groupBy("cluster").agg(F.min("pin").alias("pin"), *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in _SETS])
        old = (open_, left, best, taken, into, of, marks)
        of, marks, open_ = written(newer(of).select("key", "cluster"), "members"), written(grown, "sets"), written(moved, "open")
        removed(*old)
    out = known("key").join(place, "key").join(of, "key", "left")
    return out.select("key", F.coalesce("cluster", "component").alias("cluster"))


def assigned(clusters: DataFrame, pins: DataFrame, rejects: DataFrame, anchors: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """(cluster, model, created): the pinned model, else the one that owns at least half of it, each model once.

    clusters: key, cluster; ``live``: model, those that may still be taken.
    Largest overlap first, then first key, then the older model. A pinned
    cluster joins its model and leaves it free for another; a key that was
    separated from a model is no claim on it. A cluster without a model gets a
    new one named by a hash of its name, so that runs agree.

    In each round a cluster takes its best model if that model has no better
    claim, which the order cannot change; both leave the table.
    """
    size = clusters.groupBy("cluster").agg(F.count("*").alias("size"), F.min("key").alias("first"))
    pinned = clusters.join(pins, "key").groupBy("cluster").agg(F.min("model").alias("model"), F.max("model").alias("_other")).where("model = _other").drop("_other")
    free = clusters.join(pinned.select("cluster"), "cluster", "left_anti").join(anchors.select("key", "model").distinct(), "key").join(rejects, ["key", "model"], "left_anti")
    if live is not None:
        free = free.join(live.select("model").distinct(), "model", "left_semi")
    want = free.groupBy("cluster", "model").agg(F.count("*").alias("n")).join(size, "cluster").where(F.col("n") * 2 >= F.col("size"))
    open_ = written(want.select("cluster", "model", F.struct((-F.col("n")).alias("n"), "first", "model").alias("rank")), "claims")
    chosen = []
    while not open_.isEmpty():
        best = lambda c, open_=open_: open_.groupBy(c).agg(F.min("rank").alias(f"{c}_best"))
        mutual = open_.join(best("cluster"), "cluster").join(best("model"), "model").where("rank = cluster_best AND rank = model_best")
        won = written(mutual.select("cluster", "model"), "won")
        rest = written(open_.join(won.select("cluster"), "cluster", "left_anti").join(won.select("model"), "model", "left_anti"), "claims")
        removed(open_)
        chosen.append(won)
        open_ = rest
    all_ = reduce(DataFrame.unionByName, chosen, pinned).select("cluster", F.col("model").cast("string").alias("model"))
    named = F.concat(F.lit("new-"), F.substring(F.sha1(F.col("cluster").cast("string")), 1, 16))
    return size.select("cluster").join(all_, "cluster", "left").select("cluster", F.coalesce("model", named).alias("model"), F.col("model").isNull().alias("created"))
