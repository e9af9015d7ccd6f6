"""Constrained clusters in rounds against the sequential rule."""

import random

import pytest

from lodestone.operators import genericity, graph
from lodestone.operators.clusters import assigned, constrained_clusters
from lodestone.operators.genericity import common_objects
from lodestone.sources import storage


def sequential(keys, edges, pins, rejects, anchors, distinct):
    """Edges one by one; smaller sides join larger ones."""
    parent = {k: k for k in keys}
    least = {k: k for k in keys}
    pin = {k: set() for k in keys}
    models = {k: set() for k in keys}
    apart = {k: set() for k in keys}
    for key, model in pins:
        pin[key].add(model)
        models[key].add(model)
    for key, model in anchors:
        models[key].add(model)
    for key, model in rejects:
        apart[key].add(model)
    kept = [(a, b) for a, b in distinct if a != b]
    size = dict.fromkeys(keys, 1)

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b, _ in sorted(edges, key=lambda e: (e[2] != "exact", e[0] + e[1], e[0])):
        x, y = find(a), find(b)
        if x == y:
            continue
        if size[x] < size[y]:
            x, y = y, x
        if pin[x] and pin[y] and pin[x] != pin[y] or apart[x] & models[y] or apart[y] & models[x]:
            continue
        if any(m in models[x] and n in models[y] or n in models[x] and m in models[y] for m, n in kept):
            continue
        parent[y] = x
        size[x] += size[y]
        least[x] = min(least[x], least[y])
        for sets in (pin, models, apart):
            sets[x] |= sets[y]
    return {k: least[find(k)] for k in keys}


def run(spark, keys, edges, pins, rejects, anchors, distinct, fold_most=0):
    pair = lambda rows: spark.createDataFrame(rows, "key string, model bigint")
    got = constrained_clusters(
        spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame(edges, "a string, b string, confidence string"), pair(pins), pair(rejects), pair(anchors), spark.createDataFrame(distinct, "a bigint, b bigint"), fold_most
    )
    return {r.key: r.cluster for r in got.collect()}


@pytest.mark.parametrize("seed, fold_most", [(1, 0), (2, 20), (3, 1000)])
def test_random_graphs(spark, seed, fold_most):
    """By rounds alone, by rounds and then one by one, and one by one."""
    rng = random.Random(seed)
    keys = [f"k{i:03d}" for i in range(60)]
    edges = list({e[:2]: e for e in [(*sorted(rng.sample(keys, 2)), rng.choice(["exact", "high"])) for _ in range(80)]}.values())
    pick = lambda n, models: [(rng.choice(keys), rng.randrange(models)) for _ in range(n)]
    pins, rejects, anchors = list(dict(pick(12, 4)).items()), pick(8, 6), pick(30, 6)
    distinct = [(0, 1), (4, 5)]
    want = sequential(keys, edges, pins, rejects, anchors, distinct)
    assert run(spark, keys, edges, pins, rejects, anchors, distinct, fold_most) == want
    assert len(set(want.values())) > len(set(sequential(keys, edges, [], [], [], []).values()))  # decisions did divide


def test_one_component_of_many_keys(spark):
    n = 100_000
    keys = [f"k{i:06d}" for i in range(n)]
    edges = [(keys[0], k, "high") for k in keys[1 : n // 2]]  # a hub
    edges += [(keys[i], keys[i + 1], "exact") for i in range(n // 2 - 1, n - 1)]  # and a chain in the order of the rule
    rng = random.Random(5)
    pins = [(keys[0], 1)] + [(k, rng.choice([1, 2])) for k in rng.sample(keys[1:], 3000)]
    rejects = [(k, 3) for k in rng.sample(keys, 500)]
    anchors = [(k, rng.choice([3, 4])) for k in rng.sample(keys, 500)] + [(k, 100 + i) for i, k in enumerate(keys)]  # a model of its own for every key
    want = sequential(keys, edges, pins, rejects, anchors, [(3, 4)])
    assert len(set(want.values())) > 500
    assert run(spark, keys, edges, pins, rejects, anchors, [(3, 4)], 5000) == want


def test_ends_that_are_no_keys_repeats_and_nothing(spark):
    assert run(spark, ["a", "b", "c"], [("a", "x", "high"), ("x", "b", "high"), ("a", "a", "exact"), ("b", "c", "high"), ("b", "c", "high")], [], [], [], []) == {"a": "a", "b": "b", "c": "b"}
    assert run(spark, [], [], [], [], [], []) == {}


def test_assignment_takes_second_choices_and_only_live_models(spark):
    clusters = spark.createDataFrame([(f"{c}{i}", c) for c in "abcd" for i in range(2)], "key string, cluster string")
    pair = lambda rows: spark.createDataFrame(rows, "key string, model bigint")
    anchors = pair([("a0", 1), ("a1", 1), ("b0", 1), ("b1", 1), ("b0", 2), ("b1", 2), ("c0", 2), ("c0", 3), ("d0", 9), ("d1", 9)])
    by = {r.cluster: r.model for r in assigned(clusters, pair([]), pair([]), anchors, spark.createDataFrame([(1,), (2,), (3,)], "model bigint")).collect()}
    assert (by["a"], by["b"], by["c"]) == ("1", "2", "3") and by["d"].startswith("new-")
    by = {r.cluster: r.model for r in assigned(clusters, pair([("a0", 7), ("b0", 7)]), pair([("d0", 9)]), anchors).collect()}
    assert by == {"a": "7", "b": "7", "c": "2", "d": "9"}


def related(a, b):
    """The rule for two titles, said plainly."""
    letters = lambda t: "".join(c for c in t if c.isalnum())
    x, y = letters(a), letters(b)
    if sorted(a.split()) == sorted(b.split()) or len(b) >= 4 and f" {b} " in f" {a} " or len(a) >= 4 and f" {a} " in f" {b} ":
        return True
    return len(x) >= 4 and len(y) >= 4 and (x in y or y in x)


def groups_of(titles):
    left, firsts = sorted(set(titles)), []
    while left:
        group, rest = [left[0]], left[1:]
        for t in group:
            near = [r for r in rest if related(t, r)]
            group += near
            rest = [r for r in rest if r not in near]
        firsts.append(min(group))
        left = rest
    return sorted(firsts)


def test_common_objects_equal_the_plain_rule(spark):
    rng = random.Random(7)
    words = ["tiny", "t-rex", "trex", "dragon", "red", "a", "b", "x2", "cat", "hat", "kitty", "flexi"]
    rows = [(f"n{rng.randrange(12)}", rng.choice([" ", ""]).join(rng.choices(words, k=rng.randrange(1, 4)))) for _ in range(300)]
    rows += [("chain", t) for t in ("tinytrex", "tiny t-rex", "rex t- tiny", "my tiny t-rex two", "car", "house")]
    rows += [("pair", "red dragon"), ("pair", "big red dragon"), ("pair", "dragon x red"), ("gap", "red big dragon"), ("gap", "red dragon"), ("gap", "boat"), (None, "x"), ("gap", None), ("gap", "")]
    got = {r.name: (r.groups, r.titles) for r in common_objects(spark.createDataFrame(rows, "name string, title string")).collect()}
    by = {}
    for name, title in rows:
        if name and title:
            by.setdefault(name, set()).add(title)
    want = {n: groups_of(ts) for n, ts in by.items()}
    assert got == {n: (len(g), g[: genericity.TOLD]) for n, g in want.items() if len(g) >= 3}
    assert got["chain"][0] == 4 and got["gap"][0] == 3 and "pair" not in got


def test_common_objects_of_one_name_with_many_titles(spark):
    rows = [("body", f"model {i:05d}") for i in range(5000)] + [("body", f"model {i:05d} blue") for i in range(5000)]
    got = common_objects(spark.createDataFrame(rows, "name string, title string")).collect()
    assert [(r.name, r.groups) for r in got] == [("body", 5000)]


def test_labels_of_components_are_never_broadcast(spark, monkeypatch):
    plans = []

    def told(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return storage.written(df, name)

    monkeypatch.setattr(graph, "written", told)
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "a string, b string")
    keys = spark.createDataFrame([(k,) for k in "abcdef"], "key string")
    got = {r.key: r.component for r in graph.components(keys, links).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)
