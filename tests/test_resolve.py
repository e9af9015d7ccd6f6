"""Blocking, policy, constrained clusters, assignment."""

import random

from pyspark.sql import functions as F

from lodestone.operators import graph, resolve

NODE = "key string, title string, token_count int, generic_score double, objects array<string>, designs array<string>"


def verdicts(spark, rows, lineage=None):
    nodes = spark.createDataFrame(rows, NODE)
    pairs = nodes.alias("x").join(nodes.alias("y"), F.col("x.key") < F.col("y.key")).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"), F.array(F.lit("t")).alias("via"))
    told = spark.createDataFrame(lineage, "a string, b string, signal string") if lineage else None
    return {(r.a, r.b): (r.cls, r.confidence) for r in resolve.policy(resolve.evidence(pairs, nodes, told)).collect()}


def test_two_independent_groups_join_one_suggests(spark):
    got = verdicts(spark, [("a", "red dragon", 2, 0.0, ["body", "wing"], []), ("b", "red dragon", 2, 0.0, ["body", "wing"], []), ("c", "red dragon", 2, 0.0, [], [])])
    assert got[("a", "b")] == ("auto", "high")
    assert got[("a", "c")] == ("suggest", "medium")


def test_conflicts_and_weak_evidence_are_recorded(spark):
    rows = [("a", "red dragon", 2, 0.0, ["body"], []), ("b", "red dragon", 2, 0.0, ["wheel"], []), ("c", "red dragon toy", 3, 0.0, [], []), ("d", "xyz", 1, 0.0, [], ["7"]), ("e", "other", 1, 0.0, [], ["7"]), ("f", "third", 1, 0.0, [], ["8"])]
    got = verdicts(spark, rows)
    assert got[("a", "b")] == ("record", "low")
    assert got[("a", "c")] == ("record", "low")
    assert got[("d", "e")] == ("auto", "high")
    assert got[("d", "f")] == ("record", "low")


def test_generic_and_tiny_titles_and_lineage(spark):
    rows = [("a", "box lid", 2, 1.0, [], []), ("b", "box lid", 2, 1.0, [], []), ("c", "abc", 1, 0.0, [], []), ("d", "abc", 1, 0.0, [], [])]
    got = verdicts(spark, rows, [("d", "a", "plate_md5")])
    assert got[("a", "b")] == ("record", "low")
    assert got[("c", "d")] == ("none", None)
    assert got[("a", "d")] == ("auto", "exact")


def test_blocks_above_the_bound_are_common(spark):
    rows = [(f"k{i}", "title", "same") for i in range(6)] + [("x", "title", "pair"), ("y", "title", "pair"), ("x", "objects", "o"), ("y", "objects", "o"), ("z", "objects", None)]
    blocks = spark.createDataFrame(rows, "key string, kind string, value string")
    assert [(r.a, r.b, r.via) for r in resolve.blocked_pairs(blocks, 5).collect()] == [("x", "y", ["objects", "title"])]
    assert [(r.value, r["keys"]) for r in resolve.common_blocks(blocks, 5).collect()] == [("same", 6)]


def plain_clusters(keys, edges, pins, rejects, anchors, distinct):
    side = {k: {k} for k in keys}
    pin, reject, owned = {}, {}, {}
    for table, rows in ((pin, pins), (reject, rejects), (owned, pins), (owned, anchors)):
        for k, m in rows:
            table.setdefault(k, set()).add(m)
    apart = set(distinct) | {(b, a) for a, b in distinct}
    of = lambda t, s: set().union(*(t.get(k, set()) for k in s))
    for _, _, a, b in sorted((c != "exact", a + b, a, b) for a, b, c in edges):
        x, y = side[a], side[b]
        if x is y or (of(pin, x) and of(pin, y) and of(pin, x) - of(pin, y)) or of(reject, x) & of(owned, y) or of(reject, y) & of(owned, x):
            continue
        if any((m, n) in apart for m in of(owned, x) for n in of(owned, y)):
            continue
        for k in x | y:
            side[k] = x | y
    return {k: min(s) for k, s in side.items()}


def test_constrained_clusters_equal_the_plain_rule(spark):
    rng = random.Random(4)
    keys = [f"k{i:02d}" for i in range(40)]
    edges = [(*sorted(rng.sample(keys, 2)), rng.choice(["exact", "high"])) for _ in range(50)]
    edges = list({e[:2]: e for e in edges}.values())
    pick = lambda n: [(rng.choice(keys), rng.randrange(4)) for _ in range(n)]
    pins, rejects, anchors, distinct = list(dict(pick(6)).items()), pick(5), pick(8), [(0, 1)]
    pair = lambda rows: spark.createDataFrame(rows, "key string, model bigint")
    for seed in (1, 2):  # any order of the input
        mixed = random.Random(seed).sample(edges, len(edges))
        got = resolve.constrained_clusters(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame(mixed, "a string, b string, confidence string").repartition(3), pair(pins), pair(rejects), pair(anchors), spark.createDataFrame(distinct, "a bigint, b bigint"))
        assert {r.key: r.cluster for r in got.collect()} == plain_clusters(keys, edges, pins, rejects, anchors, distinct)


def test_assignment_is_greedy_and_each_model_once(spark):
    clusters = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")], "key string, cluster string")
    pair = lambda rows: spark.createDataFrame(rows, "key string, model bigint")
    got = resolve.assigned(clusters, pair([("d", 9)]), pair([]), pair([("a", 1), ("b", 1), ("c", 1)])).collect()
    by = {r.cluster: r for r in got}
    assert by["a"].model == "1" and by["d"].model == "9" and by["c"].created and by["c"].model.startswith("new-")


def test_components_of_chains_and_empty(spark):
    keys = spark.createDataFrame([(i,) for i in range(30)], "key bigint")
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(25, 26)], "a bigint, b bigint")
    got = {r.key: r.component for r in graph.components(keys, links).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[26] == 25 and got[29] == 29
    assert graph.components(keys, links.limit(0)).count() == 30


def test_common_objects_need_unrelated_titles(spark):
    rows = [("lid", "red dragon"), ("lid", "red dragon toy"), ("lid", "car"), ("lid", "house"), ("wing", "red dragon"), ("wing", "dragon red big")]
    got = {r.name: r.groups for r in resolve.common_objects(spark.createDataFrame(rows, "name string, title string")).collect()}
    assert got == {"lid": 3}


def test_suggestions_reviews_folders_recovery(spark):
    model = spark.createDataFrame([("a", "m1"), ("b", "m2"), ("c", "m3")], "key string, model string")
    pairs = spark.createDataFrame([("a", "b", "suggest"), ("a", "c", "suggest")], "a string, b string, cls string")
    none = spark.createDataFrame([], "a string, b string")
    assert {(r.key, r.model) for r in resolve.suggestions(pairs, model, none).collect()} == {("b", "m1"), ("c", "m1")}
    apart = spark.createDataFrame([("m1", "m2")], "a string, b string")
    assert {(r.key, r.model) for r in resolve.suggestions(pairs, model, apart).collect()} == {("a", "m3"), ("c", "m1")}
    now = spark.createDataFrame([("x", "empty_model", "open"), ("y", "k", "dismissed"), ("z", "k", "auto_closed")], "subject_key string, kind string, status string")
    made = spark.createDataFrame([("y", "k"), ("z", "k"), ("new", "k")], "subject_key string, kind string")
    assert {r.subject_key: r.status for r in resolve.reviews_after(now, made).collect()} == {"x": "auto_closed", "y": "dismissed", "z": "open", "new": "open"}
    folders = spark.createDataFrame([("r", "Ann/STL"), ("r", "Bob/Ann"), ("r", "Ann"), ("r", "Ender-3 V3 KE"), ("r", "odd")], "root_id string, rel_path string")
    assert {r.rel_path: r["class"] for r in resolve.folder_classes(folders).collect()} == {"Ann/STL": "format", "Bob/Ann": "designer", "Ann": "designer", "Ender-3 V3 KE": "printer_family_like", "odd": "unknown"}
    cache = spark.createDataFrame([("f", 1, "s1"), ("g", 1, "s2"), ("g", 1, "s3")], "quick_fp string, size int, sha256 string")
    files = spark.createDataFrame([("f", 1), ("g", 1)], "quick_fp string, size int")
    assert {r.quick_fp: r.sha256 for r in resolve.recovered(cache, files).collect()} == {"f": "s1", "g": None}
