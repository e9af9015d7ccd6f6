"""Links of prints and claims by sets of names: results against plain loops, and no task that grows with the table."""

import random

from lodestone.operators import lineage, prints


def test_links_run_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(prints, "MOST_ROWS", 50, raising=False)
    rng = random.Random(4)
    key = lambda: rng.choice([None, *(f"k{i}" for i in range(40))])
    files = [(f"k{rng.randrange(40)}", f"l{i}", rng.choice([None, 1, 2, 3, 4])) for i in range(150)]
    jobs = [(i, key(), f"l{rng.randrange(150)}", rng.choice([None, 1, 2, 3]), rng.choice(["low", "high", None]), "m") for i in range(500)]
    told = [(i, rng.randrange(500), 7 if (own := rng.random() < 0.4) else None, None if own else key()) for i in range(200)]
    got = prints.effective_links(
        spark.createDataFrame(jobs, "id bigint, content_key string, location string, model_at_link bigint, link_confidence string, link_method string"),
        spark.createDataFrame(told, "id bigint, print_id bigint, model bigint, content_key string"),
        spark.createDataFrame(files, "content_key string, location string, model bigint"),
    )
    assert got.rdd.getNumPartitions() >= 10
    last, want = {p: (m, k) for _, p, m, k in told}, {}
    for i, own, at, was, sure, _ in jobs:
        model, k = last.get(i, (None, own))
        was_then = None if i in last else was
        copies = [(m, place) for c, place, m in files if c == k and m is not None] if k else []
        number = {m: sum(x == m for x, _ in copies) for m, _ in copies}
        sent = sorted(m for m, place in copies if place == at)
        owner = sent[0] if sent else min(number, key=lambda m: (m != was_then, -number[m], m)) if number else None
        if i in last:
            want[i] = (owner if model is None else model, k)
        else:
            want[i] = (owner if owner is not None else was if k or sure == "high" else None, k)
    assert {r.id: (r.model, r.key) for r in got.collect()} == want


def test_hits_of_object_sets_are_counted_without_pairs(spark):
    rng = random.Random(5)
    names = lambda: sorted({rng.choice("abc") for _ in range(2)})
    sliced = {f"f{i}": names() for i in range(30)}
    plates = [(f"f{rng.randrange(60)}", k, rng.choice([names(), names() * 2, []])) for k in range(50)] + [(None, 1, ["a"])]
    besides = sorted({(f"f{rng.randrange(30)}", f"f{rng.randrange(60)}") for _ in range(80)})
    objects = spark.createDataFrame([(f, n) for f, ns in [*sliced.items(), (None, ["a"])] for n in ns], "content_key string, name string")
    there = spark.createDataFrame(plates, "content_key string, plate_no int, names array<string>")
    pairs = {(f, p) for f, ns in sliced.items() for p, _, own in plates if p and own and sorted(set(own)) == ns and f != p}
    for out, known in ((lineage.by_object_set(objects, there), set()), (lineage.by_object_set(objects, there, spark.createDataFrame(besides, "subject string, object string")), set(besides))):
        left = pairs - known
        want = sorted((f, p, sum(x == f for x, _ in left)) for f, p in left)
        assert sorted(map(tuple, out.collect())) == want and len(want) > 20
        assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert pairs & set(besides)
