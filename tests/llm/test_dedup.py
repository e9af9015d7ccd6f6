"""Lines, fingerprints, near copies and sharding against brute force."""

import os
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import common, lines, sharding, simhash

SPACE = "\x09\x0a\x0b\x0c\x0d\x20"


def lower(t: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in t)


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    pool = ["  A shared line of more than forty characters, É and ß. ", "a shared line of more than forty characters, É and ß.", "short", "", "x" * 40, "y" * 39, "Another line that is shared by several of the documents"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 6)))) for i in range(40)] + [(3, "x" * 40), (50, None), (51, ""), (None, "x" * 40), (52, "\n".join(["z%040d" % i for i in range(3000)]))]
    docs = spark.createDataFrame([(i, t, "own", 7) for i, t in rows], "doc_id bigint, text string, kept string, h1 int")
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = lower(line.strip(SPACE))
            if len(key) >= 40 and i is not None:
                holders.setdefault(key, set()).add(i)
    want = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        stay = [x for x in all_ if i is None or not (len(holders.get(lower(x.strip(SPACE)), ())) >= 5 and max(holders[lower(x.strip(SPACE))]) != i)]
        want.append((str(i), "\n".join(stay), len(all_), len(all_) - len(stay), "own"))
    got = [(str(r.row.doc_id), r.kept, r.n_lines, r.n_dropped, r.row.kept) for r in lines.dedup_lines(docs).collect()]
    assert sorted(got) == sorted(want)
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_runs_tell_fresh_from_known_and_compact(spark):
    runs = lines.LineRuns(spark, fanout=2)
    batch = lambda *rows: spark.createDataFrame(rows, "h1 bigint, h2 bigint, id bigint")
    assert {(r.h1, r.fresh) for r in runs.add(batch((1, 1, 10), (2, 2, 10), (1, 1, 11))).collect()} == {(1, True), (2, True)}
    assert {(r.h1, r.fresh) for r in runs.add(batch((1, 1, 12), (3, 3, 12))).collect()} == {(1, False), (3, True)}
    runs.add(batch((1, 1, 5)))
    assert [len(level) for level in runs.levels] == [1, 1]
    assert {(r.h1, r.n_docs, r.keeper) for r in runs.totals().collect()} == {(1, 4, 12), (2, 1, 10), (3, 1, 12)}
    # Over many batches and compactions a key stays fresh once, and its totals are those of all batches.
    rng, want = random.Random(2), {}
    runs = lines.LineRuns(spark, fanout=2)
    for k in range(6):
        rows = {(h, h, 10 * k + d) for h in rng.sample(range(9), 4) for d in range(rng.randint(1, 3))}
        fresh = {h for h, *_ in rows} - set(want)
        for h, _, i in rows:
            n, top = want.get(h, (0, -1))
            want[h] = (n + 1, max(top, i))
        assert {r.h1 for r in runs.add(batch(*rows)).collect() if r.fresh} == fresh
    assert {r.h1: (r.n_docs, r.keeper) for r in runs.totals().collect()} == want


@pytest.mark.parametrize("radius", [2, 4])
def test_covering_guarantee(radius):
    rng, masks = random.Random(1), simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        apart = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(apart & m == 0 for m in masks)


def plain_print(text, words=4):
    w = lower(text or "").encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, ids, radius):
    root = {i: i for i in ids}
    find = lambda x: x if root[x] == x else find(root[x])
    for k, (a, i) in enumerate(zip(prints, ids, strict=True)):
        for b, j in zip(prints[:k], ids[:k], strict=True):
            if (a ^ b).bit_count() <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choices("Alpha beta gamma Delta é zeta eta theta iota".split(), k=300)) for _ in range(6)]
    rows = []
    for i in range(80):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 1, 2, 5])):
            words[rng.randrange(len(words))] = f"w{rng.randrange(50)}"
        rows.append((i, " ".join(words)))
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "one two"), (104, "ONE two"), (105, "word " * 30_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, fp int")
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = [plain_print(t) for _, t in rows]
    want = plain_components(prints, [i for i, _ in rows], 4)
    assert got == {i: (p, want[i]) for (i, _), p in zip(rows, prints, strict=True)}
    assert len({c for _, c in got.values()}) < len(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_large_buckets_link_by_midpoints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 3)
    rng = random.Random(6)
    centre = [rng.getrandbits(64) for _ in range(3)]
    prints = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for c in centre for _ in range(40)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.link_fingerprints(spark.createDataFrame([(p,) for p in signed], "fp bigint"), 4)
    got = {r.node: r.component for r in common.components(links).collect()}
    want = plain_components(prints, list(range(len(prints))), 4)
    same = lambda a, b: got.get(signed[a], signed[a]) == got.get(signed[b], signed[b])
    for a in range(len(prints)):
        for b in range(a):
            assert same(a, b) == (want[a] == want[b])


def test_near_copies_by_shingle_similarity(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: rng.choices(vocabulary, k=n)
    rows, clean = [], []
    for g in range(12):
        own = text(500)
        near = list(own)
        for _ in range(4):
            near[rng.randrange(500)] = "changed"
        rows += [(10 * g, " ".join(own)), (10 * g + 1, " ".join(near)), (10 * g + 2, " ".join(own)), (10 * g + 3, " ".join(text(500)))]
        clean.append(10 * g + 3)
    rows += [(1000, None), (1001, ""), (1002, " ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert all(got[10 * g + k] == 10 * g for g in range(12) for k in (0, 1, 2))
    assert all(got[i] == i for i in [*clean, 1000, 1001, 1002]) and len(got) == len(rows)
    assert simhash.near_copies(docs.limit(0)).count() == 0


def test_near_copies_are_decided_by_jaccard(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for g in range(60):
        own = [f"g{g}x{i}" for i in range(rng.randrange(120, 400))]
        rows.append((10 * g, " ".join(own)))
        want[10 * g] = 10 * g
        n = len(own) - 4  # a cut tail leaves a subset: the similarity is the share of shingles kept
        for k, share in ((1, 0.75), (2, 0.8), (3, 0.85)):
            if k == 1 + g % 3:
                kept = -(-n * int(100 * share + 0.5) // 100)
                rows.append((10 * g + k, " ".join(own[: kept + 4])))
                want[10 * g + k] = 10 * g if kept >= 0.8 * n else 10 * g + k
    # One large group that a chain joins, and a text of equal words that differs in its rare shingles only.
    chain = [f"c{i}" for i in range(900)]
    for k in range(40):
        rows.append((2000 + k, " ".join(chain[10 * k : 10 * k + 200])))
        want[2000 + k] = 2000
    for k in range(2):
        rows.append((3000 + k, " ".join(["same"] * 2000 + [f"r{k}x{i}" for i in range(100)])))
        want[3000 + k] = 3000 + k
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert got == want


def test_near_copies_link_fingerprints_first(spark):
    """Bands that find nothing (no pair has more equal bytes than there are) leave what fingerprints link and the sets confirm."""
    rng = random.Random(21)
    rows, want = [], {}
    for g in range(8):
        own = [f"g{g}x{rng.randrange(9000)}" for _ in range(1500)]
        near = list(own)
        near[rng.randrange(1500)] = "changed"
        rows += [(10 * g, " ".join(own)), (10 * g + 1, " ".join(near))]
        print_ = simhash.fingerprints_of([t for _, t in rows[-2:]], 5)[:, 0]
        want |= {10 * g: 10 * g, 10 * g + 1: 10 * g + (int(print_[0] ^ print_[1]).bit_count() > 4)}
    for k in range(2):  # fingerprints of one repeated shingle, sets that are far apart
        rows.append((3000 + k, " ".join(["same"] * 2000 + [f"r{k}x{i}" for i in range(100)])))
        want[3000 + k] = 3000 + k
    prints = simhash.fingerprints_of([t for _, t in rows[-2:]], 5)[:, 0]
    assert int(prints[0] ^ prints[1]).bit_count() <= 4 and sum(v % 10 == 0 for v in want.values()) > 12
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs, bands=1, depth=8, alike=9).collect()}
    assert got == want


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 150)) and len(got) == 111


def test_shards_fit_and_form_a_directory(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "x" * int(n)) for i, n in enumerate(rng.integers(0, 300, 500))] + [(7, "y" * 5000)] + [(8, "same text")] * 300 + [(None, None), (9, None)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id bigint, text string, shard string")
    got = sharding.assign_shards(docs, 1000).collect()
    assert len(got) == len(rows)
    sums, number = {}, {}
    for r in got:
        sums[r.shard] = sums.get(r.shard, 0) + r.n_bytes
        number[r.shard] = number.get(r.shard, 0) + 1
    assert all(b <= 1000 or number[s] == 1 for s, b in sums.items())
    assert all(r.shard_bytes == sums[r.shard] and r.depth == len(r.shard) for r in got)
    assert not any(a != b and b.startswith(a) for a in sums for b in sums)
    # Only oversized buckets were split: the parent of every bucket is too large.
    for s in sums:
        if s:
            assert sum(b for t, b in sums.items() if t.startswith(s[:-1])) > 1000
    assert sharding.assign_shards(docs.limit(0), 10).count() == 0


def test_shard_files(spark, tmp_path):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("z" * 50).alias("text"))
    found = sharding.write_shards(docs.withColumn("_shard", F.lit(1)), f"{tmp_path}/s", 2000)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == 200 and back.select("__shard").distinct().count() == found.select("shard").distinct().count()
    assert back.where("_shard = 1").count() == 200


def test_a_large_group_of_near_copies_against_brute_force(spark, monkeypatch):
    """Texts that differ from one source in places of their own, and from each other in places that a few share."""
    monkeypatch.setattr(simhash, "SMALL", 4)
    monkeypatch.setattr(simhash, "PART", 30)
    rng = random.Random(12)
    source = [f"s{i}" for i in range(120)]
    rows, made = [(0, list(source))], 0
    for i in range(1, 150):
        own = list(rng.choice([source, source, rows[-1][1], rng.choice(rows)[1]]))
        for _ in range(rng.choice([1, 2, 3, 4, 6])):
            own[rng.randrange(len(own))] = f"n{rng.randrange(400)}"
        if i % 9 == 0:
            own = own[: rng.randrange(80, 120)]
        rows.append((i, own))
    sets = [{" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for _, w in rows]
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {i: find(i) for i in range(len(rows))}
    assert 5 < len(set(want.values())) < 140
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert got == want


def test_tables_are_removed(spark):
    table = common.stored(spark.range(3), "three")
    assert table.count() == 3
    path = table._lodestone_path.removeprefix("file:")
    assert os.path.isdir(path)
    common.remove_tables(spark)
    assert not os.path.isdir(path)
    common.dropped(table)  # harmless
