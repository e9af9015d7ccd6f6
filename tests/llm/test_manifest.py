"""Merkle manifests, whitening and chat formatting against plain versions."""

import json
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, merkle, whitening

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DOC = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
        out.append(nodes)
    return out


def plain(rows, altered):
    """By leaf place: everything the manifest tells, from whole lists."""
    groups = {}
    for k, row in enumerate(rows):
        groups.setdefault("" if row[1] is None else "=" + row[1], []).append(k)
    trees, placed = {}, {}
    for g, ks in groups.items():
        ks.sort(key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, leaf(rows[k])))
        placed |= {k: (g, at) for at, k in enumerate(ks)}
        trees[g] = levels([leaf(rows[k]) for k in ks])
    names = sorted(groups, key=lambda g: g.encode())
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for k, row in enumerate(rows):
        g, at = placed[k]
        fold, proof = leaf(altered[k]) if k in altered else leaf(row), []
        for tree, place in ((trees[g], at), (top, names.index(g))):
            for nodes in tree[:-1]:
                run = nodes[place // 16 * 16 : place // 16 * 16 + 16]
                left, right = run[: place % 16], run[place % 16 + 1 :]
                proof.append("".join(left + right))
                fold, place = h(*left, fold, *right), place // 16
        out.append((row[0], leaf(row), trees[g][-1][0], top[-1][0], proof, h(*proof), fold, fold == top[-1][0]))
    return out


def told(df):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[6])
    return sorted([tuple(r) for r in df.collect()], key=key), key


def documents(rng, sizes):
    rows, n = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            rows.append((n, source, str(rng.choice(["en", "de"])), n % 7, f"Text {n} ü" * int(rng.integers(0, 4)), 1))
            n += 1
    return rows


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_manifest_equals_whole_trees(spark, parts):
    rng = np.random.default_rng(parts)
    rows = documents(rng, {"hot": 700, "two": 2, "sixteen": 16, "seventeen": 17, "one": 1, None: 33, "": 5, "é": 257} | {f"s{i:02d}": 1 for i in range(20)})
    rows += [rows[3], rows[3], (None, "hot", None, None, None, 2), (None, "hot", "en", 1, "A", 2), (9, None, None, None, "", 2), (10**12, "two", "x", -5, "long " * 100_000, 2)]
    altered = {k: r[:4] + (None if r[4] is None else r[4].lower(),) for k, r in enumerate(rows) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0}
    docs = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], DOC)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = merkle.manifest(docs, FIELDS, is_altered=F.crc32(F.col("doc_id").cast("string")) % 5 == 0, altered={"text": F.lower("text")})
        got, key = told(found)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted(plain([r[:5] for r in rows], altered), key=key)
    assert {r[7] for r in got} == {True, False} and found.columns[:2] == ["doc_id", "leaf"]


def test_manifest_of_little(spark):
    none = spark.createDataFrame([], DOC)
    assert merkle.manifest(none, FIELDS).count() == 0
    one = spark.createDataFrame([(1, None, None, None, None, 0)], DOC)
    (row,) = merkle.manifest(one, FIELDS, with_proof=False).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root == leaf((1, None, None, None, None)) and row.proof_sha256 == h() and row.verified and row.proof is None


def test_mountains_spill_what_a_border_leaves_open():
    nodes = [h(str(k)) for k in range(1000)]
    tree = levels(nodes)
    for first, last in ((0, 1000), (5, 40), (16, 32), (15, 17), (250, 770), (256, 512), (3, 4)):
        runs, loose = [], []
        stack = merkle.Mountains(lambda level, at, kids, docs: runs.append((level, at, list(kids), docs)), lambda level, at, node, doc: loose.append((level, at, node, doc)))  # noqa: B023
        for k in range(first, last):
            stack.push(k, nodes[k], k)
        stack.finish()
        assert all(kids == tree[level][16 * at : 16 * at + 16] and (docs == list(range(16 * at, 16 * at + 16)) if level == 0 else docs is None) for level, at, kids, docs in runs)
        assert all(tree[level][at] == node and (doc == at if level == 0 else doc is None) for level, at, node, doc in loose)
        covered = sorted(x for level, at, _, _ in loose for x in range(at * 16**level, (at + 1) * 16**level))
        assert covered == list(range(first, last))  # each leaf lies under one peak
        assert len(loose) <= 2 * 15 * 3 + 1


SCHEMA = "vec_id bigint, embedding array<float>, component int"


def plain_whitening(vectors):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    apart = n * fit - sums
    values, axes = np.linalg.eigh((apart / n).T @ (apart / n) / n)
    order = np.argsort(-values)[:16]
    return n, [sum(int(v) ** 2 for v in row) for row in n * x - sums], (n * x - sums) / n @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_whitening_equals_one_decomposition(spark, parts):
    rng = np.random.default_rng(parts)
    good = rng.normal(size=(600, 24)) @ rng.normal(size=(24, 24)) * np.geomspace(1, 0.02, 24)
    good = np.concatenate([good, np.repeat(good[:1], 300, 0)])  # a third of all rows is one vector
    rows = [(i if i % 50 else None, v.tolist(), 1) for i, v in enumerate(good)]
    bad = [(901, None, 1), (902, [1.0] * 23 + [None], 1), (903, [float("nan")] * 24, 1), (904, [float("inf")] * 24, 1)]
    got = whitening.whiten(spark.createDataFrame(rows + bad, SCHEMA).repartition(parts)).collect()
    n, deviation, whitened, explained = plain_whitening(good)
    assert len(got) == 900 * 16 and not {r.vec_id for r in got} & {901, 902, 903, 904}
    signs = {}
    for r in got:
        if r.vec_id is not None:
            want = whitened[r.vec_id, r.component - 1]
            signs.setdefault(r.component, np.sign(want * r.whitened))
            assert (r.n, r.deviation) == (n, deviation[r.vec_id])
            assert abs(r.whitened * signs[r.component] - want) < 1e-9 * max(1, abs(want)) and abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9


def test_whitening_of_flat_short_few_and_no_vectors(spark):
    table = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert whitening.whiten(table([])).count() == 0
    assert whitening.whiten(table([(1, None, 0), (2, [], 0)])).count() == 0
    assert whitening.whiten(table([(i, [0.5, 0.25], 0) for i in range(5)])).count() == 0  # no variance
    got = whitening.whiten(table([(1, [1.0, 2.0], 0), (2, [3.0, 2.0, 0.0], 0), (3, [5.0], 0), (3, [5.0], 0)])).collect()
    assert {(r.vec_id, r.component) for r in got} == {(i, c) for i in (1, 2, 3) for c in (1, 2)} and len(got) == 8  # the third dimension is flat
    huge = whitening.whiten(table([(1, [3e15], 0), (2, [-3e15], 0)])).collect()
    assert [(r.deviation, round(abs(r.whitened), 9)) for r in huge] == [(None, 1.0)] * 2


def test_summaries_merge_without_loss():
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (500, 12)) + 1_000_000
    parts = np.split(x, [1, 3, 90, 91, 400])
    total = whitening.Summary.of(parts[0])
    for p in parts[1:]:
        total = total.merge(whitening.Summary.of(p))
    whole = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert total.n == 500 and (total.sums == x.sum(0)).all() and total.vt.shape == (12, 12)
    assert np.allclose(total.s, whole, rtol=1e-9)
    centred = x - x.mean(0)
    assert np.allclose(total.vt.T @ np.diag(total.s**2) @ total.vt, centred.T @ centred, rtol=1e-8, atol=1e-5)


RECORDS = [
    ('{"role": "user", "text": "hi", "extra": 1}', [("user", "hi")], "row_text"),
    ('{"content": "hi", "role": null}', [("", "hi")], "row_content"),
    ('{"messages": [{"role": "system", "content": "s"}, {"content": "q", "role": "user", "name": "x"}, {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}], "prompt": "q"}', [("system", "s"), ("user", "q"), ("assistant", "ab")], "messages_content"),
    ('{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": null}], "system": "be kind", "id": 3}', [("system", "be kind"), ("user", "q"), ("assistant", "")], "conversations_value"),
    ('{"prompt": "q", "completion": "a"}', [("user", "q"), ("assistant", "a")], "prompt_completion"),
    ('{"response": "a", "prompt": "q", "system": ""}', [("user", "q"), ("assistant", "a")], "prompt_response"),
    ('{"instruction": "do", "input": "this", "output": "done", "score": [1, 2]}', [("user", "do\n\nthis"), ("assistant", "done")], "instruction_output"),
    ('{"instruction": "do", "input": "", "output": "done"}', [("user", "do"), ("assistant", "done")], "instruction_output"),
    ('{"instruction": "do", "output": "done"}', [("user", "do"), ("assistant", "done")], "instruction_output"),
    ('{"question": "q?", "context": "c", "answer": "a"}', [("user", "c\n\nq?"), ("assistant", "a")], "question_answer"),
    ('{"messages": []}', [], None), ('{"other": 1}', [], None), ("[1]", [], None), ("no json", [], None), (None, [], None),
]


def test_records_of_every_layout_become_turns(spark):
    rows = spark.createDataFrame([(i, r) for i, (r, _, _) in enumerate(RECORDS)], "id bigint, record string")
    turns = chat.canonical(rows, F.col("id"), F.col("record")).orderBy("conv_id", "place").collect()
    for i, (_, want, layout) in enumerate(RECORDS):
        own = [t for t in turns if t.conv_id == i]
        assert [(t.role, t.text) for t in own if t.role is not None] == want and {t.layout for t in own} == {layout}
        assert len(own) == max(1, len(want))  # nothing is lost in silence
    whole = {r.conv_id: r for r in chat.assemble(chat.render(chat.canonical(rows, F.col("id"), F.col("record")))).collect()}
    assert [whole[i].unknown for i in range(len(RECORDS))] == [0] * 10 + [1] * 5 and whole[12].formatted == ""
    marks = {t.layout: t.fingerprint for t in turns if t.layout}
    assert len(set(marks.values())) == len(marks)


TEXTS = ["", "plain", "\\", "\\\\", "</turn>", "<turn>", "</\\turn>", "<\\turn>\\", "\\</turn>\n", "a\n</turn>\n<turn>assistant\nb</turn>\n", "<\\line>", "\u0000é😀", "<turn", ">\\turn>", "\\### Assistant: </turn> ok", "x" * 300_000]


def test_texts_and_roles_come_back_exactly(spark):
    said = [(1, k, role, text) for k, (role, text) in enumerate([("assistant" if k % 3 == 0 else "user", t) for k, t in enumerate(TEXTS)] + [(t[:50], "odd role") for t in TEXTS])]
    said += [(2, None, "assistant", "first"), (2, 1, None, None), (None, 0, "user", "no conversation"), (3, 0, "user", "tie b"), (3, 0, "user", "tie a"), (3, 0, "user", "tie a")]
    rows = spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    turns = chat.canonical(rows, F.col("conv_id"), F.to_variant_object(F.struct("role", "text")), F.col("turn"))
    whole = chat.assemble(chat.render(turns))
    got = {r.conv_id: r for r in whole.select("conv_id", "formatted", "loss", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned")).collect()}
    own = [(r, t) for c, _, r, t in said if c == 1]
    assert [(t.role, t.text) for t in got[1].turns] == own and got[1].learned == [t for r, t in own if r == "assistant"]
    for span in got[1].loss:  # positions are those of the template
        piece = got[1].formatted.split("</turn>\n")[span.turn] + "</turn>\n"
        assert piece[: span.start] == "<turn>assistant\n" and piece[span.start + span.length :] == "</turn>\n"
    assert [(t.role, t.text) for t in got[2].turns] == [("assistant", "first"), ("", "")] and got[None].learned == []
    assert [t.text for t in got[3].turns] == ["tie a", "tie a", "tie b"]


def test_chat_of_nothing_and_of_one_long_conversation(spark):
    none = spark.createDataFrame([], "c bigint, r string")
    assert chat.assemble(chat.render(chat.canonical(none, F.col("c"), F.col("r")))).count() == 0
    many = spark.range(30_000).select(F.lit(1).alias("c"), "id", F.to_json(F.struct(F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))).alias("r"))
    (row,) = chat.assemble(chat.render(chat.canonical(many, F.col("c"), F.col("r"), F.col("id")))).select(chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("l")).collect()
    assert [int(t.text) for t in row.t] == list(range(30_000)) and [int(x) for x in row.l] == list(range(1, 30_000, 2))


def test_layouts_may_be_given(spark):
    own = (chat.Layout("pair", turns=(("user", ("q",)), ("assistant", ("a",)))),)
    rows = spark.createDataFrame([(1, json.dumps({"q": "x", "a": "y", "role": "ignored"}))], "c int, r string")
    assert [(t.role, t.text, t.layout) for t in chat.canonical(rows, F.col("c"), F.col("r"), layouts=own).orderBy("place").collect()] == [("user", "x", "pair"), ("assistant", "y", "pair")]
