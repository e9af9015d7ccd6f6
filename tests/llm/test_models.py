"""Language identification, language-model scores, vectors and the pipeline."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import embeddings, langid, lm, pretoken, topk

WORDS = {"en": "the and with thing that was here".split(), "fr": "été là où déjà garçon être".split(), "de": "über straße schön für können".split()}


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randint(3, 60))), lang))
    return rows


EDGE = [(1000, None, "en"), (1001, "", None), (1002, "123 $$$ \n", "fr"), (1003, "the thing " * 5000, None), (5, "the thing", "en"), (None, "été là", "fr")]


def test_language_id_learns_and_never_sees_labels(spark):
    rows = corpus() + EDGE
    docs = spark.createDataFrame([(i, t, la, 1.5) for i, t, la in rows], "doc_id bigint, text string, lang string, score double")
    learns = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    model = langid.fit(docs, learns)
    assert (np.count_nonzero(model.weights) / model.weights.size) < 0.05
    got = langid.identify(docs.drop("lang"), model).collect()
    by = {r.row.doc_id: r for r in got}
    held = [(i, la) for i, _, la in corpus() if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([by[i].lang_pred == la for i, la in held]) > 0.95 and len(got) == len(rows)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "en" and all(0 <= r.score <= 1 for r in got) and by[1003].row.score == 1.5
    assert langid.identify(docs.limit(0), model).count() == 0
    assert langid.fit(docs.where("lang = 'none'"), F.lit(True)) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


def test_predictions_do_not_depend_on_the_step(monkeypatch):
    rows = [(la, *np.unique(langid.grams([t])[0], return_counts=True)) for _, t, la in corpus(60)]
    model = langid.train([(la, at.astype(np.int64), n / n.sum()) for la, at, n in rows])
    texts = ["the thing was here " * 50, None, "été là", "", "ü", "straße für " * 30]
    want = model.predict(texts)
    monkeypatch.setattr(langid, "STEP", 21)
    got = model.predict(texts)
    assert got[0] == want[0] and np.allclose(got[1], want[1])


def test_more_languages_than_a_table_of_old_held(spark):
    rows = [(100 * k + i, " ".join([f"word{chr(97 + k % 26)}{chr(97 + k // 26)}"] * 9), f"l{k}") for k in range(80) for i in range(4)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True))
    assert len(model.languages) == 80


def test_training_against_a_plain_loop():
    """Follow-the-regularised-leader with elastic net, one weight at a time."""
    rows = [(la, *np.unique(langid.grams([t])[0], return_counts=True)) for _, t, la in corpus(8)]
    data = [(la, at.astype(np.int64), n / n.sum()) for la, at, n in rows]
    model = langid.train(data, epochs=2)
    langs = sorted({r[0] for r in data})
    holders = {}
    for _, at, _ in data:
        for a in at.tolist():
            holders[a] = holders.get(a, 0) + 1
    idf = {a: math.log((1 + len(data)) / (1 + n)) + 1 for a, n in holders.items()}
    scale = 1 / np.mean([math.sqrt(sum((x * idf[a]) ** 2 for a, x in zip(at.tolist(), v, strict=True))) for _, at, v in data])
    z, n, bias, bias_n = {}, {}, [0.0] * len(langs), [0.0] * len(langs)

    def weight(a, k):
        if abs(z.get((a, k), 0.0)) <= 0.02:
            return 0.0
        return -(z[a, k] - math.copysign(0.02, z[a, k])) / ((1 + math.sqrt(n[a, k])) / 0.5 + 0.01)

    for _ in range(2):
        for i in np.random.default_rng(3).permutation(len(data)).tolist():
            la, at, v = data[i]
            x = {a: f * idf[a] * scale for a, f in zip(at.tolist(), v, strict=True)}
            w = {(a, k): weight(a, k) for a in x for k in range(len(langs))}
            e = [math.exp(sum(x[a] * w[a, k] for a in x) + bias[k]) for k in range(len(langs))]
            for k, name in enumerate(langs):
                p = e[k] / sum(e) - (name == la)
                for a in x:
                    g, old = x[a] * p, n.get((a, k), 0.0)
                    z[a, k] = z.get((a, k), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / 0.5 * w[a, k]
                    n[a, k] = old + g * g
                bias_n[k] += p * p
                bias[k] -= 0.1 * p / math.sqrt(1 + bias_n[k])
    for a in holders:
        for k in range(len(langs)):
            assert model.weights[a, k] == pytest.approx(weight(a, k) * idf[a] * scale, abs=1e-5)
    assert model.temperature == 1.0 and model.bias == pytest.approx(bias)


def test_grams_do_not_depend_on_the_batch():
    texts = ["abc", "", "É ß 日本", None, "x"]
    all_, bounds, _ = langid.grams(texts)
    for i, t in enumerate(texts):
        assert (all_[:, bounds[i] : bounds[i + 1]] == langid.grams([t])[0]).all()


def scores(spark, rows):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows], "doc_id bigint, text string, score double")
    return lm.score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 1)


def test_scores_base_and_totals(spark):
    rows = [(i, f"{t} {'' if i % 3 else 'Ünusual' + str(i)} averyveryverylongword{i % 4}", la) for i, t, la in corpus(300)] + [e for e in EDGE if e[0] is not None]
    got = scores(spark, rows).collect()
    assert len(got) == len(rows)
    count = {}
    trains = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    tokens = {(i, t): [w for w in (t or "").encode().lower().split()] + [b"\n"] for i, t, _ in rows}
    for (i, _), ws in tokens.items():
        if trains(i):
            for w in ws:
                count[w] = count.get(w, 0) + 1
    total, distinct = sum(count.values()), len(count)
    want = sorted((i, len(ws), sum(w in count for w in ws), sum(math.log10((count.get(w, 0) + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)) for (i, _), ws in tokens.items())
    mine = sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got)
    for a, b in zip(mine, want, strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9)
    assert all(r.train_tokens == total and r.score < 0 and r.learned == trains(r.doc_id) for r in got)
    held = [r for r in got if not r.learned]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert scores(spark, rows).where("doc_id < 0").count() == 0
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert lm.score_texts(docs, F.lit(True)).count() == 0


def test_spelled_probabilities_add_up_to_at_most_one():
    tokens = [bytes([a]) for a in range(33, 127)] + [lm.END]
    place, count = np.arange(len(tokens)) % 3, np.arange(1, len(tokens) + 1)
    slots, bits, owner, _ = lm.spelled(tokens, place)
    table = np.zeros((2, int(lm.table_starts(0)[-1])), np.float32)
    for k in range(len(lm.CONTEXTS)):
        np.add.at(table, (bits, slots[k]), count[owner])
    table = lm.Table(lm.packed(table))
    mixer = lm.Mixer.new()
    mixer.learn(table, tokens, place, count)
    for same in range(3):
        assert (10 ** mixer.score(table, tokens, np.full(len(tokens), same), False)).sum() <= 1 + 1e-9


def plain_scores(rows, trains, model):
    """Scores of the texts one token and one bit at a time; counts are recounted, only the weights are the model's."""
    tokens = [[*(t or "").encode().lower().split(), lm.END] for _, t in rows]
    kind = [int(model.kinds.of([t])[0]) for _, t in rows]
    leads = {}
    for w in {w for ws in tokens for w in ws if len(w) <= 15}:
        low, high, _ = pretoken.keys(w, np.array([0]), np.array([len(w)]))
        leads[w] = int(model.kinds.leads.find(low, high)[0])
    lead = lambda ws, i: 0 if i == 0 else leads.get(ws[i - 1], -1) + 1 or lm.OTHER
    spelled = {}

    def spell(w, place):
        if (w, place) not in spelled:
            slots, bits, _, partial = lm.spelled([w], np.array([place]), model.less)
            spelled[w, place] = [(slots[:, b].tolist(), int(bits[b]), int(partial[b])) for b in range(len(bits))]
        return spelled[w, place]

    count, ends, seen, after = {}, [0] * lm.KINDS, {}, {}
    texts = []
    for ws, k, (i, _) in zip(tokens, kind, rows, strict=True):
        h = [int(lm.token_hashes(w, np.array([0]), np.array([len(w)]), *pretoken.keys(w, np.array([0]), np.array([len(w)])))[0]) for w in ws]
        new = lm.cuts(np.array(h, np.uint64), np.array([0, len(ws)])).tolist()
        starts = [j for j, x in enumerate(new) if x]
        parts = [(a, b, tuple(ws[max(a - 3, 0) : a])) for a, b in zip(starts, [*starts[1:], len(ws)], strict=True)]
        texts.append(parts)
        if not trains(i):
            continue
        ends[k] += 1
        for j, w in enumerate(ws):
            for slots, bit, _ in spell(w, k * 8 + lead(ws, j)):
                for s in slots:
                    count.setdefault(s, [0, 0])[bit] += 1
        for a, b, ctx in parts[1:]:
            seen[ctx] = seen.get(ctx, 0) + 1
            after[ctx, tuple(ws[a:b])] = after.get((ctx, tuple(ws[a:b])), 0) + 1

    def spelled_p(w, place, itself):
        logp = 0.0
        for slots, bit, partial in spell(w, place):
            x, sure = [], []
            for s in slots:
                n = list(count.get(s, (0, 0)))
                n[bit] -= itself
                odds = min(12, max(-12, math.log((n[1] + 0.02) / (n[0] + 0.02))))
                x.append(round((odds + 12) * 4095 / 24) / 4095 * 24 - 12)
                sure.append(min(int(math.log2(1 + n[0] + n[1])), lm.LEVELS - 1))
            gate = sum(u > 0 for u in sure)
            dot = model.mixer.bias[gate] + sum(model.mixer.weight[gate, o, u] * v for o, (u, v) in enumerate(zip(sure, x, strict=True)))
            dot = min(14, max(-14, dot))
            at = min(lm.BUCKETS - 1, max(0, round(dot * 2) + lm.BUCKETS // 2))
            n, ones = model.mixer.hits[partial, at]
            p = min(1 - 1e-6, max(1e-6, 0.75 / (1 + math.exp(-dot)) + 0.25 * ones / n))
            logp += math.log10(p if bit else 1 - p)
        return logp

    out = []
    for ws, k, parts, (i, _) in zip(tokens, kind, texts, rows, strict=True):
        itself, own, repeats, value = int(trains(i)), {}, 0, []
        for j, w in enumerate(ws):
            share = (repeats + 0.5) / (j + 1) if j else 0
            p = 10 ** spelled_p(w, k * 8 + lead(ws, j), itself)
            value.append(math.log10((1 - share) * p + share * own.get(w, 0) / max(j, 1)))
            repeats += w in own
            own[w] = own.get(w, 0) + 1
        score, hits = math.log10((ends[k] + 0.5) / (sum(ends) + 0.5 * lm.KINDS)), []
        for n, (a, b, ctx) in enumerate(parts):
            s, all_ = sum(value[a:b]), seen.get(ctx, 0) - itself
            right = after.get((ctx, tuple(ws[a:b])), 0) - itself
            hits.append(n > 0 and all_ > 0 and right > 0)
            if n and all_ > 0:
                run = 0 if not hits[n - 1] else 2 if n > 1 and hits[n - 2] else 1
                p = model.hits[min(int(math.log2(all_)), lm.TIERS - 1), run]
                s += math.log10(1 - p)
                if right > 0:
                    s = max(s, math.log10(p * right / all_)) + math.log10(1 + 10 ** -abs(s - math.log10(p * right / all_)))
            score += s
        out.append(score)
    return out


def test_mixer_and_kinds_learn_from_all_training_texts(spark, monkeypatch):
    # Whatever bounds there are or were on samples, none cuts what is learned from.
    for name in ("MOST_UNITS", "MOST_SAMPLE", "START"):
        monkeypatch.setattr(lm, name, 1, raising=False)
    tokens = [f"word{i}".encode() for i in range(400)]
    place, count = np.arange(400, dtype=np.int32) % 48, np.arange(400) % 7
    rows = [(int(p), bytearray(t), int(c), int(c)) for p, t, c in zip(place, tokens, count, strict=True)]
    units = spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), "place int, token binary, c bigint, n bigint")
    learned = [i for i in range(400) if count[i]]
    slots, bits, owner, _ = lm.spelled([tokens[i] for i in learned], place[learned], 6)
    total = np.zeros((2, int(lm.table_starts(6)[-1])), np.float32)
    for k in range(len(lm.CONTEXTS)):
        np.add.at(total, (bits, slots[k]), count[learned][owner])
    table = lm.Table(lm.packed(total))
    got, want = lm.train_mixer(units, spark.sparkContext.broadcast(table), less=6), lm.Mixer.new()
    want.learn(table, [tokens[i] for i in learned], place[learned], count[learned], 6)
    assert np.allclose(got.weight, want.weight) and np.allclose(got.bias, want.bias) and np.allclose(got.hits, want.hits)

    texts = [(i, f"seldom{i} " * 3 + " ".join(f"often{k}" for k in range(lm.LEADS) if i % (k + 2))) for i in range(300)] + [(900, None), (901, "")]
    docs = spark.createDataFrame([*texts, *[(1000 + i, "heldout " * 50) for i in range(40)]], "doc_id bigint, text string")
    kinds = lm.fit_kinds(docs, F.col("doc_id") < 1000, "doc_id", "text")
    often = [f"often{k}".encode() for k in range(lm.LEADS)]
    ends = np.cumsum([len(w) for w in often])
    low, high, _ = pretoken.keys(b"".join(often), np.append(0, ends[:-1]), ends)
    assert sorted(kinds.leads.find(low, high).tolist()) == list(range(lm.LEADS))
    again = lm.fit_kinds(docs.repartition(7), F.col("doc_id") < 1000, "doc_id", "text")
    assert (again.centres == kinds.centres).all() and len(kinds.centres)


def test_tokens_share_what_they_begin_with(spark, monkeypatch):
    rng = random.Random(4)
    made = {(rng.choice([7, 39]), "".join(rng.choices(["an", "der", "é", "\x01", "ous"], k=rng.randint(1, 6))).encode()) for _ in range(600)} | {(7, lm.END), (39, lm.END), (7, b"an" * 400)}
    made = sorted(made, key=lambda _: rng.random())
    tokens, place = [t for _, t in made], np.array([p for p, _ in made], np.int32)
    whole = [t if t == lm.END else t + b" " for t in tokens]
    spelt = {(p, w[: i + 1]) for p, w in zip(place.tolist(), whole, strict=True) for i in range(len(w))}
    parts = list(lm.shared_bytes(tokens, place))
    assert sum(len(b.byte) for _, b in parts) <= len(spelt) * 1.02 < 0.6 * sum(map(len, whole))
    # Each token's bytes are those that it has when it is spelled alone.
    for some, b in parts:
        for i, token in enumerate(some.tolist()):
            alone = lm.Bytes.spelling([tokens[token]], place[token : token + 1])
            at = b.of[b.owner == i]
            assert bytes(b.byte[at]) == whole[token] and (b.hashes[:, at] == alone.hashes).all()
    # So counts and scores are those of tokens spelled apart, however the tokens are dealt out.
    count = np.array([rng.randint(1, 9) for _ in tokens])
    slots, bits, owner, _ = lm.spelled(tokens, place, 6)
    total = np.zeros((2, int(lm.table_starts(6)[-1])))
    for k in range(len(lm.CONTEXTS)):
        np.add.at(total, (bits, slots[k]), count[owner])
    rows = [(int(p), bytearray(t), int(c)) for p, t, c in zip(place, tokens, count, strict=True)]
    table = lm.count_bits(spark.createDataFrame(rows, "place int, token binary, c bigint").repartition(3), 2, 6)
    assert (table.counts == lm.packed(total)).all()
    mixer = lm.Mixer.new()
    mixer.learn(table, tokens, place, count, 6)
    for itself in (False, True):
        apart = [mixer.score(table, [t], place[i : i + 1], itself, 6)[0] for i, t in enumerate(tokens)]
        assert mixer.score(table, tokens, place, itself, 6) == pytest.approx(apart, rel=1e-5)
    # A byte with most of the weight is in most steps of learning, not in one.
    monkeypatch.setattr(lm, "STEP", 64)
    steps, bits_of = [], lm.bits_of
    monkeypatch.setattr(lm, "bits_of", lambda byte, hashes, less: steps.append({h.tobytes() for h in np.vstack([hashes, byte]).T}) or bits_of(byte, hashes, less))
    heavy = np.where(np.arange(len(tokens)) == tokens.index(lm.END), 10**6, 1)
    lm.Mixer.new().learn(table, tokens, place, heavy, 6)
    assert len(steps) > 5 and max(sum(h in step for step in steps) for h in set.union(*steps)) > len(steps) / 2


def test_frequent_words_are_exact_where_tasks_keep_counts_back(spark):
    # "spread" is never frequent enough in one task to be told, but comes first in all.
    rows = [(f"own{p} " * 30 + "spread " * 20 + " ".join(f"w{p}-{i}" for i in range(50)),) for p in range(8)]
    texts = spark.createDataFrame(spark.sparkContext.parallelize([*rows, ("averyverylongword " * 900,), (None,)], 10), "t string")
    assert lm.frequent_words(texts, 3, share=4) == [b"spread", b"own0", b"own1"]
    assert lm.frequent_words(texts, 3) == [b"spread", b"own0", b"own1"]
    assert lm.frequent_words(texts.limit(0), 3) == []


def test_scores_against_brute_force(spark):
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choices([*WORDS["en"], *WORDS["fr"], *(f"name{i}" for i in range(60))], k=n))
    rows = [(i, text(rng.randint(0, 90))) for i in range(70)] + [(100, None), (101, "one"), (102, "An averyverylongwordofmany letters " * 3)]
    long = text(600)
    rows += [(200, long), (201, long), (202, long), (206, text(200) + " " + long), (203, "rep " * 300), (300, rows[5][1]), (301, rows[6][1])]
    trains = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    docs = spark.createDataFrame([(i, t, "x") for i, t in [*rows, rows[3]]], "doc_id bigint, text string, token string")
    told = []
    got = sorted((r.doc_id, r.score) for r in lm.score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 1, told=told).collect())
    want = sorted(zip([i for i, _ in [*rows, rows[3]]], plain_scores([*rows, rows[3]], trains, told[0]), strict=True))
    assert [i for i, _ in got] == [i for i, _ in want]
    for (i, a), (_, b) in zip(got, want, strict=True):
        assert a == pytest.approx(b, rel=2e-4, abs=1e-3), i
    # What a text shares with training texts is all but free.
    by = dict(got)
    assert by[201] > 0.1 * 600 * -2.5


def test_hits_learn_from_runs():
    told = {(0, 0): (10, 1000), (0, 1): (80, 100), (0, 2): (990, 1000), (3, 0): (300, 600)}
    p = lm.fit_hits(told)
    assert p[0, 0] < 0.1 and p[0, 2] > 0.9 and p[0, 0] < p[3, 0] and ((p > 0) & (p < 1)).all()
    assert np.allclose(lm.fit_hits({}), 0.5)


def vectors(n=400, groups=8, width=24, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    for g in range(groups):
        for k in range(12):
            x[n // 2 + 12 * g + k] = x[g] + rng.normal(size=width) * 0.05 * k / 12 * np.linalg.norm(x[g]) / np.sqrt(width) * 3
    x[-3:] = x[0]
    return [(i, v.tolist(), 1) for i, v in enumerate(x)]


BAD = [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 1), (903, [None] + [1.0] * 23, 1), (904, [float("inf")] * 24, 1), (905, [], 1), (906, [1.0], 1)]


def test_near_vectors_against_brute_force(spark):
    rows = vectors() + BAD
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, v int")
    got = {r.vec_id: r for r in embeddings.near_vectors(table, slack=1.0).collect()}
    good = [(i, np.pad(np.array(v, float), (0, 24 - len(v)))) for i, v, _ in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    near = x @ x.T >= 0.95
    root = np.arange(len(x))
    while True:
        low = np.array([root[near[i]].min() for i in range(len(x))])
        if (low == root).all():
            break
        root = low
    ids = [i for i, _ in good]
    for k, i in enumerate(ids):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (int(near[k].sum()) - 1, ids[root[k]], ids[root[k]] == i)
    for i, *_ in BAD[:6]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    fast = {r.vec_id: r.n_links for r in embeddings.near_vectors(table).collect()}
    assert all(fast[i] <= got[i].n_links for i in fast)
    assert embeddings.near_vectors(table.limit(0)).count() == 0
    only_bad = spark.createDataFrame([*BAD[:6], (None, None, 1)], "vec_id bigint, embedding array<double>, v int")
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(only_bad).collect()} == {(i, 0, i, True) for i, *_ in BAD[:6]} | {(None, 0, None, None)}


def test_recall_of_pairs_near_the_border(spark, monkeypatch):
    """Pairs planted at cosines of 0.95 to 0.97 among unlike vectors, with many cells and several blocks."""
    monkeypatch.setattr(embeddings, "ROWS_A_CELL", 4)
    monkeypatch.setattr(embeddings, "MEMBERS", 64)
    monkeypatch.setattr(embeddings, "ASKERS", 200)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=(500, 48))
    z -= (z * x[:500]).sum(1)[:, None] * x[:500]
    z /= np.linalg.norm(z, axis=1)[:, None]
    c = rng.uniform(0.951, 0.97, 500)[:, None]
    rows = np.concatenate([x, c * x[:500] + np.sqrt(1 - c**2) * z])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r for r in embeddings.near_vectors(table).collect()}
    near = rows @ rows.T / np.outer(np.linalg.norm(rows, axis=1), np.linalg.norm(rows, axis=1)) >= 0.95
    assert all(got[i].n_links <= near[i].sum() - 1 for i in got)
    found = np.mean([got[1500 + i].n_links == 1 and got[1500 + i].component_id == i for i in range(500)])
    print("recall of planted pairs at 0.951 to 0.97:", found)
    assert found >= 0.99


def test_top_k_against_brute_force(spark):
    rows = vectors() + BAD + [(3, vectors()[3][1], 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank int")
    got = {}
    for r in topk.top_products(table, F.col("vec_id") % 7 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(i, np.pad(np.floor(256 * np.array(v, float)).astype(int), (0, 24 - len(v)))) for i, v, _ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    for q, x in good:
        if q % 7 == 0:
            best = sorted(((-int(x @ y), i) for i, y in good if i != q))[:5]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(got) == {i for i, _ in good if i % 7 == 0}
    assert topk.top_products(table.limit(0), F.lit(True)).count() == 0
    assert topk.top_products(table.where("vec_id = 0"), F.lit(True)).count() == 0


def test_coordinate_pruning_loses_nothing():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 8))
    norm = np.linalg.norm(x, axis=1)
    for _ in range(200):
        q = rng.normal(size=8) * rng.choice([0.1, 3])
        score = x @ q
        beat = np.sort(score)[-rng.integers(1, 40)]
        assert set(np.flatnonzero(score >= beat)) <= set(topk.survivors(x / norm[:, None], norm, q, beat))


def test_pipeline_against_its_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    shared = "this line is shared by a good many documents of the table"
    rows = [(i, " ".join(rng.choices([f"the{k}" for k in range(900)], k=120)) + ("\n" + shared if i % 2 else ""), "en", "s", 1) for i in range(30)]
    # Two rows share an id; only the one that is a near copy goes.
    rows += [(29, rows[3][1], "en", "s", 1)]
    rows += [(100 + i, rows[i][1], "en", "s", 1) for i in range(5)] + [(200, None, "en", "s", None), (201, "12 34", None, "s", 5), (202, "été là déjà où garçon", "fr", "s", 1)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language identification", "line dedup", "near-copy dedup", "best-fit packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, seen = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, folder)
        assert docs.columns == names
        seen.append({r.doc_id: r.text for r in docs.collect()})
    assert set(seen[0]) == {i for i, *_ in rows} - {200, 201}
    assert sum(shared in t for t in seen[1].values()) == 1 and set(seen[1]) == set(seen[0])
    assert set(seen[2]) == set(seen[0]) - {100 + i for i in range(5)}
    assert docs.count() == len(seen[2]) and seen[2][29].startswith(rows[29][1].split("\n")[0])
    packed = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in packed.collect()} == set(seen[2])


def test_pipeline_over_awkward_rows(spark, tmp_path):
    """Null ids, null, empty, blank and very long texts, repeated ids and rows, and an empty table."""
    import corpus_pipeline

    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choices([f"the{k}" for k in range(900)], k=n))
    one, kind = prose(200), "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(i, prose(60), "en", "s", 1) for i in range(20)] + [(None, prose(60), "en", None, None) for _ in range(6)] + [(None, one, "en", "s", 1), (None, one, "en", "s", 1), (300, one, "en", "s", 1), (301, one, None, "s", 1)]
    rows += [(302, None, "en", "s", None), (303, "", "en", "s", 0), (304, " \n\t", "en", "s", 3), (305, prose(20_000), "en", "s", 1), (7, prose(50), "en", "s", 1), rows[3], rows[3], (None, None, None, None, None)]
    folder = str(tmp_path / "some")
    spark.createDataFrame(rows, kind).write.parquet(f"{folder}/documents.parquet")
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == {i for i, *_ in rows} - {301, 302, 303, 304}  # 301 is a copy of 300; rows without an id stay
    assert sum(r.doc_id is None and r.piece == 0 for r in packed) == 8 and sum(r.doc_id == 7 and r.piece == 0 for r in packed) == 2
    empty = str(tmp_path / "none")
    spark.createDataFrame([], kind).write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
