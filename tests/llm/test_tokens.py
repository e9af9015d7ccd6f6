"""Pre-tokenisation, byte-level BPE, packing and token counts against the libraries."""

import codecs
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestone.llm import bpe, packing, pretoken, token_counts, vocab

MULTI, PLAIN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "  ", "'s", "don't 'll've\n\n x", "a  b \t\n", "ÉÑ日本² Ⅷ😀", "<|endoftext|>", "x<|endoftext|> y", "\x00\x1c\x85　_", "word " * 3000, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, None, "same", "same"]


def texts(n: int = 400) -> list[str]:
    rng = random.Random(1)
    letters = list("ab'sltmrevd  \n\t12!?. 　éÉñ日本²😀’_")
    return ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(n)]


def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks(MULTI), special_tokens={})


def table(spark, rows=ODD):
    return spark.createDataFrame([Row(doc_id=i, text=t, ids="clash", k=1, n_tokens=None) for i, t in enumerate(rows)], "doc_id bigint, text string, ids string, k int, n_tokens int")


def test_pieces_equal_the_pattern():
    rows = texts() + [t for t in ODD if t is not None]
    raw, begin, end, bounds = pretoken.pieces(rows)
    pattern = regex.compile(public_tokenizers.PATTERN)
    for i, t in enumerate(rows):
        assert [raw[a:b].decode() for a, b in zip(begin[bounds[i] : bounds[i + 1]], end[bounds[i] : bounds[i + 1]], strict=True)] == pattern.findall(t)


def test_transducer_equals_rank_merging():
    machine, core = bpe.MergeTransducer(vocab.ranks(MULTI), most_states=500), reference()
    rng = random.Random(2)
    for i in range(4000):
        piece = bytes(rng.choices(b"aabet the-=\n \xc3\xa9" if i % 2 else range(256), k=rng.randint(1, 30)))
        want = core._encode_single_piece(piece)
        assert machine.encode(piece) == want
        if len(want) > 1:
            assert list(machine.stream([piece[:3], piece[3:]])) == want


def test_cache_starts_anew_within_its_bound():
    cache = pretoken.PieceCache(lambda p: list(p), most=50)
    for k in range(5):
        ids, bounds = cache.ids([f"word{k}x{i} " for i in range(60)])
        assert bytes(ids[bounds[7] : bounds[8]].tolist()).decode() == f"word{k}x7 "
    assert cache.entries <= 200


def test_encode_rows_and_streaming_decode(spark):
    core = reference()
    got = {r.doc_id: r for r in bpe.encode(table(spark), MULTI).collect()}
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        assert got[i].ids == core.encode_ordinary(t or "") and bytes(got[i].decoded) == (t or "").encode()
    assert bpe.encode(table(spark).limit(0), MULTI).count() == 0
    decoder, ids = bpe.StreamDecoder.of(vocab.ranks(MULTI)), core.encode_ordinary("naïve 日本 😀 end")
    parts = [decoder.feed([i]) for i in ids]
    assert (b"".join(parts) + decoder.finish()).decode() == "naïve 日本 😀 end"
    for part in parts:
        part.decode()  # whole characters only


def test_decoder_against_the_incremental_codec():
    rng = random.Random(9)
    tokens = [bytes([b]) for b in range(256)] + ["é日".encode(), "😀".encode()[:3], b"\xed\xa0", b"\xf4\x90", b"ab"]
    for k in range(3000):
        ids = [rng.choice([rng.randrange(256), 257, 258, 259, 260, 0xC3, 0xE2, 0x82, 0xF0]) for _ in range(rng.randint(0, 12))]
        decoder, codec, cut = bpe.StreamDecoder(tokens), codecs.getincrementaldecoder("utf-8")("replace"), rng.randint(0, 12)
        mine = decoder.feed(ids[:cut]) + decoder.feed(ids[cut:]) + decoder.finish()
        assert mine.decode() == codec.decode(b"".join(tokens[i] for i in ids), True)


def test_a_byte_that_the_ranks_lack():
    with pytest.raises(ValueError, match="no token for byte 99"):
        bpe.MergeTransducer({b"a": 0, b"b": 1, b"ab": 2}).encode(b"abca")


def test_counts_equal_the_library(spark):
    tokenizer = vocab.library_encoder(PLAIN).tokenizer
    got = {r.doc_id: r for r in token_counts.count_tokens(table(spark), PLAIN, limit=100).collect()}
    for i, t in enumerate(ODD):
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 100)
    assert token_counts.count_tokens(table(spark).limit(0), PLAIN).count() == 0


def test_plan_places_every_piece_and_is_near_the_bound():
    rng = np.random.default_rng(3)
    for capacity, n in ((64, 3000), (2048, 20_000), (10, 7)):
        number = np.bincount(np.clip(rng.lognormal(np.log(capacity) - 2, 1, n).astype(int), 1, capacity), minlength=capacity + 1)
        plan = packing.plan(number, capacity, rounds=150)
        used = np.zeros(capacity + 1, int)
        for config, times in plan:
            assert times > 0 and sum(x * k for x, k in config) <= capacity
            for x, k in config:
                used[x] += k * times
        assert (used == number).all()
        total = sum(k for _, k in plan)
        assert total <= max(1.01 * (number * np.arange(capacity + 1)).sum() / capacity + 1, 1 + number[capacity // 2 + 1 :].sum())


def test_packing_rows(spark):
    rows = ODD + texts(60)
    tokenizer = vocab.library_encoder(PLAIN).tokenizer
    got = packing.pack(table(spark, rows), PLAIN, capacity=256, keep_ids=True).collect()
    by, filled = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r.ids_crc32
    for i, t in enumerate(rows):
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert sum((r["ids"] for r in pieces), []) == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert all(r.length == 256 for r in pieces[1:]) and [r.start for r in pieces] == list(np.cumsum([0] + [r.length for r in pieces[:-1]]))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(table(spark).limit(0), PLAIN).count() == 0


def test_queries_derive_their_digests(spark, tmp_path):
    from lodestone.llm import queries

    table(spark).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op5_byte_bpe"](spark, str(tmp_path)).collect()}
    core = reference()
    for i, t in enumerate(ODD):
        ids = core.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert queries.QUERIES["op9_best_fit_packing"](spark, str(tmp_path)).agg(F.count_distinct("doc_id")).first()[0] == len(ODD)


def test_frequent_pieces_are_those_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "HELD", 3)  # counts are handed on in several parts
    rows = [(k, f"w{k} rare") for k in range(200)] + [(-1, "often " * 1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    asked = []
    monkeypatch.setattr(token_counts, "piece_table", asked.append)
    token_counts.frequent(docs, PLAIN, most=2)
    assert list(asked[0]) == [b" often", b" rare"]
