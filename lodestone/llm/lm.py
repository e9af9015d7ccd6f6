"""Language-model scores by online logistic context mixing.

A token is spelled bit by bit and closed by a blank (a text's end is a line
end). Hashed contexts predict the next bit from counted bits: the last bytes,
the whole word so far, and the word so far with the word before it. Logistic
weights, gated by how many contexts have seen anything, mix the predictions,
and an adaptive map refines the result by the bits of the byte so far. Weights
and map learn online, each token predicted without itself. Texts are of several
kinds, told by their byte pairs; some contexts hold the kind, whose own
probability is part of the score. Since a token's spelling depends on nothing
but its bytes, its kind and its leading word, each distinct one of these is
spelled once for the corpus, and what sorted ones begin with alike is counted,
learned and scored once for all of them. Within a text the mix goes on: the share of tokens
that came up before in it weighs its own frequencies against the spelling.

Beyond words, texts are cut at word pairs that a hash picks. What follows a cut
is predicted from the three words before it: all continuations of the training
texts are counted, in tables that grow with the corpus and are never gathered.
One more bit, mixed from the context's count and the run of matches so far,
says whether the continuation is one that was seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, slices, stored
from .pretoken import PieceTable, keys, piece_table

#: Contexts: bytes before (99: all of the token), whether the text's kind and the word before belong to it, and bits of its table: 14 million slots, 56 MB as sent.
CONTEXTS = ((2, True, False, 20), (3, True, False, 21), (4, True, False, 21), (5, False, False, 21), (99, True, False, 22), (99, False, False, 20), (99, False, True, 21))
#: Kinds of text, told apart by byte pairs; their centres begin on about START texts and move in so many rounds over all.
KINDS, PAIRS, START, ROUNDS = 6, 512, 4096, 2
#: Leading words that a context tells apart; 0 is a text's start and the last class any other word.
LEADS, OTHER = 6, 7
#: Most (kind, lead, token) whose counts and scores are broadcast: about 16 MB.
MOST_FREQUENT = 1 << 18
#: Kinds of confidence of a context, buckets of the adaptive map, and the largest count.
LEVELS, BUCKETS, TOP = 12, 33, 65_535
#: A text is cut after one word pair in so many; words that predict what follows a cut.
ANCHORS, BEFORE = 32, 3
END = b"\n"
BLOCK = 1 << 16
#: Bytes of a step of learning, the part of its weight that one of them may have, and bytes counted or scored at once.
STEP, SHARES, AT_ONCE = 8192, 1024, 4096

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: States of a context: log odds from -12 to 12 in 4095 steps, and below them four bits of confidence; and the log odds of every state.
STEPS, REACH = 4095, 12
_ODDS = ((np.arange(1 << 16) >> 4) / STEPS * 2 * REACH - REACH).astype(np.float32)


def table_starts(less: int) -> np.ndarray:
    """Where the contexts' tables begin if each has ``less`` bits fewer than CONTEXTS says; the last entry is the number of slots."""
    return np.concatenate([[0], np.cumsum([1 << (c[-1] - less) for c in CONTEXTS])])


def fewer_bits(units: int) -> int:
    """The largest table has a slot or two for each spelled token, up to what CONTEXTS says."""
    return int(np.clip(max(c[-1] for c in CONTEXTS) - (max(units, 1) - 1).bit_length(), 0, 8))


def tokens_of(texts: list[str | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased UTF-8 of all texts, each token's start and end in it, and where each text's tokens begin (one entry more).

    The last token of a text is its end, the line end that closes it.
    """
    raw = "\n".join([t or "" for t in texts]).encode().lower() + b"\n"
    close = np.cumsum(np.fromiter([len((t or "").encode()) + 1 for t in texts], np.int64, len(texts))) - 1
    inside = np.concatenate([[False], ~_SPACE[np.frombuffer(raw, np.uint8)]])
    first = np.flatnonzero(inside[1:] & ~inside[:-1])
    past = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1 if len(first) else first
    last = np.searchsorted(first, close) + np.arange(len(close))
    word = np.ones(len(first) + len(close), bool)
    word[last] = False
    begin, end = np.empty(len(word), np.int64), np.empty(len(word), np.int64)
    begin[word], end[word], begin[last], end[last] = first, past, close, close + 1
    return raw, begin, end, np.append(0, last + 1)


def short_names(low: np.ndarray, high: np.ndarray) -> pa.Array:
    """The bytes of pieces of at most 15 bytes, back from their keys."""
    letters = np.empty((len(low), 16), np.uint8)
    letters[:, :8] = np.ascontiguousarray(low).view(np.uint8).reshape(-1, 8)
    letters[:, 8:] = np.ascontiguousarray(high).view(np.uint8).reshape(-1, 8)
    size = letters[:, 15].astype(np.int32)
    ends = np.append(np.int32(0), np.cumsum(size, dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), len(low), [None, pa.py_buffer(ends), pa.py_buffer(letters[np.arange(16) < size[:, None]])])


def grouped(code: np.ndarray, stable: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal codes next to each other, if ``stable`` earlier ones first, and where each group begins in it."""
    order = np.argsort(code, kind="stable" if stable else None)
    sorted_ = code[order]
    return order, np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(code) else order


def pair_roots(texts: list[str | None]) -> np.ndarray:
    """Square roots of the counts of hashed byte pairs, in 256ths, one row a text."""
    low = [(t or "").encode().lower() + b"\n\n" for t in texts]
    byte = np.frombuffer(b"".join(low), np.uint8).astype(np.int32)
    size = np.fromiter(map(len, low), np.int64, len(low))
    pair = byte * 257
    pair[:-1] += byte[1:]
    pair[np.cumsum(size) - 1] = 10 * 258  # a text's last byte pairs with another line end, not with the next text
    pair *= 40503
    pair >>= 7
    pair &= PAIRS - 1
    pair += np.repeat(np.arange(0, len(low) * PAIRS, PAIRS, dtype=np.int32), size)
    return np.rint(256 * np.sqrt(np.bincount(pair, minlength=len(low) * PAIRS).reshape(len(low), PAIRS)))


@dataclass
class Kinds:
    """Centres of the kinds of text, and the words that lead."""

    centres: np.ndarray
    leads: PieceTable

    def of(self, texts: list[str | None]) -> np.ndarray:
        # Whole numbers, so that a text's kind does not depend on what else is in its batch.
        return (pair_roots(texts) @ self.centres.T).argmax(1) if texts else np.zeros(0, np.int64)

    def places(self, texts: list[str | None], low: np.ndarray, high: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Kind and class of the leading word of each token: kind * 8 + lead."""
        found = self.leads.find(low, high)
        own = np.where(found >= 0, found + 1, OTHER)
        lead = np.append(0, own[:-1])
        lead[bounds[:-1]] = 0
        return np.repeat(self.of(texts), np.diff(bounds)) * 8 + lead


def frequent_words(texts: DataFrame, number: int, share: int = 20_000) -> list[bytes]:
    """The most frequent words of at most 15 bytes in all texts ``t``, ties to the smaller.

    Every word is counted; a task tells the counts of those that are at least
    one in ``share`` of its words, and the largest count that it kept back. If
    the sum of these could change which words come first, all counts are told.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("w").aggregate([("n", "sum")]).rename_columns(["w", "n"])

        def told() -> pa.RecordBatch:
            w, n = (summed()[c].combine_chunks() for c in ("w", "n")) if held else (pa.array([], pa.string()), pa.array([], pa.int64()))
            size, least = n.to_numpy(), sum(n.to_numpy().tolist()) // share if share else 0
            some = pa.array(np.flatnonzero((size >= least) & (pc.binary_length(w).to_numpy() <= 15)))
            back = size[size < least].max(initial=0)
            return pa.RecordBatch.from_arrays([pa.concat_arrays([w.take(some).cast(pa.binary()), pa.nulls(1, pa.binary())]), pa.concat_arrays([n.take(some), pa.array([back], pa.int64())])], ["w", "n"])

        for batch in batches:
            for rows in slices(batch, "t"):
                words = pc.list_flatten(pc.ascii_split_whitespace(pc.ascii_lower(pa.array(["\n".join([t or "" for t in rows.column("t").to_pylist()])]))))
                count = pc.value_counts(words.filter(pc.not_equal(words, "")))
                held.append(pa.table({"w": count.field("values"), "n": count.field("counts")}))
                if sum(len(h) for h in held) > 700_000:
                    held = [summed()]
                    if len(held[0]) > 500_000:
                        yield told()
                        held = []
                    pa.default_memory_pool().release_unused()  # a worker lives on and would keep it
        yield told()
        held = []
        pa.default_memory_pool().release_unused()

    counted = texts.mapInArrow(run, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    first = counted.orderBy(F.col("w").isNotNull(), F.desc("n"), "w").limit(number + 2).collect()  # the row of what was kept back comes first
    back = first[0].n if first else 0
    words = first[1:]
    if back and (len(words) < number or words[number - 1].n <= back + (words[number].n if len(words) > number else 0)):
        return frequent_words(texts, number, 0)
    return [bytes(r.w) for r in words[:number]]


def moved_centres(texts: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Each centre moved to the mean direction of those of all texts ``t`` that are nearest to it; sums are of whole numbers, so their order does not count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(centres.shape, np.int64)
        for batch in batches:
            for rows in slices(batch, "t"):
                x = pair_roots(rows.column("t").to_pylist())
                near = (x @ centres.T).argmax(1)
                whole = np.rint(x * (2**20 / np.linalg.norm(x, axis=1, keepdims=True)))
                for k in range(len(centres)):
                    total[k] += whole[near == k].sum(0).astype(np.int64)
        kind, pair = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(total[kind, pair])], ["kind", "pair", "s"])

    out = np.zeros(centres.shape)
    for r in texts.mapInArrow(run, "kind int, pair int, s bigint").groupBy("kind", "pair").agg(F.sum("s").alias("s")).collect():  # bounded: the centres
        out[r.kind, r.pair] = r.s
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(size > 0, out / np.where(size > 0, size, 1), centres)


def fit_kinds(docs: DataFrame, learns: Column, id_col: str, text_col: str) -> Kinds:
    """Kinds and leading words from all training texts; only where the centres' rounds begin comes from about START texts, which a hash of the id picks."""
    training = docs.where(F.coalesce(learns, F.lit(True)))
    texts = training.select(F.col(text_col).alias("t"))
    table = piece_table({w: k for k, w in enumerate(frequent_words(texts, LEADS))})
    part = min(1.0, START / max(docs.count(), 1))
    some = training.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("kind")), F.lit(1 << 30)) < int(part * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "t"):
                yield pa.RecordBatch.from_arrays([pa.array([r.astype(np.float32).tobytes() for r in pair_roots(rows.column("t").to_pylist())], pa.binary())], ["f"])

    got = sorted(bytes(r.f) for r in some.select(F.col(text_col).alias("t")).mapInArrow(run, "f binary").collect())
    if not got:
        return Kinds(np.full((1, PAIRS), 1.0), table)
    x = np.stack([np.frombuffer(f, np.float32) for f in got]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = x[np.random.default_rng(5).permutation(len(x))[:KINDS]].copy()
    for _ in range(12):
        near = (x @ centres.T).argmax(1)
        for k in range(len(centres)):
            if (near == k).any():
                centres[k] = x[near == k].mean(0)
                centres[k] /= np.linalg.norm(centres[k])
    for _ in range(ROUNDS):
        centres = moved_centres(texts, centres)
    return Kinds(np.rint(4096 * centres), table)


def count_words(docs: DataFrame, learns: Column, kinds, text_col: str) -> DataFrame:
    """(place, token, c, n, of_token, first): how often training texts and all texts hold each token in a place, ends included; training texts in all places; and whether it is the token's first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        long: dict[int, bytes] = {}

        def summed() -> list[np.ndarray]:
            code, low, high, place, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order, head = grouped(code, stable=False)
            some = order[head]
            return [code[some], low[some], high[some], place[some], np.add.reduceat(c[order], head), np.add.reduceat(n[order], head)]

        def told() -> Iterator[pa.RecordBatch]:
            code, low, high, place, c, n = summed()
            is_long = np.fromiter([x in long for x in code.tolist()], bool, len(code)) if long else np.zeros(len(code), bool)
            for some, names in ((np.flatnonzero(~is_long), None), (np.flatnonzero(is_long), [long[x] for x in code[is_long].tolist()])):
                if len(some):
                    token = short_names(low[some], high[some]) if names is None else pa.array(names, pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(place[some].astype(np.int32)), token, pa.array(c[some]), pa.array(n[some])], ["place", "token", "c", "n"])

        for batch in batches:
            for part in slices(batch, "t"):
                texts = part.column("t").to_pylist()
                raw, begin, end, bounds = tokens_of(texts)
                low, high, short = keys(raw, begin, end)
                place = kinds.value.places(texts, low, high, bounds)
                train = np.repeat(part.column("train").to_numpy(zero_copy_only=False), np.diff(bounds)).astype(np.int64)
                code = token_hashes(raw, begin, end, low, high, short) + (place.astype(np.uint64) + np.uint64(1)) * _MIX
                order, head = grouped(code, stable=False)
                some = order[head]
                for i in some[~short[some]].tolist():
                    long[int(code[i])] = raw[begin[i] : end[i]]
                held.append([code[some], low[some], high[some], place[some], np.add.reduceat(train[order], head), np.diff(np.append(head, len(order)))])
                if sum(len(h[0]) for h in held) > 2_000_000:
                    held = [summed()]
                    if len(held[0][0]) > 1_000_000:
                        yield from told()
                        held, long = [], {}
        if held:
            yield from told()

    source = docs.select(F.col(text_col).alias("t"), F.coalesce(learns, F.lit(True)).alias("train"))
    counted = source.mapInArrow(run, "place int, token binary, c bigint, n bigint")
    # All places of a token, KINDS * 8 at most, meet in one partition, so one exchange serves both.
    by_place = counted.repartition("token").groupBy("place", "token").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    token = Window.partitionBy("token")
    return by_place.select("place", "token", "c", "n", F.sum("c").over(token).alias("of_token"), (F.min("place").over(token) == F.col("place")).alias("first"))


@dataclass
class Bytes:
    """The bytes that spell tokens; bytes after the same bytes of neighbouring tokens in one place are one, so sorted tokens share what they begin with."""

    byte: np.ndarray
    hashes: np.ndarray  # (contexts, bytes): 32-bit hash of each context
    of: np.ndarray  # for every byte of every token, which of these it is
    owner: np.ndarray  # and its token

    @classmethod
    def spelling(cls, tokens: list[bytes], place: np.ndarray) -> Bytes:
        whole = [t if t == END else t + b" " for t in tokens]
        size = np.fromiter(map(len, whole), np.int64, len(whole))
        byte = np.frombuffer(b"".join(whole), np.uint8)
        owner = np.repeat(np.arange(len(whole)), size)
        begin = np.cumsum(size) - size
        flat = np.arange(len(byte))
        at = flat - begin[owner]
        # A byte is new if it or one before it in its token differs from the token before.
        last = np.append(np.int64(0), size[:-1])
        last[np.flatnonzero(place[1:] != place[:-1]) + 1] = 0
        last = last[owner]
        differs = (at >= last) | (byte[flat - last] != byte)
        new = np.maximum.accumulate(np.where(differs, flat, -1)) >= begin[owner]
        # By position, a byte that is not new is the one before it.
        order = np.argsort(at.astype(np.uint16) if len(at) and at.max() < 1 << 16 else at, kind="stable")
        of = np.cumsum(new[order]) - 1
        number = np.empty(len(of), np.int64)
        number[order] = of
        first = order[new[order]]
        at, place = at[first], place.astype(np.uint64)[owner[first]]
        wide = byte.astype(np.uint64) + np.uint64(1)
        # Hash of what precedes a byte in its token; one that reaches the start knows it.
        before = {}
        running = np.full(len(first), 0x51ED27, np.uint64)
        for back in range(1, max(c[0] for c in CONTEXTS if c[0] < 99) + 1):
            step = np.where(at >= back, wide[np.maximum(first - back, 0)], np.uint64(0))
            running = np.where(at >= back - 1, (running ^ step) * _MIX + np.uint64(back), running)
            before[back] = running
        seen = before[99] = np.full(len(first), 0xABCD1234, np.uint64)
        ends = np.append(np.flatnonzero(at[1:] != at[:-1]) + 1, len(at)).tolist()
        for a, b in zip(ends, ends[1:], strict=False):
            step = (seen[number[first[a:b] - 1]] ^ wide[first[a:b] - 1]) * _MIX
            seen[a:b] = step ^ (step >> np.uint64(31))
        kind = ((place >> np.uint64(3)) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        lead = ((place & np.uint64(7)) + np.uint64(1)) * np.uint64(0x165667B19E3779F9)
        hashes = np.empty((len(CONTEXTS), len(first)), np.uint32)
        for k, (back, of_kind, of_lead, _) in enumerate(CONTEXTS):
            context = before[back] ^ kind if of_kind else before[back] ^ lead if of_lead else before[back]
            hashes[k] = (context * _MIX) >> np.uint64(32)
        return cls(byte[first], hashes, of, owner[order])


def bits_of(byte: np.ndarray, hashes: np.ndarray, less: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots (contexts x bits), the bits of the bytes, and the bits of its byte before each. The contexts' tables have ``less`` bits fewer than CONTEXTS says."""
    starts = table_starts(less)
    low = byte.astype(np.uint32)[:, None]
    shift = np.arange(8, dtype=np.uint32)[::-1]
    bits = ((low >> shift) & np.uint32(1)).astype(np.uint8)
    partial = (np.uint32(1) << np.arange(8, dtype=np.uint32)) | (low >> (shift + np.uint32(1)))  # a leading 1, then the bits so far
    half = np.concatenate([np.ones_like(low), low >> np.uint32(4) | np.uint32(16)], 1) * np.uint32(0x9E3779B1)  # the bits before each half of the byte
    within = (partial.reshape(-1, 2, 4) & np.array([0, 1, 3, 7], np.uint32) | np.array([1, 2, 4, 8], np.uint32)).astype(np.int64)
    slots = np.empty((len(CONTEXTS), len(byte), 2, 4), np.int64)
    for k, (*_, width) in enumerate(CONTEXTS):
        h = hashes[k][:, None] ^ half
        h *= np.uint32(0x85EBCA77)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE3D)
        h >>= np.uint32(32 - width + less)
        # The slots of half a byte are 15 of 16 neighbours, in an order that the hash picks.
        np.bitwise_xor((h.astype(np.int64) + starts[k])[:, :, None], within, out=slots[k])
    return slots.reshape(len(CONTEXTS), -1), bits.ravel(), partial.astype(np.int16).ravel()


def spelled(tokens: list[bytes], place: np.ndarray, less: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bits of all tokens, shared or not, by position: slots, the bits, each bit's token, and the bits of its byte before it."""
    all_ = Bytes.spelling(tokens, place)
    slots, bits, partial = bits_of(all_.byte[all_.of], all_.hashes[:, all_.of], less)
    return slots, bits, np.repeat(all_.owner, 8), partial


def _batches(tokens: list[bytes], most: int = 200_000) -> Iterator[tuple[int, int]]:
    """Cut tokens so that a batch spells about so many bytes."""
    start = total = 0
    for i, t in enumerate(tokens):
        total += len(t) + 1
        if total > most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(tokens):
        yield start, len(tokens)


def shared_bytes(tokens: list[bytes], place: np.ndarray) -> Iterator[tuple[np.ndarray, Bytes]]:
    """Which tokens, sorted by place and bytes, and the bytes that spell them."""
    order = pc.sort_indices(pa.table({"place": place, "token": pa.array(tokens, pa.binary())}), [("place", "ascending"), ("token", "ascending")]).to_numpy()
    sorted_ = [tokens[i] for i in order.tolist()]
    for a, b in _batches(sorted_):
        yield order[a:b], Bytes.spelling(sorted_[a:b], place[order[a:b]])


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 100_000, size: int = 1 << 24) -> Iterator[pa.Table]:
    """Batches put together until they have so many rows or bytes; the more tokens, the more they share."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
            yield pa.Table.from_batches(held)
            held = []
            pa.default_memory_pool().release_unused()
    if held:
        yield pa.Table.from_batches(held)


def states_of(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The state of counted zeros and ones."""
    odds = np.clip(np.log((one + 0.02) / (zero + 0.02)), -REACH, REACH)
    sure = np.minimum(np.log2(zero + one + 1).astype(np.uint16), LEVELS - 1)
    return np.rint((odds + REACH) * (STEPS / (2 * REACH))).astype(np.uint16) << np.uint16(4) | sure


@dataclass
class Table:
    """Counted bits: the ones of a slot above its zeros, 16 bits each. A worker makes the states of all slots once."""

    counts: np.ndarray

    def _states(self, less: int) -> Iterator[np.ndarray]:
        for part in np.array_split(self.counts, max(1, len(self.counts) >> 18)):
            zero, one = (part & np.uint32(0xFFFF)).astype(np.int32), (part >> np.uint32(16)).astype(np.int32)
            yield states_of(np.maximum(zero - (less == 0), 0), np.maximum(one - (less == 1), 0))

    @cached_property
    def fresh(self) -> np.ndarray:
        return np.concatenate(list(self._states(-1)))

    @cached_property
    def itself(self) -> np.ndarray:
        """(slots, bit): the states without one mark of the bit."""
        return np.stack([np.concatenate(list(self._states(bit))) for bit in (0, 1)], axis=1)

    def __getstate__(self) -> dict:
        return {"counts": self.counts}

    def stretched(self, slots: np.ndarray, bits: np.ndarray, itself: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds and confidence of each context, and how many have seen anything; ``itself``: the bits' own marks are taken off."""
        state = self.itself.ravel()[slots * 2 + bits] if itself else self.fresh[slots]
        sure = state & np.uint16(15)
        return _ODDS[state], sure, (sure > 0).sum(0, dtype=np.int8)


@dataclass
class Mixer:
    """Weights by gate, order and confidence, and the adaptive map by the byte's bits so far."""

    weight: np.ndarray  # (gates, orders, LEVELS)
    bias: np.ndarray  # (gates,)
    squares: np.ndarray  # running squares of the gradients, for the step sizes
    hits: np.ndarray  # (256, BUCKETS, 2): weight and ones

    @classmethod
    def new(cls) -> Mixer:
        k = len(CONTEXTS)
        weight = np.full((k + 1, k, LEVELS), 1.2 / k)
        hits = np.zeros((256, BUCKETS, 2))
        hits[:, :, 0] = 50
        hits[:, :, 1] = 50 / (1 + np.exp(-(np.arange(BUCKETS) - BUCKETS // 2) / 2))
        return cls(weight, np.zeros(k + 1), np.full((k + 1, k, LEVELS), 1e-3), hits)

    def mix(self, stretch, sure, gate) -> np.ndarray:
        flat, k_all = self.weight.astype(np.float32).ravel(), len(CONTEXTS)
        dot = self.bias.astype(np.float32)[gate]
        base = gate.astype(np.int32) * (k_all * LEVELS)
        for k in range(k_all):
            dot += flat[base + sure[k]] * stretch[k]
            base += LEVELS
        return np.clip(dot, -14, 14, out=dot)

    @staticmethod
    def bucket(dot: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(dot * 2) + BUCKETS // 2, 0, BUCKETS - 1).astype(np.int32)

    def refine(self, dot: np.ndarray, partial: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mixed probability of a one, three quarters from the mixer and one from the adaptive map; and the map's bucket."""
        bucket = self.bucket(dot)
        rate = (self.hits[:, :, 1] / self.hits[:, :, 0]).astype(np.float32).ravel()
        p = 1 / (1 + np.exp(-dot))
        return np.clip(0.75 * p + 0.25 * rate[partial.astype(np.int32) * BUCKETS + bucket], 1e-6, 1 - 1e-6), bucket

    def learn(self, table: Table, tokens: list[bytes], place: np.ndarray, count: np.ndarray, less: int = 0, step: float = 0.02) -> None:
        """Learn every bit of the tokens; what tokens share is learned once with the sum of their counts. The order of the bytes is mixed."""
        parts = [(b.byte, b.hashes, np.bincount(b.of, count[some][b.owner])) for some, b in shared_bytes(tokens, place)]
        if not parts:
            return
        byte, hashes, number = (np.concatenate(x, axis=-1) for x in zip(*parts, strict=True))
        del parts
        # Bytes that many tokens share are dealt over the steps, so that a step weighs them about as all tokens do.
        steps = -(-len(byte) // STEP)
        times = np.clip(np.ceil(number * (steps * SHARES / number.sum())), 1, steps).astype(np.int64)
        number /= times
        mixed = np.random.default_rng(3).permutation(np.repeat(np.arange(len(byte)), times))
        for some in np.array_split(mixed, steps):
            slots, bits, partial = bits_of(byte[some], hashes[:, some], less)
            weight = np.repeat(number[some].astype(np.float32), 8)
            stretch, sure, gate = table.stretched(slots, bits, True)
            dot = self.mix(stretch, sure, gate)
            bucket = self.bucket(dot)
            error = (bits - 1 / (1 + np.exp(-dot))) * weight
            total = weight.sum(dtype=np.float64)
            base = gate.astype(np.int32) * LEVELS
            for k in range(len(CONTEXTS)):
                g = np.bincount(base + sure[k], error * stretch[k], minlength=self.weight[:, k].size).reshape(self.weight[:, k].shape) / total
                self.squares[:, k] = 0.98 * self.squares[:, k] + 0.02 * g * g
                self.weight[:, k] += step * g / np.sqrt(self.squares[:, k] + 1e-10)
            self.bias += 0.5 * np.bincount(gate, error, minlength=len(self.bias)) / total
            at = partial.astype(np.int64) * BUCKETS + bucket
            fresh = np.stack([np.bincount(at, w, minlength=256 * BUCKETS).reshape(256, BUCKETS) for w in (weight, weight * bits)], 2)
            self.hits += fresh * (1000 / total)

    def score(self, table: Table, tokens: list[bytes], place: np.ndarray, itself: bool, less: int = 0) -> np.ndarray:
        """log10 of the probability of each token's spelling; ``itself``: it is one of those that were counted."""
        out = np.zeros(len(tokens))
        for some, shared in shared_bytes(tokens, place):
            logp = np.empty(len(shared.byte))
            for a in range(0, len(logp), AT_ONCE):
                slots, bits, partial = bits_of(shared.byte[a : a + AT_ONCE], shared.hashes[:, a : a + AT_ONCE], less)
                p, _ = self.refine(self.mix(*table.stretched(slots, bits, itself)), partial)
                logp[a : a + AT_ONCE] = np.log10(np.where(bits, p, 1 - p).reshape(-1, 8).prod(1, dtype=np.float64))
            out[some] = np.bincount(shared.owner, logp[shared.of], minlength=len(some))
        return out


def packed(total: np.ndarray) -> np.ndarray:
    """(zeros and ones, slots) as one number a slot; pairs too large for 16 bits each are scaled down until they fit."""
    top = total.max(0)
    total = np.rint(total / np.where(top > TOP, top / TOP, 1)).astype(np.uint32)
    return total[1] << np.uint32(16) | total[0]


def count_bits(units: DataFrame, tasks: int, less: int = 0) -> Table:
    """Zeros and ones seen in every slot, as ``packed`` gives them.

    Each task counts its tokens' bits into tables of fixed size; blocks of the
    tables are added up.
    """
    slots = int(table_starts(less)[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, slots), np.float32)
        for rows in gathered(batches):
            count = rows["c"].to_numpy()
            for some, shared in shared_bytes(rows["token"].to_pylist(), rows["place"].to_numpy()):
                number = np.bincount(shared.of, count[some][shared.owner])
                for a in range(0, len(number), AT_ONCE):
                    at, bits, _ = bits_of(shared.byte[a : a + AT_ONCE], shared.hashes[:, a : a + AT_ONCE], less)
                    weight = np.repeat(number[a : a + AT_ONCE].astype(np.float32), 8)
                    np.add.at(table.ravel(), (at + bits.astype(np.int64) * slots).ravel(), np.tile(weight, len(CONTEXTS)))
        for block in range(-(-slots // BLOCK)):
            part = table[:, block * BLOCK : (block + 1) * BLOCK]
            if part.any():
                narrow = bool(part.max() <= TOP)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part.astype(np.uint16 if narrow else np.float32).tobytes()], pa.binary()), pa.array([narrow])], ["block", "part", "narrow"])

    def add(key: tuple[pa.Scalar, ...], blocks: pa.Table) -> pa.Table:
        parts = zip(blocks["part"].to_pylist(), blocks["narrow"].to_pylist(), strict=True)
        total = np.sum([np.frombuffer(b, np.uint16 if narrow else np.float32).astype(np.float64) for b, narrow in parts], axis=0).reshape(2, -1)
        return pa.table({"block": pa.array([key[0].as_py()]), "part": pa.array([packed(total).tobytes()], pa.binary())})

    counted = units.where("c > 0").select("place", "token", "c").coalesce(tasks).mapInArrow(run, "block bigint, part binary, narrow boolean")
    out = np.zeros(slots, np.uint32)
    for r in counted.groupBy("block").applyInArrow(add, "block bigint, part binary").toLocalIterator():  # bounded: the tables
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.part, np.uint32)
    return Table(out)


def train_mixer(units: DataFrame, table, less: int = 0) -> Mixer:
    """Weights learned by every task from its tokens, averaged by the tokens seen; the maps' hits are added up. All training tokens are learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, seen, start = Mixer.new(), 0, Mixer.new().hits
        for rows in gathered(batches, 250_000):  # a step's bytes are drawn from as many tokens
            mixer.learn(table.value, rows["token"].to_pylist(), rows["place"].to_numpy(), rows["c"].to_numpy(), less)
            seen += int(rows["c"].to_numpy().sum())
        if seen:
            flat = np.concatenate([mixer.weight.ravel(), mixer.bias, (mixer.hits - start).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([flat.tobytes()], pa.binary())], ["seen", "flat"])

    # At most 256 tasks, so at most 256 rows of fixed size come to the driver.
    told = units.where("c > 0").select("place", "token", "c").coalesce(256).mapInArrow(run, "seen bigint, flat binary").collect()
    mixer = Mixer.new()
    if told:
        flat = np.average([np.frombuffer(r.flat) for r in told], axis=0, weights=[r.seen for r in told])
        a, b = mixer.weight.size, mixer.weight.size + mixer.bias.size
        mixer.weight = flat[:a].reshape(mixer.weight.shape)
        mixer.bias = flat[a:b]
        mixer.hits = mixer.hits + flat[b:].reshape(mixer.hits.shape)
    return mixer


def token_hashes(raw: bytes, begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, short: np.ndarray) -> np.ndarray:
    """64-bit hash of each token's bytes."""
    h = (low * _MIX) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))
    for i in np.flatnonzero(~short).tolist():
        h[i] = xxhash.xxh64_intdigest(raw[begin[i] : end[i]], 7)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def cuts(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether a token begins a segment: the first and the fourth of a text, and those after a pair of words that the hash picks.

    The first segment, of at most BEFORE tokens, has nothing to be predicted from.
    """
    pair = (np.append(np.uint64(0), h[:-1]) * np.uint64(3) + h) * _MIX >> np.uint64(40)
    new = np.append(False, (pair % np.uint64(ANCHORS) == 0)[:-1])
    place = np.arange(len(h)) - np.repeat(bounds[:-1], np.diff(bounds))
    new &= place > BEFORE
    new |= (place == 0) | (place == BEFORE)
    return new


def continuations(h: np.ndarray, new: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text and number of each segment that has words before it, and hashes of those words and of the segment."""
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(h))
    owner = np.searchsorted(bounds, start, side="right") - 1
    number = np.arange(len(start)) - np.searchsorted(start, bounds[:-1])[owner]
    odd = np.uint64(0xD1342543DE82EF95)
    power = np.multiply.accumulate(np.full(len(h) + 1, odd, np.uint64))
    inverse = np.multiply.accumulate(np.full(len(h) + 1, pow(int(odd), -1, 1 << 64), np.uint64))
    total = np.append(np.uint64(0), np.cumsum(h * power[:-1], dtype=np.uint64))
    body = (total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64) * _MIX
    body ^= body >> np.uint64(29)
    have = np.flatnonzero(number > 0)
    at = start[have]
    context = (h[at - 3] * odd + h[at - 2]) * odd + h[at - 1]
    context ^= context >> np.uint64(31)
    return owner[have], number[have], context * _MIX, body[have] * odd


def text_key(id_: Column, text: Column) -> Column:
    """Rows equal in both have the same key; they are scored alike."""
    return F.xxhash64(id_, text)


def seen_continuations(source: DataFrame) -> DataFrame:
    """(key, train, seg, run, level, hit, q) for the segments of (key, train, t) whose words before came up in another training text's segment.

    ``level`` is the size of the context's count, ``hit`` and ``q`` whether and
    with which share the context went on in this way, ``run`` how many of the
    two segments before were hits. A training text's own segment is left out
    of its counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                raw, begin, end, bounds = tokens_of(part.column("t").to_pylist())
                h = token_hashes(raw, begin, end, *keys(raw, begin, end))
                doc, seg, context, body = continuations(h, cuts(h, bounds), bounds)
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays([part.column("key").take(rows), part.column("train").take(rows), pa.array(seg.astype(np.int32)), pa.array(context.view(np.int64)), pa.array(body.view(np.int64))], ["key", "train", "seg", "ctx", "body"])

    cut = stored(source.select("key", "train", "t").mapInArrow(run, "key bigint, train boolean, seg int, ctx bigint, body bigint"), "segments")
    counted = stored(cut.groupBy("ctx", "body").agg(F.sum(F.col("train").cast("bigint")).alias("c"), F.count("*").alias("n")), "continuations")
    # Only what is seen in training and by more than one text can tell anything.
    contexts = stored(counted.groupBy("ctx").agg(F.sum("c").alias("of_ctx"), F.sum("n").alias("n")).where("of_ctx > 0 AND n > 1").drop("n"), "contexts")
    bodies = stored(counted.where("c > 0 AND n > 1").drop("n"), "bodies")
    own = F.col("train").cast("bigint")
    some = cut.join(contexts, "ctx").withColumn("of_ctx", F.col("of_ctx") - own).where("of_ctx > 0")
    some = some.join(bodies, ["ctx", "body"], "left").withColumn("c", F.coalesce(F.col("c") - own, F.lit(0)))
    hit = (F.col("c") > 0).alias("hit")
    # Rows equal in id and text have the same key, segments and counts.
    some = stored(some.select("key", "train", "seg", F.least(F.floor(F.log2("of_ctx")), F.lit(TIERS - 1)).cast("int").alias("level"), hit, (F.col("c") / F.col("of_ctx")).alias("q")).dropDuplicates(["key", "seg"]), "seen")
    for table in (cut, counted, contexts, bodies):
        dropped(table)
    text = Window.partitionBy("key").orderBy("seg")
    before = lambda k: F.coalesce(((F.lag("seg", k).over(text) == F.col("seg") - k) & F.lag("hit", k).over(text)), F.lit(False))
    return some.withColumn("run", F.when(before(1), F.when(before(2), 2).otherwise(1)).otherwise(0))


#: Sizes of a context's count that are told apart, and lengths of a run of hits.
TIERS, RUNS = 8, 3


def fit_hits(told: dict[tuple[int, int], tuple[int, int]], rounds: int = 400, step: float = 0.5) -> np.ndarray:
    """Probability of a hit by tier and run, from (hits, all) of each: three counted predictors, mixed by weights that the run gates."""
    hits, every = np.zeros((TIERS, RUNS)), np.zeros((TIERS, RUNS))
    for (tier, run), (h, n) in told.items():
        hits[tier, run], every[tier, run] = h, n
    rates = [(hits.sum(axis, keepdims=True) + 0.4) / (every.sum(axis, keepdims=True) + 0.8) for axis in ((0,), (1,), ())]
    x = np.stack([np.broadcast_to(np.log(r / (1 - r)), hits.shape) for r in rates])
    weight = np.full((3, RUNS), 1 / 3)
    total = max(every.sum(), 1.0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(weight[:, None] * x).sum(0)))
        weight += step * ((hits - every * p)[None] * x).sum(1) / total
    return 1 / (1 + np.exp(-(weight[:, None] * x).sum(0)))


@dataclass
class Frequent:
    """Counts and spelled scores of frequent tokens by place, found by key."""

    table: PieceTable
    c: np.ndarray
    logp: np.ndarray  # (2, tokens): of a text that was not counted, and of one that was
    kinds: np.ndarray  # log10 of the kinds' shares of the texts

    @classmethod
    def of(cls, rows: pa.Table) -> Frequent:
        place, c, own = (rows[n].to_numpy() for n in ("place", "c", "own"))
        tokens = rows["token"].to_pylist()
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        end = np.cumsum(size)
        at = np.flatnonzero(size <= 15)
        low, high, _ = keys(b"".join(tokens), (end - size)[at], end[at])
        table = PieceTable()
        table.add(*with_place(low, high, place[at]), at.astype(np.int32))
        ends = [i for i, t in enumerate(tokens) if t == END]
        number = np.bincount(place[ends] >> 3, own[ends], minlength=KINDS)
        logp = np.stack([rows["fresh"].to_numpy(), rows["counted"].to_numpy()]).astype(np.float32)
        return cls(table, c, logp, np.log10((number + 0.5) / (number.sum() + 0.5 * KINDS)))


def with_place(low: np.ndarray, high: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit keys of short pieces and their places."""
    of = (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)
    return low ^ of, high + (of << np.uint64(7))


def _tell(part: pa.RecordBatch, frequent: Frequent, bottom: float, kinds: Kinds) -> Iterator[pa.RecordBatch]:
    """A row for each text with what is known of it, its score by segment, and one for each rare word of each text."""
    texts = part.column("t").to_pylist()
    raw, begin, end, bounds = tokens_of(texts)
    n_docs, sizes = len(texts), np.diff(bounds)
    low, high, short = keys(raw, begin, end)
    owner = np.repeat(np.arange(n_docs), sizes)
    place = kinds.places(texts, low, high, bounds)
    at = frequent.table.find(*with_place(low, np.where(short, high, 0), place)).astype(np.int64)
    at[~short] = -1
    # How often the token came up before in its text; the end is no token of before.
    h = token_hashes(raw, begin, end, low, high, short)
    nth = np.arange(len(at)) - np.repeat(bounds[:-1], sizes)
    order, heads = grouped(h + owner.astype(np.uint64) * _MIX)
    before = np.empty(len(at), np.int64)
    before[order] = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
    seen = np.append(0, np.cumsum(before > 0))
    repeats = seen[:-1] - np.repeat(seen[bounds[:-1]], sizes)
    share = np.where(nth > 0, (repeats + 0.5) / (nth + 1), 0)
    own = share * before / np.maximum(nth, 1)

    train = part.column("train").to_numpy(zero_copy_only=False)
    known = at >= 0
    c = frequent.c[np.where(known, at, 0)] if len(frequent.c) else np.zeros(len(at), np.int64)
    logp = frequent.logp[train[owner].astype(np.int64), np.where(known, at, 0)] if len(frequent.c) else np.zeros(len(at))
    value = np.where(known, np.log10((1 - share) * 10.0 ** logp.astype(np.float64) + own), 0)
    segment = np.cumsum(cuts(h, bounds)) - 1
    by_segment = np.bincount(segment, value)
    first = segment[bounds[:-1]]
    by_segment[first] += frequent.kinds[place[bounds[:-1]] >> 3]
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(by_segment)).astype(np.int32)), pa.array(by_segment))
    add = lambda values: np.bincount(owner, values, minlength=n_docs)
    base, is_known = add(np.where(known, np.log10((c + 0.5) / bottom), 0)), add((known & (c > 0)).astype(float)).astype(np.int64)
    n_bytes = pa.array([len((t or "").encode()) for t in texts], pa.int64())
    columns = [part.column("key"), part.column("uid"), part.column("train"), part.column("id"), pa.array(sizes), n_bytes, pa.array(is_known), pa.array(base), lists]
    names = ["key", "uid", "train", "id", "n_tokens", "n_bytes", "n_known", "base", "segs", "place", "token", "seg", "nth", "repeats", "before"]
    kinds_of = (pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(n_docs, k) for k in kinds_of]], names)
    for rare in (np.flatnonzero(~known & short), np.flatnonzero(~known & ~short)):
        if len(rare):
            doc = pa.array(owner[rare])
            token = short_names(low[rare], high[rare]) if short[rare[0]] else pa.array([raw[a:b] for a, b in zip(begin[rare].tolist(), end[rare].tolist(), strict=True)], pa.binary())
            told = [pa.array(place[rare].astype(np.int32)), token, *[pa.array(v[rare].astype(np.int32)) for v in (segment - first[owner], nth, repeats, before)]]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rare), columns[0].type), part.column("uid").take(doc), part.column("train").take(doc), *[pa.nulls(len(rare), x.type) for x in columns[3:]], *told], names)


@dataclass
class Model:
    """What of the model comes to the driver: all of bounded size."""

    kinds: Kinds
    table: Table
    less: int
    mixer: Mixer
    hits: np.ndarray


def score_texts(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", told: list | None = None) -> DataFrame:
    """(id, learned, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) for every row.

    The model learns from the rows where ``learns`` holds (null: it does) and
    scores all, those it learned from as if they alone had not been counted.
    A text's tokens are its words, A-Z lower-cased, and one end; a null or empty
    text is the end alone. ``base_score`` is the add-half unigram score,
    ``score`` the model's log10 probability. Repeated rows, and rows with a null
    id, learn and are scored each; an empty table gives no rows; other columns
    are not read. ``told`` gets the fitted Model, for tests.
    """
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    id_kind = docs.schema[id_col].dataType.simpleString()
    text, train = F.col(text_col), F.coalesce(learns, F.lit(True))
    source = docs.select(F.monotonically_increasing_id().alias("uid"), text_key(F.col(id_col), text).alias("key"), F.col(id_col).alias("id"), text.alias("t"), train.alias("train"))
    seen = seen_continuations(source)
    kinds = share(fit_kinds(docs, learns, id_col, text_col))
    units = stored(count_words(docs, learns, kinds, text_col), "units")
    total = units.agg(F.sum("c").alias("n"), F.count_if(F.col("first") & (F.col("of_token") > 0)).alias("v"), F.count("*").alias("number")).first()
    n_train, distinct, number = total.n or 0, total.v, total.number
    less = fewer_bits(number)
    table = share(count_bits(units, int(np.clip(-(-number // 2_000_000), 2, 512)), less))
    mixer = share(train_mixer(units, table, less))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in gathered(batches):
            tokens, place, c, n = rows["token"].to_pylist(), rows["place"].to_numpy(), rows["c"].to_numpy(), rows["n"].to_numpy()
            for name, itself, some in (("fresh", False, np.flatnonzero(n > c)), ("counted", True, np.flatnonzero(c > 0))):
                scores = np.zeros(len(tokens))
                scores[some] = mixer.value.score(table.value, [tokens[i] for i in some.tolist()], place[some], itself, less)
                rows = rows.append_column(name, pa.array(scores))
            yield from rows.to_batches(10_000)

    spelt = units.select("place", "token", "c", "n", "of_token").mapInArrow(spell, "place int, token binary, c bigint, n bigint, of_token bigint, fresh double, counted double")
    vocabulary = stored(spelt.select("place", "token", "n", "fresh", "counted", F.col("c").alias("own"), F.col("of_token").alias("c")), "vocabulary")
    dropped(units)
    # The lowest level of frequency (eighths of a power of two, some 500 of them) above which all pairs fit the bound.
    level = F.floor(F.log2("n") * 8).cast("int")
    least, room = 0, MOST_FREQUENT
    for r in sorted(vocabulary.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
        room -= r["count"]
        if room < 0:
            least = r.level + 1
            break
    heavy = vocabulary.where((level >= least) | (F.col("token") == F.lit(END))).select("place", "token", "own", "c", "fresh", "counted").toArrow()
    known = share(Frequent.of(heavy))
    bottom = n_train + 0.5 * (distinct + 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                yield from _tell(part, known.value, bottom, kinds.value)

    fields = f"key bigint, uid bigint, train boolean, id {id_kind}, n_tokens bigint, n_bytes bigint, n_known bigint, base double, segs array<double>, place int, token binary, seg int, nth int, repeats int, before int"
    every = stored(source.mapInArrow(read, fields), "told")

    # Whether a context's continuation was seen: the counted cells are few.
    cells = seen.where("train").groupBy("level", "run").agg(F.sum(F.col("hit").cast("bigint")).alias("h"), F.count("*").alias("n"))
    hits = fit_hits({(r.level, r.run): (r.h, r.n) for r in cells.collect()})
    if told is not None:
        told.append(Model(kinds.value, table.value, less, mixer.value, hits))
    chance = F.get(F.array(*[F.lit(float(p)) for p in hits.ravel()]), F.col("level") * RUNS + F.col("run"))
    guesses = seen.select("key", F.struct("seg", F.log10(1 - chance).alias("miss"), F.when(F.col("hit"), F.log10(chance * F.col("q"))).alias("right")).alias("g"))
    guesses = guesses.groupBy("key").agg(F.collect_list("g").alias("gs"))
    guesses = guesses.select("key", F.map_from_arrays(F.col("gs.seg"), F.col("gs")).alias("guess"))

    rare = every.where("token IS NOT NULL").select("uid", "train", "place", "token", "seg", "nth", "repeats", "before")
    rare = rare.join(vocabulary.select("place", "token", "c", "fresh", "counted").hint("merge"), ["token", "place"])
    logp = F.when(F.col("train"), F.col("counted")).otherwise(F.col("fresh"))
    again = F.when(F.col("nth") > 0, (F.col("repeats") + 0.5) / (F.col("nth") + 1)).otherwise(F.lit(0.0))
    value = F.log10((1 - again) * F.pow(F.lit(10.0), logp) + again * F.col("before") / F.greatest("nth", F.lit(1)))
    # What travels back to the texts is narrow: a place, a value and a count.
    rare = rare.select("uid", "seg", value.alias("value"), "c")
    texts = every.where("token IS NULL").select("key", "uid", "id", "train", "n_tokens", "n_bytes", F.col("n_known").alias("known"), F.col("base").alias("known_base"), "segs")
    own = texts.select("uid", F.posexplode("segs").alias("seg", "value")).withColumn("c", F.lit(None).cast("bigint"))
    parts = own.unionByName(rare).repartition("uid").groupBy("uid", "seg").agg(F.sum("value").alias("value"), F.count_if(F.col("c") > 0).alias("n_known"), F.sum(F.log10((F.col("c") + 0.5) / F.lit(bottom))).alias("base"))
    guessed = texts.select("key", F.col("uid").alias("uid")).join(guesses, "key").select("uid", "guess")
    guess = F.try_element_at("guess", F.col("seg"))
    spelt = F.col("value") + F.coalesce(guess["miss"], F.lit(0.0))
    top = F.greatest(spelt, guess["right"])
    least = F.least(spelt, guess["right"])
    mixed = F.when(guess["right"].isNull(), spelt).otherwise(top + F.log10(1 + F.pow(F.lit(10.0), least - top)))
    parts = parts.join(guessed, "uid", "left").withColumn("value", mixed)
    out = parts.groupBy("uid").agg(F.sum("n_known").alias("n_known"), F.coalesce(F.sum("base"), F.lit(0.0)).alias("base"), F.sum("value").alias("score"))
    out = out.join(texts.select(*[F.col(c).alias(c) for c in ("uid", "id", "train", "n_tokens", "n_bytes", "known", "known_base")]), "uid")
    out = out.withColumn("n_known", F.col("n_known") + F.col("known")).withColumn("base", F.col("base") + F.col("known_base"))
    per_byte = -F.col("score") / F.lit(float(np.log10(2))) / (F.col("n_bytes") + 1)
    return out.select(F.col("id").alias(id_col), F.col("train").alias("learned"), "n_tokens", "n_known", F.lit(n_train).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score", "n_bytes", per_byte.alias("bits_per_byte"))
