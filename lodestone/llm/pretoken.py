"""Vectorised pre-tokenisation and a bounded cache of encoded pieces.

The pattern of byte-level BPE is scanned for a whole batch of texts at once:
runs of one character class, with the rules for contractions and for the last
character of a white-space run applied to the run borders.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import regex

OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)


@cache
def class_table() -> np.ndarray:
    """Class of every code point, by the same properties as the pattern names."""
    table = np.zeros(0x110000, np.uint8)
    low, high = "".join(map(chr, range(0xD800))), "".join(map(chr, range(0xE000, 0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for chars, base in ((low, 0), (high, 0xE000)):
            for m in regex.finditer(pattern, chars):
                table[base + m.start() : base + m.end()] = kind
    return table


def pieces(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of all texts: the UTF-8 buffer, each piece's byte start and end, and where each text's pieces begin.

    The last array has one more entry than there are texts. An empty text has no pieces.
    """
    joined = "\n".join(texts) + "\n" if texts else ""
    if not joined:
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    raw = joined.encode()
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    n = len(points)
    edges = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kind = class_table()[points]
    kind[edges] = EDGE
    new = np.empty(n + 4, bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:n])
    new[edges] = True
    new[edges + 1] = True
    # The last character of a white-space run before text stands alone, or leads the next piece if it is a blank.
    is_space = kind == SPACE
    after = np.flatnonzero(is_space[:-1] & ~is_space[1:]) + 1
    after = after[kind[after] != EDGE]
    new[after - 1] = True
    new[after[points[after - 1] == 32]] = False
    quote = np.flatnonzero((points == 39) & new[:n])
    if len(quote):
        padded = np.concatenate([points, np.zeros(4, "<u4")])
        first, second = padded[quote + 1], padded[quote + 2]
        one = quote[np.isin(first, [115, 116, 109, 100])]  # s t m d
        two = quote[((first == 114) | (first == 118)) & (second == 101) | (first == 108) & (second == 108)]  # re ve ll
        new[one + 1] = False
        new[two + 1] = False
        new[two + 2] = False
        new[one + 2] = True
        new[two + 3] = True
    begin = np.flatnonzero(new[:n])
    end = np.append(begin[1:], n)
    keep = kind[begin] != EDGE
    begin, end = begin[keep], end[keep]
    bounds = np.concatenate([[0], np.searchsorted(begin, edges)])
    if len(raw) != n:
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        begin, end = at[begin], at[end]
    return raw, begin, end, bounds


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def keys(raw: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact 128-bit keys of the pieces of at most 15 bytes (the last byte holds the length), and which those are."""
    size = end - begin
    short = size <= 15
    padded = np.frombuffer(raw + bytes(16), np.uint8)
    words = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(raw) + 8,), (1,))
    low = words[begin] & _MASKS[np.minimum(size, 8)]
    high = words[np.minimum(begin + 8, len(raw))] & _MASKS[np.clip(size - 8, 0, 7)]
    return low, high | (np.minimum(size, 16).astype(np.uint64) << np.uint64(56)), short


class PieceTable:
    """Open-addressing table from 128-bit keys to entry numbers; doubles until ``most`` entries."""

    def __init__(self, bits: int = 16):
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.bits, self.used = bits, 0
        self.low, self.high = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.value = np.full(1 << bits, -1, np.int32)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = low * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed = (mixed + high) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 where it has none."""
        found = np.full(len(low), -1, np.int32)
        at, left = self._slot(low, high), None
        while len(at):
            value = self.value[at]
            hit = (self.low[at] == low) & (self.high[at] == high)
            if left is None:
                found[:] = np.where(hit, value, -1)
            else:
                found[left[hit]] = value[hit]
            go = np.flatnonzero(~hit & (value >= 0))
            left = go if left is None else left[go]
            at, low, high = (at[go] + 1) & ((1 << self.bits) - 1), low[go], high[go]
        return found

    def add(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> None:
        """Add distinct keys that the table lacks."""
        while (self.used + len(low)) * 2 > 1 << self.bits:
            old = self.value >= 0
            was = self.low[old], self.high[old], self.value[old]
            self._make(self.bits + 1)
            self._put(*was)
        self._put(low, high, value)

    def _put(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> None:
        self.used += len(low)
        at = self._slot(low, high)
        while len(at):
            free = self.value[at] < 0
            self.value[at[free]] = value[free]
            won = free & (self.value[at] == value)
            self.low[at[won]], self.high[at[won]] = low[won], high[won]
            left = ~won
            at, low, high, value = (at[left] + 1) & ((1 << self.bits) - 1), low[left], high[left], value[left]


def piece_table(values: dict[bytes, int]) -> PieceTable:
    """A table of pieces of at most 15 bytes."""
    table, raw = PieceTable(), b"".join(values)
    end = np.cumsum(np.fromiter(map(len, values), np.int64, len(values)))
    begin = np.concatenate([[0], end[:-1]]) if len(end) else end
    low, high, _ = keys(raw, begin, end)
    table.add(low, high, np.fromiter(values.values(), np.int32, len(values)))
    return table


class PieceCache:
    """Token ids of pieces, kept for the life of a worker in bounded memory.

    ``encode`` turns one piece's bytes into ids and is called once for each
    piece that is not in the cache. Beyond ``most`` entries the cache starts anew.
    """

    def __init__(self, encode: Callable[[bytes], list[int]], most: int = 1_000_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.table, self.long = PieceTable(), {}
        self.pool, self.filled = np.zeros(1 << 16, np.int32), 0
        self.start, self.count, self.entries = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0

    def _enter(self, ids: list[int]) -> int:
        k = len(ids)
        while self.filled + k > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        if self.entries == len(self.start):
            self.start, self.count = np.concatenate([self.start, self.start]), np.concatenate([self.count, self.count])
        self.pool[self.filled : self.filled + k] = ids
        self.start[self.entries], self.count[self.entries] = self.filled, k
        self.filled += k
        self.entries += 1
        return self.entries - 1

    def _add(self, raw: bytes, begin: np.ndarray, end: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Entries of the pieces ``which`` that the table lacks."""
        seen: dict[bytes, int] = {}
        first, out = [], np.empty(len(which), np.int32)
        for k, (i, b, e) in enumerate(zip(which.tolist(), begin[which].tolist(), end[which].tolist(), strict=True)):
            piece = raw[b:e]
            entry = seen.get(piece)
            if entry is None:
                entry = self.long.get(piece) if e - b > 15 else None
                if entry is None:
                    entry = self._enter(self.encode(piece))
                    if e - b > 15:
                        self.long[piece] = entry
                    else:
                        first.append((i, entry))
                seen[piece] = entry
            out[k] = entry
        if first:
            at, entry = np.array(first, np.int64).T
            low, high, _ = keys(raw, begin[at], end[at])
            self.table.add(low, high, entry.astype(np.int32))
        return out

    def entries_of(self, raw: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self.entries > self.most:
            self._clear()
        low, high, short = keys(raw, begin, end)
        found = self.table.find(low, high)
        found[~short] = -1
        missing = np.flatnonzero(found < 0)
        if len(missing):
            found[missing] = self._add(raw, begin, end, missing)
        return found

    def counts(self, texts: list[str], tier: PieceTable | None = None) -> np.ndarray:
        """Number of tokens of each text; ``tier`` maps frequent pieces to theirs and is asked first."""
        raw, begin, end, bounds = pieces(texts)
        low, high, short = keys(raw, begin, end)
        number = tier.find(low, high) if tier else np.full(len(begin), -1, np.int32)
        missing = np.flatnonzero((number < 0) | ~short)
        entry = self.entries_of(raw, begin[missing], end[missing])
        number[missing] = self.count[entry]
        total = np.concatenate([[0], np.cumsum(number, dtype=np.int64)])
        return total[bounds[1:]] - total[bounds[:-1]]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin (one entry more)."""
        raw, begin, end, bounds = pieces(texts)
        entry = self.entries_of(raw, begin, end)
        count = self.count[entry].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(self.start[entry] - total[:-1], count) + np.arange(total[-1])
        return self.pool[at], total[bounds]
