"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decode.

A state holds the places where a token may have begun that is not yet whole,
each with the token that ends there; a transition names the token that ends
with its byte. Which of those stand is known once nothing before is open, so
the lookahead is bounded by the longest token. Transitions are made when first
taken and kept in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .pretoken import PieceCache
from .vocab import ranks as load_ranks


#: Ids that the decoder takes at once.
RUN = 1 << 16


class MergeTransducer:
    """Left-to-right encoder whose output equals merging by ascending rank.

    A tokenisation is the merged one exactly if every token and every two
    neighbours merge back to themselves; so the open bytes have one valid last
    token at each position, which a step finds from those before it.
    """

    def __init__(self, ranks: dict[bytes, int], most_states: int = 400_000):
        self.ranks, self.most_states = ranks, most_states
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        # Trie of the tokens: (node << 8 | byte) -> node, and the token that a node is.
        self.child: dict[int, int] = {}
        self.token_at = [-1]
        self.inner = bytearray(1)
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = 1
                node = self.child.setdefault(node << 8 | byte, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(-1)
                    self.inner.append(0)
            self.token_at[node] = rank
        self.halves: dict[int, tuple[int, int] | None] = {}
        self._reset()

    def _reset(self) -> None:
        """Forget all states and the pairs of tokens looked at."""
        self.agree: dict[int, bool] = {}
        self.joint: dict[int, int] = {}
        # A state: for each place where a token may have begun, its trie node so far and the token before it.
        self.states: list[tuple[tuple[int, int], ...]] = [((0, -1),)]
        self.numbers = {self.states[0]: 0}
        self.moves: dict[int, int] = {}

    def merged(self, piece: bytes, below: int = 1 << 60) -> list[bytes]:
        """Rank merging as defined, by merges of a rank under ``below`` only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _made_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens of a token's last merge; None for a byte, and for what no merging reaches."""
        if token not in self.halves:
            text = self.bytes_of[token]
            parts = self.merged(text, token) if len(text) > 1 else []
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def _joined(self, left: int, right: int) -> int:
        """The token that two tokens merge to, or a number above all."""
        key = left << 32 | right
        token = self.joint.get(key)
        if token is None:
            token = self.joint[key] = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], 1 << 60)
        return token

    def _fits(self, before: int, token: int) -> bool:
        """Whether both stay as they are when merged side by side.

        Goes back through the merges of both, latest first: at each time the
        two parts that touch must not have merged before they grew further.
        """
        key = before << 32 | token
        known = self.agree.get(key)
        if known is not None:
            return known
        left, right, known, until = before, token, True, 1 << 60
        a, b = self._made_of(left), self._made_of(right)
        while True:
            if self._joined(left, right) < until:
                known = False
                break
            # Of equal ranks the merge on the left comes first, so the right part is undone first.
            if b is not None and (a is None or right >= left):
                until, right = right + 1, b[0]
                b = self._made_of(right)
            elif a is not None:
                until, left = left, a[1]
                a = self._made_of(left)
            else:
                break
        self.agree[key] = known
        return known

    def _move(self, state: int, byte: int) -> int:
        """The transition of a state on a byte: next state << 24 | the token that ends here."""
        alive, own = [], -1
        for node, ahead in self.states[state]:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            if self.inner[node]:
                alive.append((node, ahead))
            token = self.token_at[node]
            if own < 0 and token >= 0 and (self.size[token] == 1 or self._made_of(token)) and (ahead < 0 or self._fits(ahead, token)):
                own = token
        if own < 0:
            raise ValueError(f"the ranks have no token for byte {byte}")
        alive.append((0, own))
        key = tuple(alive)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
        move = self.moves[state << 8 | byte] = number << 24 | own
        return move

    def _chain(self, last: list[int]) -> list[int]:
        tokens, end = [], len(last)
        while end:
            tokens.append(last[end - 1])
            end -= self.size[last[end - 1]]
        return tokens[::-1]

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one piece that comes in chunks; those before a state with nothing open go out at once."""
        if len(self.states) + len(self.agree) + len(self.joint) > self.most_states:
            self._reset()
        state, last = 0, []
        for chunk in chunks:
            for byte in chunk:
                move = self.moves.get(state << 8 | byte) or self._move(state, byte)
                state = move >> 24
                last.append(move & 0xFFFFFF)
                if len(self.states[state]) == 1:  # no token can begin before here and end later
                    yield from self._chain(last)
                    last = []
        yield from self._chain(last)

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token; a pre-token that is itself a token stays whole."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else list(self.stream((piece,)))


#: States of the UTF-8 machine: between characters, so many bytes still to come, and the four with a narrower second byte; then the fault.
START, ONE, TWO, THREE, AFTER_E0, AFTER_ED, AFTER_F0, AFTER_F4, FAULT = range(9)


def _utf8_moves() -> np.ndarray:
    """(state, byte) -> state, by the table of well-formed sequences."""
    to = np.full((9, 256), FAULT, np.uint8)
    to[START, :0x80] = START
    for first, last, state in ((0xC2, 0xDF, ONE), (0xE1, 0xEC, TWO), (0xEE, 0xEF, TWO), (0xF1, 0xF3, THREE), (0xE0, 0xE0, AFTER_E0), (0xED, 0xED, AFTER_ED), (0xF0, 0xF0, AFTER_F0), (0xF4, 0xF4, AFTER_F4)):
        to[START, first : last + 1] = state
    for state, low, high, then in ((ONE, 0x80, 0xBF, START), (TWO, 0x80, 0xBF, ONE), (THREE, 0x80, 0xBF, TWO), (AFTER_E0, 0xA0, 0xBF, ONE), (AFTER_ED, 0x80, 0x9F, ONE), (AFTER_F0, 0x90, 0xBF, TWO), (AFTER_F4, 0x80, 0x8F, TWO)):
        to[state, low : high + 1] = then
    return to


_MOVES = [row.tolist() for row in _utf8_moves()]
_REPLACED = "\ufffd".encode()


def _advance(waiting: bytes, new: bytes) -> tuple[bytes, bytes]:
    """(out, waiting): the machine over bytes, begun after those of a character that is not whole yet."""
    if not waiting and new.isascii():
        return new, b""
    state = START
    for byte in waiting:
        state = _MOVES[state][byte]
    raw, whole, parts, begin = waiting + new, 0, [], 0
    for at in range(len(waiting), len(raw)):
        to = _MOVES[state][raw[at]]
        if to == FAULT and state != START:  # what was open is no character; this byte may begin one
            parts.append(raw[begin:whole] + _REPLACED)
            begin = whole = at
            to = _MOVES[START][raw[at]]
        if to == FAULT:
            parts.append(raw[begin:at] + _REPLACED)
            begin, to = at + 1, START
        state = to
        if state == START:
            whole = at + 1
    return b"".join([*parts, raw[begin:whole]]), raw[whole:]


class StreamDecoder:
    """Ids to UTF-8 as they arrive, by a state machine over the bytes.

    Only whole characters come out: one cut by a token border waits for the rest
    of its bytes. What is no UTF-8 comes out as the replacement character, one
    for each longest beginning of a character. The machine's way through a token
    is walked once from each state that the token is met in and kept: an id then
    takes one look-up, and ids that end where they begin are joined at once.
    """

    #: Ways kept besides those from between characters.
    most_steps = 1 << 18

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.waiting = tokens, b""
        self.begun = [_advance(b"", t) for t in tokens]
        self.out = [out for out, _ in self.begun]
        self.closed = np.array([not waiting for _, waiting in self.begun], bool)
        self.steps: dict[tuple[bytes, int], tuple[bytes, bytes]] = {}

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> StreamDecoder:
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        return cls(tokens)

    def _step(self, waiting: bytes, i: int) -> tuple[bytes, bytes]:
        if not waiting:
            return self.begun[i]
        step = self.steps.get((waiting, i))
        if step is None:
            if len(self.steps) >= self.most_steps:
                self.steps.clear()
            step = self.steps[waiting, i] = _advance(waiting, self.tokens[i])
        return step

    def feed(self, ids: Iterable[int]) -> bytes:
        """The bytes of all characters that these ids end."""
        ids = ids if isinstance(ids, np.ndarray) else np.array(list(ids), np.int64)
        list_, parts, at = ids.tolist(), [], 0
        for next_ in [*np.flatnonzero(~self.closed[ids]).tolist(), len(list_)]:
            while self.waiting and at < len(list_):  # up to the end of the open character
                out, self.waiting = self._step(self.waiting, list_[at])
                parts.append(out)
                at += 1
            if at <= next_:
                parts += map(self.out.__getitem__, list_[at:next_])
                at = next_
                if at < len(list_):
                    out, self.waiting = self._step(b"", list_[at])
                    parts.append(out)
                    at += 1
        return b"".join(parts)

    def finish(self) -> bytes:
        """What a character that never ended leaves; the decoder is as new afterwards."""
        out = _REPLACED if self.waiting else b""
        self.waiting = b""
        return out


class _Worker:
    def __init__(self, path: str):
        table = load_ranks(path)
        self.cache = PieceCache(MergeTransducer(table).encode)
        self.decoder = StreamDecoder.of(table)

    def decoded(self, ids: np.ndarray) -> bytes:
        """The text of a document's ids, which the decoder takes in runs."""
        out = [self.decoder.feed(ids[k : k + RUN]) for k in range(0, len(ids), RUN)]
        return b"".join([*out, self.decoder.finish()])


@cache
def _worker(path: str) -> _Worker:
    return _Worker(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``ids`` array<int> and ``decoded`` binary.

    ``path`` names a file of ranks. A null or empty text has no ids and decodes
    to no bytes; repeated rows give repeated results, an empty table an empty
    one; other columns are not read. ``decoded`` is made from the ids alone, by
    the streaming decoder. A byte that the ranks lack raises ValueError.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _worker(path)
        for batch in batches:
            for part in slices(batch, "t"):
                ids, bounds = worker.cache.ids([t or "" for t in part.column("t").to_pylist()])
                at = bounds.tolist()
                decoded = [worker.decoded(ids[a:b]) for a, b in zip(at, at[1:], strict=False)]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("k"), lists, pa.array(decoded, pa.binary())], [id_col, "ids", "decoded"])

    return docs.selectExpr(f"`{id_col}` AS k", f"`{text_col}` AS t").mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")
