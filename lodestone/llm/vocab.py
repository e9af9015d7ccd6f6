"""Vocabulary files of public tokenizers as cached encoders of whole texts.

A file's path is a parameter; nothing of it is copied here.
"""

from __future__ import annotations

import base64
from functools import cache
from pathlib import Path

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from .pretoken import PieceCache, PieceTable


@cache
def ranks(path: str) -> dict[bytes, int]:
    with Path(path).open("rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class LibraryEncoder:
    """The ids that ``tokenizers`` gives for a byte-level BPE file with its defaults, without added special tokens.

    Ordinary pieces are encoded once each by rank merging and kept; a text
    that holds a special token's string goes through the library itself.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        of_byte = {c: b for b, c in _byte_letters().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        table = {bytes(map(of_byte.__getitem__, t)): i for t, i in vocabulary.items() if t not in self.special}
        self.core = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={})
        self.cache = PieceCache(self.piece)

    def piece(self, piece: bytes) -> list[int]:
        return self.core._encode_single_piece(piece)

    def _marked(self, texts: list[str]) -> list[int]:
        return [i for i, t in enumerate(texts) if any(s in t for s in self.special)]

    def counts(self, texts: list[str], tier: PieceTable | None = None) -> np.ndarray:
        marked = self._marked(texts)
        if not marked:
            return self.cache.counts(texts, tier)
        rest = list(texts)
        for i in marked:
            rest[i] = ""
        out = self.cache.counts(rest, tier)
        for i in marked:
            out[i] = len(self.tokenizer.encode(texts[i], add_special_tokens=False).ids)
        return out

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        marked = self._marked(texts)
        if not marked:
            return self.cache.ids(texts)
        parts, special = [], set(marked)
        for i, text in enumerate(texts):
            own = self.tokenizer.encode(text, add_special_tokens=False).ids if i in special else self.cache.ids([text])[0]
            parts.append(np.asarray(own, np.int32))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE files write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


@cache
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)
