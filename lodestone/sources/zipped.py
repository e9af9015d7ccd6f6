"""Zip archives by ranged reads: the directory from the file's end, then only the entries that are wanted.

Nothing in an archive is trusted: every length is held against the file and the
limits before it is used, and entries are inflated in chunks, so what is held in
memory does not depend on what the archive claims.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

# The records of the zip format, their marks and layouts.
END, END64_AT, END64, LISTED, LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
_END, _END64_AT, _END64 = struct.Struct("<4s4H2IH"), struct.Struct("<4sIQI"), struct.Struct("<4sQ2H2I4Q")
_LISTED, _LOCAL, _FIELD, _LONG = struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s5H3I2H"), struct.Struct("<2H"), struct.Struct("<Q")
FULL16, FULL32, ZIP64, UNICODE_PATH, UTF8, ENCRYPTED = 0xFFFF, 0xFFFFFFFF, 0x0001, 0x7075, 0x800, 0x1
STORED, DEFLATED = 0, 8
#: The format's version that entries need here, and its first day (1 January 1980) as their date.
NEEDS, FIRST_DAY = 20, 0x21
#: Bytes from a file's end that hold its end record for certain.
END_MOST = _END.size + 65_535 + _END64_AT.size
#: Entries and directory bytes of an archive, packed bytes of an entry, bytes read at a time, bytes first inflated where a reader may stop early.
ENTRIES_MOST, DIRECTORY_MOST, PACKED_MOST, CHUNK, FIRST = 20_000, 16 << 20, 32 << 20, 64 << 10, 1 << 10


class ArchiveError(ValueError):
    """An archive or entry that cannot be read; the message says why."""


class Entry(NamedTuple):
    name: str
    method: int
    size: int
    packed: int
    crc: int
    offset: int
    encrypted: bool
    zip64: bool

    @property
    def is_folder(self) -> bool:
        return self.name.endswith("/")


def _fields(extra: bytes) -> Iterator[tuple[int, bytes]]:
    """Numbers and contents of extra fields, as far as they are whole."""
    while len(extra) >= _FIELD.size:
        number, length = _FIELD.unpack_from(extra)
        if _FIELD.size + length > len(extra):
            return
        yield number, extra[_FIELD.size : _FIELD.size + length]
        extra = extra[_FIELD.size + length :]


class Archive:
    """``read_at(place, length)`` gives a file's bytes; ``bytes_read`` counts them."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self._read_at, self.size, self.bytes_read = read_at, size, 0
        self.entries = {e.name: e for e in self._directory(*self._end())}

    @classmethod
    def of(cls, data: bytes) -> Archive:
        return cls(lambda at, n: data[at : at + n], len(data))

    def _read(self, at: int, n: int) -> bytes:
        if at < 0 or at + n > self.size:
            raise ArchiveError(f"{n} bytes at {at} lie outside the file")
        got = self._read_at(at, n)
        self.bytes_read += len(got)
        if len(got) < n:
            raise ArchiveError("the file ends early")
        return got

    def _end(self) -> tuple[int, int, int]:
        """(entries, bytes, place) of the directory."""
        n = min(self.size, END_MOST)
        tail = self._read(self.size - n, n)
        at = tail.rfind(END)
        while at >= 0:
            if at + _END.size <= n and at + _END.size + _END.unpack_from(tail, at)[7] == n:  # its comment ends with the file
                break
            at = tail.rfind(END, 0, at)
        else:
            raise ArchiveError("no end record: not a zip archive")
        count, size, place = _END.unpack_from(tail, at)[4:7]
        before = at - _END64_AT.size
        if before >= 0 and tail.startswith(END64_AT, before):
            record = self._read(_END64_AT.unpack_from(tail, before)[2], _END64.size)
            mark, *_, count, size, place = _END64.unpack(record)
            if mark != END64:
                raise ArchiveError("no zip64 record where its locator points")
        elif count == FULL16 or FULL32 in (size, place):
            raise ArchiveError("full fields without a zip64 locator")
        if count > ENTRIES_MOST or size > DIRECTORY_MOST:
            raise ArchiveError(f"a directory of {count} entries and {size} bytes is too large")
        return count, size, place

    def _directory(self, count: int, size: int, place: int) -> Iterator[Entry]:
        listed, at = self._read(place, size), 0
        for k in range(count):
            if at + _LISTED.size > size or not listed.startswith(LISTED, at):
                raise ArchiveError(f"entry {k} of the directory is broken")
            _, _, _, flags, method, _, _, crc, packed, raw, name_n, extra_n, note_n, _, _, _, offset = _LISTED.unpack_from(listed, at)
            start = at + _LISTED.size
            at = start + name_n + extra_n + note_n
            if at > size:
                raise ArchiveError(f"entry {k} goes beyond the directory")
            own = listed[start : start + name_n]
            name, zip64 = own.decode("utf-8" if flags & UTF8 else "latin-1", "replace"), False
            for number, field in _fields(listed[start + name_n : start + name_n + extra_n]):
                if number == ZIP64:  # holds those of the three that are full, in this order
                    zip64, longs = True, (v for (v,) in _LONG.iter_unpack(field[: len(field) // 8 * 8]))
                    raw, packed, offset = (next(longs, v) if v == FULL32 else v for v in (raw, packed, offset))
                elif number == UNICODE_PATH and len(field) >= 5 and int.from_bytes(field[1:5], "little") == zlib.crc32(own):
                    name = field[5:].decode("utf-8", "replace")
            if offset + _LOCAL.size > self.size or offset + packed > self.size:
                raise ArchiveError(f"{name} lies outside the file")
            yield Entry(name, method, raw, packed, crc, offset, bool(flags & ENCRYPTED), zip64)

    def chunks(self, entry: Entry, head: int | None = None) -> Iterator[bytes]:
        """An entry's bytes as they are inflated, checked by length and CRC at its end; with ``head`` about that many at most, unchecked, and few at first."""
        if entry.encrypted or entry.method not in (STORED, DEFLATED):
            raise ArchiveError(f"{entry.name}: " + ("encrypted" if entry.encrypted else f"packing method {entry.method}"))
        if head is None and entry.packed > PACKED_MOST:
            raise ArchiveError(f"{entry.name}: {entry.packed} packed bytes are too many")
        mark, *_, name_n, extra_n = _LOCAL.unpack(self._read(entry.offset, _LOCAL.size))
        if mark != LOCAL:
            raise ArchiveError(f"{entry.name}: broken header")
        at, end = (start := entry.offset + _LOCAL.size + name_n + extra_n), start + entry.packed
        inflate = zlib.decompressobj(-zlib.MAX_WBITS) if entry.method == DEFLATED else None
        crc = made = 0
        step = CHUNK if head is None else FIRST
        while at < end and (head is None or made < head):
            packed = self._read(at, min(CHUNK, end - at))
            at += len(packed)
            full = False
            while packed or full:  # what was inflated may stand behind what was given out, with nothing left to put in
                try:
                    out = inflate.decompress(packed, step) if inflate else packed[:step]
                except zlib.error as error:
                    raise ArchiveError(f"{entry.name}: {error}") from error
                packed = inflate.unconsumed_tail if inflate else packed[step:]
                full = inflate is not None and len(out) == step
                made += len(out)
                if made > entry.size and head is None:
                    raise ArchiveError(f"{entry.name}: more than the {entry.size} bytes that it claims")
                if head is None:
                    crc = zlib.crc32(out, crc)
                else:
                    step = min(2 * step, CHUNK)
                if out:
                    yield out
                if head is not None and made >= head:
                    return
        if head is None and (made, crc) != (entry.size, entry.crc):
            raise ArchiveError(f"{entry.name}: " + (f"{made} bytes, not {entry.size}" if made != entry.size else "wrong checksum"))

    def read(self, name: str, most: int) -> bytes:
        """A whole entry of at most ``most`` bytes."""
        entry = self.entries.get(name)
        if entry is None:
            raise ArchiveError(f"no entry {name}")
        if entry.size > most:
            raise ArchiveError(f"{name}: {entry.size} bytes are more than {most}")
        return b"".join(self.chunks(entry))


class Packed(NamedTuple):
    """An entry as archives hold it: what stands at its place, and what the directory says before and after that place is told."""

    local: bytes
    told: tuple
    name: bytes


def packed(name: str, data: bytes, method: int = DEFLATED) -> Packed:
    """An entry that any number of archives can hold."""
    own, body = name.encode(), data
    if method == DEFLATED:  # a window and tables no larger than a small entry needs, as making these takes longer than deflating it
        deflate = zlib.compressobj(wbits=-12, memLevel=5) if len(data) <= 1 << 12 else zlib.compressobj(wbits=-zlib.MAX_WBITS)
        body = deflate.compress(data) + deflate.flush()
    told = (NEEDS, 0 if own.isascii() else UTF8, method, 0, FIRST_DAY, zlib.crc32(data), len(body), len(data), len(own), 0)
    return Packed(_LOCAL.pack(LOCAL, *told) + own + body, told, own)


def archive(entries: Iterable[Packed]) -> bytes:
    """A zip archive of small entries, without zip64 records."""
    places, listed, at = [], [], 0
    for e in entries:
        places.append(e.local)
        listed += (_LISTED.pack(LISTED, NEEDS, *e.told, 0, 0, 0, 0, at), e.name)
        at += len(e.local)
    directory = b"".join(listed)
    return b"".join((*places, directory, _END.pack(END, 0, 0, len(places), len(places), len(directory), at, 0)))
