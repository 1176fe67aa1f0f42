"""Decoder of snapshot (RDB) streams: one tuple of metadata per key, values skipped by offset.

Reads any object with ``read(n)``, front to back, in bounded memory: string values are skipped in pieces, and only
packed containers (whose entries must be counted) are held, one at a time. Integers in strings are signed and little-endian,
old sorted-set scores and zipmap lengths follow the public format.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, NamedTuple

from keyloom.functions.slots import codis_slot_of, redis_slot_of
from keyloom.schema import ENCODINGS, MAX_EXPIRE_MS, TYPES

from . import lzf

VERSIONS = range(1, 13)
_SKIP = 1 << 20


class RdbError(ValueError):
    """The stream is no sound snapshot."""


class RdbTruncated(RdbError):
    """The stream ends inside a snapshot."""


class Record(NamedTuple):
    db: int
    key: bytes
    type: str
    member_count: int | None
    rdb_size: int
    encoding: str
    expire_at_ms: int | None
    idle_seconds: int | None
    freq: int | None


@dataclass
class Other:
    """Anything in the stream that is no key: auxiliary fields, database sizes, functions, module data."""

    kind: str
    value: Any = None


class Reader:
    """Buffered sequential reads with a position."""

    def __init__(self, stream, block: int = 1 << 16):
        self._stream, self._block = stream, block
        self._data, self._at, self._base = b"", 0, 0

    def tell(self) -> int:
        return self._base + self._at

    def _fill(self, need: int) -> None:
        parts, have = [self._data[self._at :]], len(self._data) - self._at
        while have < need:
            more = self._stream.read(max(self._block, need - have))
            if not more:
                raise RdbTruncated(f"the stream ends at {self.tell() + have}")
            parts.append(more)
            have += len(more)
        self._base += self._at
        self._data, self._at = b"".join(parts), 0

    def read(self, n: int) -> bytes:
        if len(self._data) - self._at < n:
            self._fill(n)
        out = self._data[self._at : self._at + n]
        self._at += n
        return out

    def byte(self) -> int:
        if self._at >= len(self._data):
            self._fill(1)
        self._at += 1
        return self._data[self._at - 1]

    def skip(self, n: int) -> None:
        while n > 0:
            have = len(self._data) - self._at
            if have >= n:
                self._at += n
                return
            n -= have
            self._at += have
            self._fill(min(n, _SKIP))

    def at_end(self) -> bool:
        if self._at < len(self._data):
            return False
        try:
            self._fill(1)
        except RdbTruncated:
            return True
        return False

    def u64(self) -> int:
        return int.from_bytes(self.read(8), "little")

    # Lengths and strings

    def length_or_special(self) -> tuple[int, bool]:
        """A length, or the number of a special string form."""
        first = self.byte()
        kind = first >> 6
        if kind == 0:
            return first & 63, False
        if kind == 1:
            return (first & 63) << 8 | self.byte(), False
        if first == 0x80:
            return int.from_bytes(self.read(4), "big"), False
        if first == 0x81:
            return int.from_bytes(self.read(8), "big"), False
        if kind == 3 and first & 63 < 4:
            return first & 63, True
        raise RdbError(f"length byte {first:#04x} at {self.tell() - 1}")

    def length(self) -> int:
        n, special = self.length_or_special()
        if special:
            raise RdbError(f"a string where a length should be, at {self.tell()}")
        return n

    def string(self) -> bytes:
        n, special = self.length_or_special()
        if not special:
            return self.read(n)
        if n < 3:
            return str(int.from_bytes(self.read(1 << n), "little", signed=True)).encode()
        packed, size = self.length(), self.length()
        try:
            return lzf.decompress(self.read(packed), size)
        except lzf.LzfError as e:
            raise RdbError(f"at {self.tell()}: {e}") from e

    def skip_string(self) -> str:
        """Skip a string; the name of its form."""
        n, special = self.length_or_special()
        if not special:
            self.skip(n)
            return "raw"
        if n < 3:
            self.skip(1 << n)
            return "int"
        packed = self.length()
        self.length()
        self.skip(packed)
        return "lzf"


# Packed containers: entries of a whole buffer


def ziplist_entries(data: bytes) -> int:
    at, n, end = 10, 0, len(data)
    fixed = {0xC0: 2, 0xD0: 4, 0xE0: 8, 0xF0: 3, 0xFE: 1}
    try:
        while data[at] != 0xFF:
            at += 5 if data[at] == 0xFE else 1
            head = data[at]
            kind = head >> 6
            if kind == 0:
                at += 1 + (head & 63)
            elif kind == 1:
                at += 2 + ((head & 63) << 8 | data[at + 1])
            elif kind == 2:
                at += 5 + int.from_bytes(data[at + 1 : at + 5], "big")
            elif head in fixed:
                at += 1 + fixed[head]
            elif 0xF1 <= head <= 0xFD:
                at += 1
            else:
                raise RdbError(f"ziplist entry {head:#04x}")
            n += 1
    except IndexError as e:
        raise RdbError("cut ziplist") from e
    if at != end - 1:
        raise RdbError("bytes behind a ziplist")
    return n


def listpack_entries(data: bytes) -> int:
    at, n, end = 6, 0, len(data)
    fixed = {0xF1: 3, 0xF2: 4, 0xF3: 5, 0xF4: 9}
    try:
        while (head := data[at]) != 0xFF:
            if head < 0x80:
                size = 1
            elif head < 0xC0:
                size = 1 + (head & 63)
            elif head < 0xE0:
                size = 2
            elif head < 0xF0:
                size = 2 + ((head & 15) << 8 | data[at + 1])
            elif head == 0xF0:
                size = 5 + int.from_bytes(data[at + 1 : at + 5], "little")
            elif head in fixed:
                size = fixed[head]
            else:
                raise RdbError(f"listpack entry {head:#04x}")
            at += size + (1 if size < 128 else 2 if size < 1 << 14 else 3 if size < 1 << 21 else 4 if size < 1 << 28 else 5)
            n += 1
    except IndexError as e:
        raise RdbError("cut listpack") from e
    if at != end - 1:
        raise RdbError("bytes behind a listpack")
    return n


def intset_entries(data: bytes) -> int:
    if len(data) < 8:
        raise RdbError("cut intset")
    width, n = struct.unpack_from("<II", data)
    if width not in (2, 4, 8) or len(data) != 8 + width * n:
        raise RdbError(f"intset of width {width}")
    return n


def zipmap_entries(data: bytes) -> int:
    at, n = 1, 0

    def size(at: int) -> tuple[int, int]:
        return (int.from_bytes(data[at + 1 : at + 5], "little"), at + 5) if data[at] == 254 else (data[at], at + 1)

    try:
        while data[at] != 0xFF:
            length, at = size(at)
            length, at = size(at + length)
            at += 1 + length + data[at]
            n += 1
    except IndexError as e:
        raise RdbError("cut zipmap") from e
    if at != len(data) - 1:
        raise RdbError("bytes behind a zipmap")
    return n


def _parts(n: int, by: int, what: str) -> int:
    if n % by:
        raise RdbError(f"{what} of {n} entries")
    return n // by


# Values by type byte: each skips the value and returns its members


def _strings(r: Reader, by: int = 1) -> int:
    n = r.length()
    for _ in range(n * by):
        r.skip_string()
    return n


def _old_scores(r: Reader) -> int:
    n = r.length()
    for _ in range(n):
        r.skip_string()
        size = r.byte()
        if size < 253:  # above: not a number and the infinities
            r.skip(size)
    return n


def _scores(r: Reader) -> int:
    n = r.length()
    for _ in range(n):
        r.skip_string()
        r.skip(8)
    return n


def _quicklist2(r: Reader) -> int:
    total = 0
    for _ in range(r.length()):
        kind = r.length()
        if kind == 1:
            r.skip_string()
            total += 1
        elif kind == 2:
            total += listpack_entries(r.string())
        else:
            raise RdbError(f"quicklist node of kind {kind}")
    return total


def _timed_hash(r: Reader) -> int:
    r.skip(8)
    n = r.length()
    for _ in range(n):
        r.length()
        r.skip_string()
        r.skip_string()
    return n


def _timed_listpack(r: Reader) -> int:
    r.skip(8)
    return _parts(listpack_entries(r.string()), 3, "timed hash")


def _stream(r: Reader, version: int) -> int:
    for _ in range(r.length()):
        r.skip_string()
        r.skip_string()
    messages = r.length()
    for _ in range(2 if version == 1 else 7):
        r.length()
    for _ in range(r.length()):  # groups
        r.skip_string()
        for _ in range(2 if version == 1 else 3):
            r.length()
        for _ in range(r.length()):  # pending: id, time, deliveries
            r.skip(24)
            r.length()
        for _ in range(r.length()):  # consumers: name, times, pending ids
            r.skip_string()
            r.skip(16 if version == 3 else 8)
            r.skip(16 * r.length())
    return messages


def _module(r: Reader) -> None:
    r.length()
    while (code := r.length()) != 0:
        if code in (1, 2):
            r.length()
        elif code in (3, 4):
            r.skip(4 if code == 3 else 8)
        elif code == 5:
            r.skip_string()
        else:
            raise RdbError(f"module code {code}")


VALUES = {
    1: _strings,
    2: _strings,
    3: _old_scores,
    4: lambda r: _strings(r, 2),
    5: _scores,
    7: _module,
    9: lambda r: zipmap_entries(r.string()),
    10: lambda r: ziplist_entries(r.string()),
    11: lambda r: intset_entries(r.string()),
    12: lambda r: _parts(ziplist_entries(r.string()), 2, "sorted set"),
    13: lambda r: _parts(ziplist_entries(r.string()), 2, "hash"),
    14: lambda r: sum(ziplist_entries(r.string()) for _ in range(r.length())),
    15: lambda r: _stream(r, 1),
    16: lambda r: _parts(listpack_entries(r.string()), 2, "hash"),
    17: lambda r: _parts(listpack_entries(r.string()), 2, "sorted set"),
    18: _quicklist2,
    19: lambda r: _stream(r, 2),
    20: lambda r: listpack_entries(r.string()),
    21: lambda r: _stream(r, 3),
    24: _timed_hash,
    25: _timed_listpack,
}
_UNRELEASED = {6: "module", 22: "hash with metadata", 23: "hash listpack"}


def items(stream) -> Iterator[Record | Other]:
    """All items of one snapshot; expiry, idle time and frequency go with the key that follows them."""
    r = Reader(stream)
    head = r.read(9)
    if head[:5] != b"REDIS" or not head[5:].isdigit() or int(head[5:]) not in VERSIONS:
        raise RdbError(f"not a snapshot of a known version: {head!r}")
    version, db, count = int(head[5:]), 0, 0
    expire = idle = freq = None
    while True:
        start = r.tell()
        code = r.byte()
        if code in TYPES:
            key = r.string()
            if code == 0:
                encoding, members = r.skip_string(), 1
            else:
                encoding, members = ENCODINGS[code], VALUES[code](r)
            yield Record(db, key, TYPES[code], members, r.tell() - start, encoding, expire, idle, freq)
            expire = idle = freq = None
            count += 1
        elif code == 255:
            if version >= 5:
                r.skip(8)  # checksum
            if not r.at_end():
                raise RdbError(f"bytes behind the end at {r.tell()}")
            return
        elif code == 254:
            db = r.length()
            yield Other("select_db", db)
        elif code == 253:
            expire = min(int.from_bytes(r.read(4), "little") * 1000, MAX_EXPIRE_MS)
        elif code == 252:
            expire = min(r.u64(), MAX_EXPIRE_MS)
        elif code == 251:
            yield Other("resize_db", (r.length(), r.length()))
        elif code == 250:
            yield Other("aux", (r.string(), r.string()))
        elif code == 249:
            freq = r.byte()
        elif code == 248:
            idle = r.length()
        elif code == 247:
            _module(r)
            yield Other("module_aux")
        elif code == 245:
            r.skip_string()
            yield Other("function")
        elif code == 244:
            yield Other("slot_info", (r.length(), r.length(), r.length()))
        elif code == 246 or code in _UNRELEASED:
            raise RdbError(f"unreleased format of {_UNRELEASED.get(code, 'function')} at {start}")
        else:
            raise RdbError(f"unknown byte {code:#04x} at {start}, version {version}, after {count} keys, in database {db}")


def records(stream, on_truncate: str = "raise") -> Iterator[Record]:
    """The keys of one snapshot. A cut snapshot raises, or ends quietly with ``on_truncate="ignore"``."""
    try:
        for item in items(stream):
            if isinstance(item, Record):
                yield item
    except RdbTruncated:
        if on_truncate != "ignore":
            raise


def is_expired(record: Record, now_ms: int) -> bool:
    return record.expire_at_ms is not None and now_ms > record.expire_at_ms


def slots(source_type: str, key: bytes) -> tuple[int | None, int | None]:
    """(codis_slot, redis_slot) by where the snapshot comes from."""
    return codis_slot_of(key) if source_type == "codis" else None, redis_slot_of(key) if source_type == "cluster" else None
