"""Snapshots of keys in their plain encodings, for fixtures and round trips."""

from __future__ import annotations

import struct
from collections.abc import Iterable
from typing import BinaryIO

#: Type bytes of the plain encodings (fixed values).
STRING, LIST, SET, HASH, ZSET = 0, 1, 2, 4, 5
VERSION = 11


def length(n: int) -> bytes:
    if n < 64:
        return bytes([n])
    if n < 1 << 14:
        return bytes([0x40 | n >> 8, n & 255])
    if n < 1 << 32:
        return b"\x80" + n.to_bytes(4, "big")
    return b"\x81" + n.to_bytes(8, "big")


def string(data: bytes) -> bytes:
    return length(len(data)) + data


def entry(kind: int, key: bytes, value) -> bytes:
    """One key: a string's bytes, a list's or set's members, a hash's pairs, or a sorted set's (member, score) pairs."""
    head = bytes([kind]) + string(key)
    if kind == STRING:
        return head + string(value)
    if kind in (LIST, SET):
        return head + length(len(value)) + b"".join(map(string, value))
    if kind == HASH:
        return head + length(len(value)) + b"".join(string(f) + string(v) for f, v in value)
    return head + length(len(value)) + b"".join(string(m) + struct.pack("<d", score) for m, score in value)


def snapshot(out: BinaryIO, entries: Iterable[bytes], version: int = VERSION, db: int = 0) -> None:
    out.write(b"REDIS%04d" % version)
    out.write(b"\xfe" + length(db))
    for each in entries:
        out.write(each)
    out.write(b"\xff" + bytes(8))


def string_snapshot(out: BinaryIO, keys: Iterable[tuple[bytes, bytes]], version: int = VERSION) -> None:
    snapshot(out, (entry(STRING, k, v) for k, v in keys), version)
