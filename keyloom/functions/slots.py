"""Hash slots of keys, as column expressions over binary keys and as plain functions."""

from __future__ import annotations

import binascii
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

CODIS_SLOTS, REDIS_SLOTS = 1024, 16384


def tag_of(key: bytes, empty_counts: bool) -> bytes:
    """What is between the first ``{`` and the next ``}``; the key itself without such a pair.

    An empty pair counts as an empty tag only if ``empty_counts``.
    """
    open_ = key.find(b"{")
    close = key.find(b"}", open_ + 1) if open_ >= 0 else -1
    if close < 0 or (close == open_ + 1 and not empty_counts):
        return key
    return key[open_ + 1 : close]


def codis_slot_of(key: bytes) -> int:
    return zlib.crc32(tag_of(key, True)) % CODIS_SLOTS


def redis_slot_of(key: bytes) -> int:
    return binascii.crc_hqx(tag_of(key, False), 0) % REDIS_SLOTS


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _tag(key: Column, empty_counts: bool) -> Column:
    # Byte positions: hex has two characters a byte, so a match counts only at odd places.
    positions = F.sequence(F.lit(1), F.greatest(F.length(key), F.lit(1)))
    is_byte = lambda code: lambda i: F.substring(key, i, F.lit(1)) == F.lit(code)

    def between(open_: Column) -> Column:
        close = F.coalesce(F.get(F.filter(F.filter(positions, is_byte(b"}")), lambda i: i > open_), 0), F.lit(0))
        return _bound(close, lambda c: F.when((open_ > 0) & (c > open_ + (0 if empty_counts else 1)), F.substring(key, open_ + 1, c - open_ - 1)).otherwise(key))

    return _bound(F.coalesce(F.get(F.filter(positions, is_byte(b"{")), 0), F.lit(0)), between)


def hash_tag(key: Column, empty_counts: bool = False) -> Column:
    """The hash tag of a binary key; keys without a brace skip the search."""
    return F.when(F.contains(key, F.lit(b"{")), _tag(key, empty_counts)).otherwise(key)


def codis_slot(key: Column) -> Column:
    return (F.crc32(hash_tag(key, True)) % CODIS_SLOTS).cast("int")


def _crc16_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x1021 if crc & 0x8000 else crc << 1) & 0xFFFF
        table.append(crc)
    return table


def redis_slot(key: Column) -> Column:
    """CRC-16 (polynomial 0x1021) of the hash tag, a byte at a time over a table, all in the JVM.

    The tag is cut out once: its bytes are bound as an array of hexadecimal pairs.
    """
    table = F.array(*[F.lit(x) for x in _crc16_table()])
    pairs = F.regexp_extract_all(F.hex(hash_tag(key, False)), F.lit("(..)"))
    zero = F.struct(F.lit(0).alias("crc"), table.alias("table"))

    def step(acc: Column, pair: Column) -> Column:
        byte = F.conv(pair, 16, 10).cast("int")
        index = F.shiftright(acc["crc"], 8).bitwiseXOR(byte).bitwiseAND(255) + 1
        return F.struct(F.shiftleft(acc["crc"], 8).bitwiseAND(0xFFFF).bitwiseXOR(F.element_at(acc["table"], index)).alias("crc"), acc["table"].alias("table"))

    return (F.aggregate(pairs, zero, step)["crc"] % REDIS_SLOTS).cast("int")
