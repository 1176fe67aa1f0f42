"""Snapshots of every encoding, written from the public format."""

import struct

from keyloom.sources.rdb_writer import length, string

__all__ = ["dump", "length", "string"]


def integer(n):
    for code, (kind, low, high) in enumerate((("<b", -128, 127), ("<h", -(1 << 15), (1 << 15) - 1), ("<i", -(1 << 31), (1 << 31) - 1))):
        if low <= n <= high:
            return bytes([0xC0 | code]) + struct.pack(kind, n)
    raise ValueError(n)


def lzf(data):
    """Literals, with a back reference where the last eight bytes come again."""
    out, at = bytearray(), 0
    while at < len(data):
        if at >= 8 and data[at : at + 8] == data[at - 8 : at] and at + 8 <= len(data):
            out += bytes([(8 - 2) << 5 | 0, 7]) if 8 - 2 < 7 else b""
            at += 8
            continue
        run = data[at : at + (32 if at >= 8 else 8)]
        end = next((k for k in range(1, len(run)) if at + k >= 8 and data[at + k : at + k + 8] == data[at + k - 8 : at + k] and at + k + 8 <= len(data)), len(run))
        run = run[:end]
        out += bytes([len(run) - 1]) + run
        at += len(run)
    return bytes(out)


def packed_string(data):
    body = lzf(data)
    return b"\xc3" + length(len(body)) + length(len(data)) + body


def ziplist_entry(value, before):
    head = bytes([before]) if before < 254 else b"\xfe" + struct.pack("<I", before)
    if isinstance(value, bytes):
        n = len(value)
        if n < 64:
            return head + bytes([n]) + value
        if n < 1 << 14:
            return head + bytes([0x40 | n >> 8, n & 255]) + value
        return head + b"\x80" + struct.pack(">I", n) + value
    if 0 <= value <= 12:
        return head + bytes([0xF1 + value])
    for code, kind, bits in ((0xFE, "<b", 8), (0xC0, "<h", 16), (0xF0, None, 24), (0xD0, "<i", 32), (0xE0, "<q", 64)):
        if -(1 << bits - 1) <= value < 1 << bits - 1:
            return head + bytes([code]) + (struct.pack(kind, value) if kind else value.to_bytes(3, "little", signed=True))
    raise ValueError(value)


def ziplist(values):
    body, before = b"", 0
    for v in values:
        entry = ziplist_entry(v, before)
        body += entry
        before = len(entry)
    return struct.pack("<IIH", 11 + len(body), 10, len(values)) + body + b"\xff"


def listpack_entry(value):
    if isinstance(value, bytes):
        n = len(value)
        body = bytes([0x80 | n]) if n < 64 else bytes([0xE0 | n >> 8, n & 255]) if n < 4096 else b"\xf0" + struct.pack("<I", n)
        body += value
    elif 0 <= value < 128:
        body = bytes([value])
    elif -4096 <= value < 4096:
        body = bytes([0xC0 | (value & 0x1FFF) >> 8, value & 255])
    else:
        for code, size in ((0xF1, 2), (0xF2, 3), (0xF3, 4), (0xF4, 8)):
            if -(1 << 8 * size - 1) <= value < 1 << 8 * size - 1:
                body = bytes([code]) + value.to_bytes(size, "little", signed=True)
                break
    n = len(body)
    return body + bytes(1 if n < 128 else 2 if n < 1 << 14 else 3 if n < 1 << 21 else 4)


def listpack(values):
    body = b"".join(map(listpack_entry, values))
    return struct.pack("<IH", 7 + len(body), len(values)) + body + b"\xff"


def intset(values, width):
    return struct.pack("<II", width, len(values)) + b"".join(v.to_bytes(width, "little", signed=True) for v in values)


def zipmap(pairs):
    size = lambda n: bytes([n]) if n < 254 else b"\xfe" + struct.pack("<I", n)
    return bytes([min(len(pairs), 254)]) + b"".join(size(len(k)) + k + size(len(v)) + b"\x02" + v + b"??" for k, v in pairs) + b"\xff"


def many(items):
    return length(len(items)) + b"".join(items)


def stream(version):
    ident = bytes(16)
    out = many([string(ident) + string(listpack([1, 0, b"f"])), string(ident) + string(listpack([2]))])
    out += length(7) + b"".join(length(300) for _ in range(2 if version == 1 else 7))
    pending = ident + bytes(8) + length(3)
    consumer = string(b"c1") + bytes(16 if version == 3 else 8) + many([ident])
    group = string(b"g1") + b"".join(length(1) for _ in range(2 if version == 1 else 3)) + many([pending]) + many([consumer])
    return out + many([group, group])


def module():
    return length(1 << 40) + b"".join(
        [length(1) + length(5), length(2) + length(7), length(3) + bytes(4), length(4) + bytes(8), length(5) + string(b"data"), length(0)]
    )


def values():
    """(name, type byte, value, type, encoding, members)."""
    strings = [string(b"%d" % i * 5) for i in range(20)]
    mixed = [b"a", 5, -1, 100, -30_000, 1 << 20, -(1 << 30), 1 << 40, b"x" * 100, b"y" * 20_000]
    pair = [b"f", 1, b"g" * 70, -(1 << 40)]
    long_list = string(listpack(mixed))
    return [
        ("raw_key", 0, string(b"v" * 100), "string", "raw", 1),
        ("big_raw", 0, string(b"v" * 200_000), "string", "raw", 1),
        ("int_key", 0, integer(-1234), "string", "int", 1),
        ("lzf_key", 0, packed_string(b"abcdefgh" * 50), "string", "lzf", 1),
        ("list_key", 1, many(strings), "list", "list", 20),
        ("set_key", 2, many(strings), "set", "raw", 20),
        ("zset_key", 3, many([string(b"m") + b"\x031.5", string(b"n") + b"\xfd", string(b"o") + b"\xfe", string(b"p") + b"\xff"]), "zset", "skip_list", 4),
        ("hash_key", 4, length(10) + b"".join(strings), "hash", "raw", 10),
        ("zset2_key", 5, many([string(b"m%d" % i) + bytes(8) for i in range(3)]), "zset", "skip_list", 3),
        ("module_key", 7, module(), "module", "module", None),
        ("zipmap_key", 9, string(zipmap([(b"a", b"1"), (b"b" * 300, b"2" * 253), (b"c", b"")])), "hash", "zip_map", 3),
        ("zipmap_lzf", 9, packed_string(zipmap([(b"abcdefgh" * 9, b"v"), (b"k", b"w")])), "hash", "zip_map", 2),
        ("zl_key", 10, string(ziplist(mixed + [b"after a long one"])), "list", "zip_list", 11),
        ("intset2", 11, string(intset([-5, 7], 2)), "set", "int_set", 2),
        ("intset4", 11, string(intset([-5, 7, 1 << 20], 4)), "set", "int_set", 3),
        ("intset8", 11, string(intset([1 << 50], 8)), "set", "int_set", 1),
        ("zsl_zl_key", 12, string(ziplist(pair)), "zset", "zip_list", 2),
        ("hm_zl_key", 13, packed_string(ziplist([b"abcdefgh" * 10, 1])), "hash", "zip_list", 1),
        ("ql_key", 14, many([string(ziplist(mixed)), packed_string(ziplist([b"abcdefgh" * 20, b"z"]))]), "list", "quick_list", 12),
        ("stream1", 15, stream(1), "stream", "list_packs", 7),
        ("hm_lp_key", 16, string(listpack(pair)), "hash", "list_pack", 2),
        ("zsl_lp_key", 17, string(listpack(pair)), "zset", "list_pack", 2),
        ("ql2_key", 18, many([length(2) + long_list, length(1) + string(b"plain" * 5000)]), "list", "quick_list2", 11),
        ("stream2", 19, stream(2), "stream", "list_packs2", 7),
        ("lp_key", 20, long_list, "set", "list_pack", 10),
        ("stream3", 21, stream(3), "stream", "list_packs3", 7),
        ("hm_meta_key", 24, bytes(8) + many([length(9) + string(b"f") + string(b"v")] * 4), "hash", "metadata", 4),
        ("hm_lpe_key", 25, bytes(8) + string(listpack([b"f", b"v", 0] * 3)), "hash", "list_pack_ex", 3),
    ]


def key_value(code, key, value):
    return bytes([code]) + string(key) + value


def dump(body=b"", version=11):
    aux = b"".join(b"\xfa" + string(k) + string(v) for k, v in ((b"redis-ver", b"7.2.0"), (b"redis-bits", b"64"), (b"ctime", b"1"), (b"used-mem", b"2"), (b"aof-base", b"0")))
    return b"REDIS%04d" % version + aux + body + b"\xff" + bytes(8)


def full_dump():
    body = b"\xfe\x00\xfb" + length(30) + length(2) + b"\xf4" + length(1) + length(2) + length(3)
    body += b"\xf5" + string(b"#!lua name=f") + b"\xf7" + module()
    return dump(body + b"".join(key_value(code, name.encode(), value) for name, code, value, *_ in values()))
