import io
import random

import pytest

from keyloom.functions import slots
from keyloom.sources import lzf, rdb

from . import rdb_builder as b


class OneByte:
    """A stream that gives a byte at a time."""

    def __init__(self, data):
        self._data = io.BytesIO(data)

    def read(self, n):
        return self._data.read(min(n, 1))


def records(data, **options):
    return list(rdb.records(io.BytesIO(data), **options))


def test_empty_snapshot_has_five_auxiliary_fields():
    found = list(rdb.items(io.BytesIO(b.dump())))
    assert [i.kind for i in found] == ["aux"] * 5


@pytest.mark.parametrize("case", b.values(), ids=lambda c: c[0])
def test_every_encoding(case):
    name, code, value, kind, encoding, members = case
    body = b.key_value(code, name.encode(), value)
    for stream in (io.BytesIO(b.dump(body)), OneByte(b.dump(body)) if len(body) < 50_000 else io.BytesIO(b.dump(body))):
        (r,) = rdb.records(stream)
        assert (r.key, r.type, r.encoding, r.member_count, r.rdb_size) == (name.encode(), kind, encoding, members, len(body))


def test_all_in_one_snapshot():
    assert [(r.key.decode(), r.type, r.encoding, r.member_count) for r in records(b.full_dump())] == [(c[0], *c[3:]) for c in b.values()]


@pytest.mark.parametrize("seed", range(20))
def test_every_cut_is_noticed(seed):
    body = b"".join(b.key_value(code, n.encode(), v) for n, code, v, *_ in b.values() if len(v) < 3000)
    data = b.dump(body)
    at = random.Random(seed).randrange(9, len(data) - 1)
    with pytest.raises(rdb.RdbTruncated):
        records(data[:at])
    kept = records(data[:at], on_truncate="ignore")
    assert kept == records(data)[: len(kept)]


def test_attributes_go_with_the_next_key_alone():
    value = b.string(b"v")
    body = b"\xfc" + (1_700_000_000_123).to_bytes(8, "little") + b"\xf8" + b.length(300) + b.key_value(0, b"a", value)
    body += b"\xfd" + (1_700_000_000).to_bytes(4, "little") + b"\xf9\x05" + b.key_value(0, b"b", value) + b"\xfe\x03" + b.key_value(0, b"c", value)
    found = records(b.dump(body))
    assert [(r.db, r.expire_at_ms, r.idle_seconds, r.freq) for r in found] == [
        (0, 1_700_000_000_123, 300, None), (0, 1_700_000_000_000, None, 5), (3, None, None, None)
    ]
    assert len({r.rdb_size for r in found}) == 1  # attributes do not count
    assert rdb.is_expired(found[0], 1_700_000_000_124) and not rdb.is_expired(found[0], 1_700_000_000_123) and not rdb.is_expired(found[2], 1 << 60)


def test_expiry_saturates():
    body = b"\xfc" + b"\xff" * 8 + b.key_value(0, b"a", b.string(b""))
    assert records(b.dump(body))[0].expire_at_ms == rdb.MAX_EXPIRE_MS


@pytest.mark.parametrize(("key", "want"), [(b.integer(-7), b"-7"), (b.integer(300), b"300"), (b.integer(-70_000), b"-70000"), (b.packed_string(b"abcdefgh" * 4), b"abcdefgh" * 4), (b.string(b"\xff\x00"), b"\xff\x00")])
def test_key_forms(key, want):
    assert records(b.dump(b"\x00" + key + b.string(b"v")))[0].key == want


@pytest.mark.parametrize(
    ("data", "message"),
    [
        (b"RADIS0011", "not a snapshot"), (b"REDIS0013", "not a snapshot"), (b"REDIS00a1", "not a snapshot"),
        (b.dump(b"\x06" + b.string(b"k")), "unreleased"), (b.dump(b"\x16"), "unreleased"), (b.dump(b"\xf6"), "unreleased"),
        (b.dump(b"\x63"), "unknown byte 0x63"), (b.dump() + b"x", "behind the end"), (b.dump(b"\x00\xc7"), "length byte"),
        (b.dump(b.key_value(13, b"k", b.string(b.ziplist([b"odd"])))), "1 entries"), (b.dump(b.key_value(25, b"k", bytes(8) + b.string(b.listpack([b"a", b"b"])))), "2 entries"),
        (b.dump(b.key_value(18, b"k", b.length(1) + b.length(3))), "quicklist node"), (b.dump(b.key_value(11, b"k", b.string(b.intset([1], 2)[:-1]))), "intset"),
        (b.dump(b.key_value(20, b"k", b.string(b.listpack([1]) + b"x"))), "behind a listpack"), (b.dump(b.key_value(10, b"k", b.string(b.ziplist([1])[:-1]))), "cut ziplist"),
    ],
)
def test_damage(data, message):
    with pytest.raises(rdb.RdbError, match=message):
        records(data)


def test_lzf():
    for data in (b"", b"a", b"abcdefgh" * 40, bytes(range(256)) * 3):
        assert lzf.decompress(b.lzf(data), len(data)) == data
    assert lzf.decompress(b"\x00a\xe0\x05\x00", 15) == b"a" * 15  # a copy that feeds on itself
    for bad, size in ((b"\x05ab", 6), (b"\x20", 1), (b"\x20\x05", 3), (b"\x00a", 2)):
        with pytest.raises(lzf.LzfError):
            lzf.decompress(bad, size)


# key, codis slot, cluster slot
GOLDENS = [
    (b"foo", 289, 12182), (b"key1", 80, 9189), (b"123", 978, 5970), (b"", 0, 0), (b"a", 579, 15495), (b"user:123:profile", 875, 8490),
    (b"{user}:profile", 585, 5474), (b"{user1}:profile", 341, 8106), (b"{user1}:settings", 341, 8106), (b"{}:key", 0, 3707),
    (b"prefix:{}:suffix", 0, 4527), (b"{foo", 178, 13308), (b"foo}", 311, 15679), (b"foo{foo}", 289, 12182), (b"{user}{group}:data", 585, 5474),
    (b"app:cache:{session123}:user:456", 573, 568),
]


def test_slots(spark):
    assert [(k, slots.codis_slot_of(k), slots.redis_slot_of(k)) for k, _, _ in GOLDENS] == GOLDENS
    rnd = random.Random(1)
    odd = [bytes(rnd.choice(b"{}ab\xff\x00\xc3") for _ in range(rnd.randint(0, 9))) for _ in range(300)]
    frame = spark.createDataFrame([(bytearray(k),) for k in odd + [g[0] for g in GOLDENS]], "key binary")
    found = frame.select("key", slots.codis_slot(frame["key"]).alias("c"), slots.redis_slot(frame["key"]).alias("r")).collect()
    for r in found:
        key = bytes(r["key"])
        assert (r["c"], r["r"]) == (slots.codis_slot_of(key), slots.redis_slot_of(key)), key


def test_slots_by_source():
    assert rdb.slots("codis", b"foo") == (289, None) and rdb.slots("cluster", b"foo") == (None, 12182)
    assert rdb.slots("file", b"foo") == rdb.slots("standalone", b"foo") == (None, None)
