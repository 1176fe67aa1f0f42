import hashlib
import os
import struct
import zlib

import pytest

from keyloom.llm import ogg


def bitwise_checksum(data):
    r = 0
    for x in data:
        r ^= x << 24
        for _ in range(8):
            r = (r << 1 ^ 0x04C11DB7 if r >> 31 else r << 1) & 0xFFFFFFFF
    return r


def test_checksum_against_bitwise():
    for n in (0, 1, 27, 400):
        data = os.urandom(n)
        assert ogg.page_checksum(data) == bitwise_checksum(data)


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 38_400, 200_001])
def test_round_trip(n):
    payload = ogg.pad(os.urandom(n))
    back = ogg.load(ogg.store(payload))
    assert back.payload == payload
    assert back.seconds == len(payload) / ogg.RATE
    assert back.packets == len(payload) // ogg.FRAME


def test_pages_span_packets_and_interleave():
    pages = ogg.read_pages(ogg.store(ogg.pad(os.urandom(300_000))))
    assert any(p.flags & ogg.CONTINUED for p in pages)
    assert {p.serial for p in pages} == {1, 2}
    body = [p.serial for p in pages[2:]]
    assert body != sorted(body)
    for serial in (1, 2):
        granules = [p.granule for p in pages if p.serial == serial and p.granule >= 0]
        assert granules == sorted(granules)


def test_foreign_file_by_lacing_and_granules():
    """A stream written by hand: an empty packet, one of exactly 255 bytes, one over three pages."""
    first, exact, long_ = b"head", b"e" * 255, b"L" * 1000
    pages = [
        ogg.write_page(ogg.FIRST, 0, 9, 0, bytes([4]), first),
        ogg.write_page(0, 100, 9, 1, bytes([0, 255, 0, 255]), exact + long_[:255]),
        ogg.write_page(ogg.CONTINUED, -1, 9, 2, bytes([255]), long_[255:510]),
        ogg.write_page(ogg.CONTINUED | ogg.LAST, 400, 9, 3, bytes([255, 235]), long_[510:]),
    ]
    (packets,) = ogg.demultiplex(ogg.read_pages(b"".join(pages))).values()
    assert [p.data for p in packets] == [first, b"", exact, long_]
    assert [p.granule for p in packets] == [0, None, 100, 400]
    assert ogg.packet_times(packets[1:], [50, 50, 300], 100) == [0.5, 1.0, 4.0]


@pytest.mark.parametrize("damage", ["flip", "cut", "drop", "swap"])
def test_damage_is_found(damage):
    data = ogg.store(ogg.pad(os.urandom(120_000)))
    pages = ogg.read_pages(data)
    raw, at = [], 0
    for p in pages:
        size = 27 + len(p.lacing) + len(p.body)
        raw.append(data[at : at + size])
        at += size
    if damage == "flip":
        bad = data[:2000] + bytes([data[2000] ^ 1]) + data[2001:]
    elif damage == "cut":
        bad = data[:-5]
    elif damage == "drop":
        bad = b"".join(raw[:3] + raw[4:])
    else:
        bad = b"".join([*raw[:2], raw[4], raw[3], raw[2], *raw[5:]])
    with pytest.raises(ogg.OggError):
        ogg.load(bad)


def test_query_against_plain_values(docs, no_docs, clashing):
    want = {}
    for r in docs.select("doc_id", "text").collect():
        raw = (r["text"] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.setdefault(r["doc_id"], []).append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    rows = ogg.media_column(docs).collect()
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], []).append((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]))
        assert f"packets={r['payload_bytes'] // 576};" in r["feature"]
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    by_payload = {}
    for r in rows:
        assert by_payload.setdefault((r["payload_sha256"], r["n_bytes"]), tuple(r)[1:]) == tuple(r)[1:]
    assert ogg.media_column(no_docs).collect() == []
    assert ogg.media_column(clashing).first()["n_bytes"] == 16


def test_struct_sizes():
    assert ogg._HEAD.size == 27 and struct.calcsize("<8sIHHQ") == ogg._IDENT.size


def test_column_of_files(spark):
    good = ogg.store(ogg.pad(b"x" * 5000))
    rows = [(1, bytearray(good)), (2, bytearray(good[:-1])), (3, None), (4, bytearray(b""))]
    found = {r["doc_id"]: r for r in ogg.inspect_column(spark.createDataFrame(rows, "doc_id long, data binary")).collect()}
    assert found[1]["ok"] and [(s["serial"], s["packets"], s["last_granule"]) for s in found[1]["streams"]] == [(1, 6, 5184), (2, 5, 4608)]
    assert not found[2]["ok"] and "cut page" in found[2]["error"]
    assert not found[3]["ok"] and found[3]["error"] == "no data"
    assert found[4]["ok"] and found[4]["streams"] == []
