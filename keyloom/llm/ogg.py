"""Ogg media columns: page checksums, packets from lacing values, logical streams, timestamps from granule positions.

The page layout, flags and checksum are those of RFC 3533. The checksum is the unreflected CRC-32; it equals the
reflected one that zlib has over bit-reversed bytes, so no byte is handled in Python.

``store`` puts a payload into two logical streams of 8-bit samples: packets of ``FRAME`` samples are dealt to them in
turn, pages interleave by time, and pages may end inside a packet. ``load`` reads the stored bytes alone. Equal
payloads give equal bytes: stream serials are fixed and nothing depends on the clock.

Null and empty texts are stored as one frame of padding. Repeated rows give equal rows, an empty table none; a text of any
length is stored whole, and held once as payload and once as file. There are no ties. Columns beside the two that are read do
not matter, also where their names differ from these only in case.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.session import pick

from .common import map_texts

FRAME, RATE, STREAMS, PAGE_SEGMENTS = 576, 8000, 2, 200
MAGIC = b"PCM8mono"
_HEAD = struct.Struct("<4sBBqIIIB")
_IDENT = struct.Struct("<8sIHHQ")
CONTINUED, FIRST, LAST = 1, 2, 4
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """The bytes are not a whole and sound Ogg file."""


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, unreflected, zero start, over a page whose checksum field is zero."""
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


def write_page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    page = head + lacing + body
    return page[:22] + struct.pack("<I", page_checksum(page)) + page[26:]


class Page(NamedTuple):
    flags: int
    granule: int
    serial: int
    number: int
    lacing: bytes
    body: bytes


def read_pages(data: bytes) -> list[Page]:
    """All pages, each with its checksum verified."""
    pages, at = [], 0
    while at < len(data):
        if len(data) - at < _HEAD.size:
            raise OggError(f"cut page header at {at}")
        magic, version, flags, granule, serial, number, checksum, n = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at {at}")
        lacing = data[at + _HEAD.size : at + _HEAD.size + n]
        end = at + _HEAD.size + n + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError(f"cut page at {at}")
        page = data[at:end]
        if page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != checksum:
            raise OggError(f"page at {at} fails its checksum")
        pages.append(Page(flags, granule, serial, number, lacing, page[_HEAD.size + n :]))
        at = end
    return pages


class Packet(NamedTuple):
    """``granule`` is the page's position if this is the last packet that ends on its page, else None."""

    data: bytes
    granule: int | None


def packets_of(pages: list[Page]) -> list[Packet]:
    """The packets of one logical stream, put together from lacing values across pages."""
    packets: list[Packet] = []
    open_: list[bytes] = []
    pending = False
    for i, page in enumerate(pages):
        if page.number != i:
            raise OggError(f"stream {page.serial}: page {i} is missing")
        if bool(page.flags & CONTINUED) != pending:
            raise OggError(f"stream {page.serial}: page {i} does not go on where the last one ended")
        if bool(page.flags & FIRST) != (i == 0) or bool(page.flags & LAST) != (i == len(pages) - 1):
            raise OggError(f"stream {page.serial}: wrong bounds at page {i}")
        before, start, end = len(packets), 0, 0
        for size in page.lacing:
            end += size
            if size < 255:
                packets.append(Packet(b"".join([*open_, page.body[start:end]]), None))
                open_, start = [], end
        if start < end:
            open_.append(page.body[start:end])
        pending = bool(page.lacing) and page.lacing[-1] == 255
        if (len(packets) > before) != (page.granule >= 0):
            raise OggError(f"stream {page.serial}: granule position of page {i}")
        if len(packets) > before:
            packets[-1] = packets[-1]._replace(granule=page.granule)
    if pending:
        raise OggError("last packet has no end")
    return packets


def demultiplex(pages: list[Page]) -> dict[int, list[Packet]]:
    """Packets by logical stream, in order of the streams' first pages."""
    streams: dict[int, list[Page]] = {}
    for page in pages:
        streams.setdefault(page.serial, []).append(page)
    return {serial: packets_of(own) for serial, own in streams.items()}


def packet_times(packets: list[Packet], durations: list[int], rate: int, stride: int | None = None) -> list[float]:
    """End time in seconds of each packet.

    A granule position dates the last packet that ends on a page; the others are dated back from it, by ``stride``
    samples each, or by the durations of the packets behind them.
    """
    times, end = [0.0] * len(packets), None
    for i in reversed(range(len(packets))):
        if packets[i].granule is not None:
            end = packets[i].granule
        if end is None:
            raise OggError("packets without a granule position")
        times[i] = end / rate
        end -= stride or durations[i]
    return times


def store(payload: bytes, frame: int = FRAME) -> bytes:
    """The payload, a positive multiple of ``frame`` bytes, as an Ogg file."""
    n = len(payload) // frame
    if not n or len(payload) % frame:
        raise ValueError("the payload is no positive multiple of the frame")
    frames = np.frombuffer(payload, np.uint8).reshape(n, frame)
    sizes = b"\xff" * (frame // 255) + bytes([frame % 255])
    heads, pages = [], []
    for s in range(STREAMS):
        serial, own = s + 1, frames[s::STREAMS]
        data, lacing = own.tobytes(), sizes * len(own)
        ident = _IDENT.pack(MAGIC, RATE, frame, s, n)
        heads.append(write_page(FIRST | (0 if len(own) else LAST), 0, serial, 0, bytes([len(ident)]), ident))
        at = 0
        for number, k in enumerate(range(0, len(lacing), PAGE_SEGMENTS), 1):
            part = lacing[k : k + PAGE_SEGMENTS]
            size = sum(part)
            ended = (k + len(part)) // len(sizes)  # packets that have ended by the end of this page
            here = ended > k // len(sizes)
            granule = ((ended - 1) * STREAMS + s + 1) * frame if here else -1
            flags = (CONTINUED if k % len(sizes) else 0) | (LAST if k + len(part) == len(lacing) else 0)
            pages.append((k, s, write_page(flags, granule, serial, number, part, data[at : at + size])))
            at += size
    return b"".join(heads) + b"".join(p for _, _, p in sorted(pages, key=lambda p: p[:2]))


class Media(NamedTuple):
    payload: bytes
    rate: int
    pages: int
    packets: int
    seconds: float


def load(data: bytes) -> Media:
    """The payload of a stored file: streams are parted, and packets ordered by their times."""
    timed: list[tuple[float, bytes]] = []
    pages = read_pages(data)
    total = rate = 0
    for packets in demultiplex(pages).values():
        magic, rate, frame, _, total = _IDENT.unpack(packets[0].data)
        if magic != MAGIC:
            raise OggError("unknown stream")
        body = packets[1:]
        if any(len(p.data) != frame for p in body):
            raise OggError("a packet is not a frame")
        timed += zip(packet_times(body, [frame] * len(body), rate, frame * STREAMS), (p.data for p in body))
    timed.sort(key=lambda x: x[0])
    if len(timed) != total:
        raise OggError("packets are missing")
    return Media(b"".join(d for _, d in timed), rate, len(pages), len(timed), timed[-1][0] if timed else 0.0)


_REPORT = (
    "ok boolean, error string, pages long, streams array<struct<serial:long,pages:long,packets:long,payload_bytes:long,last_granule:long>>"
)


def inspect(data: bytes | None) -> tuple:
    """(ok, error, pages, streams) of any Ogg file; a damaged or missing one has an error and no streams."""
    if data is None:
        return False, "no data", 0, []
    try:
        pages = read_pages(data)
        streams = []
        for serial, packets in demultiplex(pages).items():
            own = [p for p in pages if p.serial == serial]
            last = max((p.granule for p in own), default=-1)
            streams.append({"serial": serial, "pages": len(own), "packets": len(packets), "payload_bytes": sum(len(p.data) for p in packets), "last_granule": last})
        return True, None, len(pages), streams
    except OggError as e:
        return False, str(e), 0, []


def inspect_column(media: DataFrame, id_col: str = "doc_id", data_col: str = "data") -> DataFrame:
    """(doc_id, ok, error, pages, streams) of a binary column of Ogg files: one row per row, null data included."""
    marked = pick(media, doc_id=id_col, text=data_col)
    whole = marked.select(F.struct("doc_id", F.col("text").isNull().alias("none")).alias("doc_id"), "text")
    found = map_texts(whole, _REPORT, lambda batch: [list(c) for c in zip(*map(inspect, batch))])
    missing = F.col("doc_id.none")
    return found.select(
        "doc_id.doc_id", (F.col("ok") & ~missing).alias("ok"), F.when(missing, "no data").otherwise(F.col("error")).alias("error"), "pages", "streams"
    )


def signal_features(media: Media) -> str:
    """Whole-number statistics of the samples, so that equal texts give equal strings on any machine."""
    samples = np.frombuffer(media.payload, np.uint8).astype(np.int64)
    levels = np.bincount(samples, minlength=256)
    centred = samples - 128
    crossings = int(np.count_nonzero((centred[1:] >= 0) != (centred[:-1] >= 0)))
    steps = int(np.abs(np.diff(samples)).sum())
    return (
        f"ms={round(media.seconds * 1000)};packets={media.packets};sum={int(samples.sum())};energy={int((centred * centred).sum())};"
        f"crossings={crossings};steps={steps};min={int(samples.min())};max={int(samples.max())};levels={int((levels > 0).sum())}"
    )


def pad(text: bytes, frame: int = FRAME) -> bytes:
    return text + b"\xff" * ((-len(text)) % frame or (0 if text else frame))


def media_column(docs: DataFrame, **cols: str) -> DataFrame:
    """Each text stored as Ogg and read back: one row per document, null texts as empty ones."""

    def rows(batch: list[bytes]) -> list[list]:
        out: list[list] = [[] for _ in range(7)]
        for text in batch:
            data = store(pad(text))
            back = load(data)
            row = (
                len(text),
                len(back.payload),
                hashlib.sha256(back.payload).hexdigest(),
                zlib.crc32(back.payload[-32:]),
                len(data),
                hashlib.sha256(data).hexdigest(),
                signal_features(back),
            )
            for column, value in zip(out, row):
                column.append(value)
        return out

    schema = (
        "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
    return map_texts(docs, schema, rows, **cols)
