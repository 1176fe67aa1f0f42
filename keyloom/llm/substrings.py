"""Removal of repeated passages: Rabin-Karp hashes of every window of ``width`` words, counted in Spark.

A window's hash is the polynomial in its words' 64-bit hashes, modulo 2^64; prefix sums give all of a text's at once.
There are two rounds of counting:

* In the first, every window's hash is counted, cut to ``SHORT`` bits behind those that choose its route. It finds all repeated
  windows, and a few that only share a short hash.
* In the second, the windows found are counted by 128 bits: the whole hash and another one with its own base and word hashes.
  What occurs once there is no repeated window after all, and stays.

Readers gather windows into slabs and combine them there: a hash that occurs twice in a slab is settled, so its windows are
marked at once and it is sent on one time only, and not again from the reader's later slabs. A window that a third of all
texts share thus reaches its counter once a reader, not once a text. The rest travels in packed blocks, one a slab and route;
a window takes its hash and two bytes for its place in the slab. A slab's directory, from places to texts, travels beside them.
There are ``ROUTES`` routes or, beyond some billions of windows, as many as keep a counter's blocks small, with slabs that grow
alike. A counter looks at a route in parts of ``COUNTED`` hashes. Marked places go back to their slab, and from there to their
texts. Texts move once, compressed, to what was marked in them. A text's places merge into maximal intervals of removed words.

Documents are matched to places by two hashes of doc_id and text: equal rows have equal results, so repeated rows and null
ids need no row number, and equal sets of places are kept once. Null and empty texts have no words and lose none; an empty
table gives no rows; texts of any length are counted in segments. Windows are judged on the input. Columns beside the two that
are read do not matter, also where their names differ from these only in case.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keyloom.session import ship

from .common import SLICE, release, released, texts

WIDTH = 35
#: Windows combined by a reader, hashes that a counter looks at together, and repeated hashes that a reader remembers.
SLAB, COUNTED, KNOWN = 400_000, 1_000_000, 1_000_000
#: Least and largest number of routes as powers of two, the windows of a route at which there are more, and windows of a block.
ROUTE_BITS, MOST_ROUTE_BITS, ROUTE_WINDOWS, BLOCK_WINDOWS = 8, 16, 16_000_000, 100
#: Bits of a hash in the first round, besides those of the route.
SHORT = 40
_SEGMENT = 1 << 16
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS.get(base, ((),))[0]) < n:
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(1 << n.bit_length(), b, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        _POWERS[base] = made[0], made[1]
    return _POWERS[base]


def window_hashes(words: list[bytes], width: int = WIDTH, which: int = 0) -> np.ndarray:
    """The hash of the window that starts at each word, in order; ``which`` chooses one of two independent ones."""
    import xxhash

    n = len(words)
    if n < width:
        return np.empty(0, np.uint64)
    values = np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(which)), np.uint64, n)
    up, down = _powers(_BASES[which], n + width)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * down[:n], out=sums[1:])
    return (sums[width:] - sums[:-width]) * up[width - 1 : n]


class Round(NamedTuple):
    """What readers and counters of one round have to agree on."""

    route_bits: int
    slab: int
    wide: bool
    mask: int  # bits of the first hash that count; all but in tests

    def cut(self, hashes: np.ndarray) -> np.ndarray:
        """Hashes with the bits that are looked at in this round, on top."""
        dropped = 0 if self.wide else 64 - self.route_bits - SHORT
        return ((hashes & np.uint64(self.mask)) >> np.uint64(dropped)) << np.uint64(dropped)

    def pack(self, first: np.ndarray, second: np.ndarray) -> bytes:
        if self.wide:
            return first.astype("<u8").tobytes() + second.astype("<u8").tobytes()
        short = (first >> np.uint64(64 - self.route_bits - SHORT)) & np.uint64((1 << SHORT) - 1)
        return short.astype("<u4").tobytes() + (short >> np.uint64(32)).astype(np.uint8).tobytes()

    def unpack(self, data: bytes, n: int, at: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(first, second, end); the route's bits, equal for all, are left out."""
        if self.wide:
            return np.frombuffer(data, "<u8", n, at), np.frombuffer(data, "<u8", n, at + 8 * n), at + 16 * n
        low, high = np.frombuffer(data, "<u4", n, at), np.frombuffer(data, np.uint8, n, at + 4 * n)
        first = (low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))) << np.uint64(64 - self.route_bits - SHORT)
        return first, np.zeros(n, np.uint64), at + 5 * n


def _ranked(first: np.ndarray, second: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether a new hash begins there)."""
    order = np.lexsort((second, first)) if wide else np.argsort(first, kind="stable")
    a = first[order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    if wide:
        b = second[order]
        new[1:] |= b[1:] != b[:-1]
    return order, new


def _pack_places(places: np.ndarray, segments: int) -> bytes:
    """Sorted places in a slab: how many lie in each segment, and their 16-bit offsets there."""
    counts = np.diff(np.searchsorted(places, np.arange(segments + 1) * _SEGMENT))
    return np.array([segments, *counts], "<u4").tobytes() + (places % _SEGMENT).astype("<u2").tobytes()


def _unpack_places(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    segments = int(np.frombuffer(data, "<u4", 1, at)[0])
    counts = np.frombuffer(data, "<u4", segments, at + 4)
    n, at = int(counts.sum()), at + 4 + 4 * segments
    return np.frombuffer(data, "<u2", n, at).astype(np.int64) + np.repeat(np.arange(segments) * _SEGMENT, counts), at + 2 * n


class Slab:
    """Windows of some documents, combined before they are sent."""

    def __init__(self, round_: Round, task: int):
        self.round, self.number = round_, task << 32
        self.known = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.clear()

    def clear(self) -> None:
        self.entries, self.first, self.second, self.places, self.size = [], [], [], [], 0

    def add(self, key: tuple[int, int], base: int, count: int, places: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        """A segment of a document: ``count`` windows from ``base`` on, of which those at ``places`` are looked at."""
        self.entries.append((*key, base, count))
        self.places.append(places + self.size)
        self.first.append(self.round.cut(first))
        self.second.append(second)
        self.size += count

    def _is_known(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        known, partner = self.known
        if not len(known):
            return np.zeros(len(first), bool)
        at = np.minimum(np.searchsorted(known, first), len(known) - 1)
        return (known[at] == first) & (partner[at] == second)

    def rows(self) -> Iterator[tuple[int, int, bytes]]:
        """(route, slab, data): a block a route, and under a negative route the directory with the places settled here."""
        if not self.entries:
            return
        first, second, places = (np.concatenate(x) for x in (self.first, self.second, self.places))
        segments = -(-self.size // _SEGMENT)
        order, new = _ranked(first, second, self.round.wide)
        # What this reader has sent as repeated before need not go again, and is repeated wherever it turns up.
        a, b = first[order], second[order]
        is_known = self._is_known(a, b)
        single = new & np.append(new[1:], True) & ~is_known
        settled = np.ones(len(first), bool)
        settled[order[single]] = False
        multiple = new & ~single & ~is_known
        sent, sent_partner = a[multiple], b[multiple]
        keep = len(self.known[0]) < KNOWN
        at = np.searchsorted(self.known[0], sent) if keep else None
        self.known = (np.insert(self.known[0], at, sent), np.insert(self.known[1], at, sent_partner)) if keep else (sent, sent_partner)
        # By route; within a route, windows stand in text order.
        shift, routes = np.uint64(64 - self.round.route_bits), np.arange((1 << self.round.route_bits) + 1, dtype=np.uint64)
        alone = np.flatnonzero(~settled)
        own = first[alone] >> shift
        by_route = np.argsort(own, kind="stable")
        alone = alone[by_route]
        cuts = np.searchsorted(own[by_route], routes).tolist()
        sent_cuts = np.searchsorted(sent >> shift, routes).tolist()
        for r in range(len(routes) - 1):
            some, many = alone[cuts[r] : cuts[r + 1]], slice(sent_cuts[r], sent_cuts[r + 1])
            if len(some) or many.stop > many.start:
                head = np.array([many.stop - many.start], "<u4").tobytes() + _pack_places(places[some], segments)
                yield r, self.number, head + self.round.pack(first[some], second[some]) + self.round.pack(sent[many], sent_partner[many])
        entries = np.array(self.entries, dtype=np.int64)
        marked = places[settled]
        yield -1 - self.number % (1 << 20), self.number, np.array([len(entries)], "<i8").tobytes() + entries.astype("<i8").tobytes() + _pack_places(marked, segments)
        self.number += 1


def _count_route(blocks: list[tuple[int, bytes]], round_: Round) -> Iterator[tuple[int, bytes]]:
    """(slab, places) of a route's windows that are repeated, or in the wide round that are not."""
    heads = []
    for _, data in blocks:
        places, at = _unpack_places(data, 4)
        heads.append((int(np.frombuffer(data, "<u4", 1)[0]), places.astype(np.int32), at))
    total = sum(len(places) + many for many, places, _ in heads)
    parts = 1 << (total // COUNTED).bit_length() if total > COUNTED else 1
    found: list[list[np.ndarray]] = [[] for _ in blocks]
    below = np.uint64(round_.route_bits)
    for part in range(parts):
        first, second, owner, place = [], [], [], []
        for i, ((_, data), (many, places, at)) in enumerate(zip(blocks, heads)):
            a, b, at = round_.unpack(data, len(places), at)
            x, y, _ = round_.unpack(data, many, at)
            if parts > 1:  # by the bits behind the route's
                own, sent = ((v << below) >> np.uint64(64 - (parts.bit_length() - 1)) == part for v in (a, x))
                a, b, x, y, places = a[own], b[own], x[sent], y[sent], places[own]
            first += [a, x]
            second += [b, y]
            place.append(places)
            owner.append((len(a), len(x)))
        a, b = np.concatenate(first), np.concatenate(second)
        order, new = _ranked(a, b, round_.wide)
        run = np.cumsum(new) - 1
        # A hash that is settled in one slab alone counts twice.
        weight = np.concatenate([np.repeat(np.array([1, 2], np.int8), n) for n in owner])
        repeated = np.zeros(len(a), bool)
        repeated[order] = (np.bincount(run, weight[order]) > 1)[run]
        at = 0
        for i, (n, many) in enumerate(owner):
            wanted = repeated[at : at + n] != round_.wide
            if wanted.any():
                found[i].append(place[i][wanted])
            at += n + many
    for (slab, _), some in zip(blocks, found):
        if some:
            places = np.sort(np.concatenate(some))
            yield slab, _pack_places(places, int(places[-1]) // _SEGMENT + 1)


def covered(n: int, places: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Which of ``n`` words lie in a window that starts at one of ``places``."""
    change = np.bincount(places, minlength=n + 1) - np.bincount(places + width, minlength=n + 1)[: n + 1]
    return np.cumsum(change[:n]) > 0


def intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal intervals of removed words, end exclusive."""
    edges = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]


def _marks(sent: DataFrame, round_: Round) -> DataFrame:
    """(key, twin, base, places) of marked windows, from the readers' rows (route, slab, data)."""
    parts = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> Iterator[pa.RecordBatch]:
            if held:
                rows = list(_count_route(held, round_))
                release()
                if rows:
                    yield _table(["slab", "directory", "data"], [r[0] for r in rows], [False] * len(rows), [r[1] for r in rows])

        now, held = None, []
        for batch in batches:
            for route, slab, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if route < 0:
                    yield _table(["slab", "directory", "data"], [slab], [True], [data])
                    continue
                if route != now:
                    yield from counted()
                    now, held = route, []
                held.append((slab, data))
        yield from counted()

    def locate(group: pa.Table) -> pa.Table:
        """A slab's marked places by document."""
        names = ["key", "twin", "base", "places"]
        schema = pa.schema([("key", pa.int64()), ("twin", pa.int64()), ("base", pa.int64()), ("places", pa.binary())])
        rows = list(zip(group["directory"].to_pylist(), group["data"].to_pylist()))
        entries, marked = np.empty((0, 4), np.int64), []
        for directory, data in rows:
            at = 0
            if directory:
                n = int(np.frombuffer(data, "<i8", 1)[0])
                entries, at = np.frombuffer(data, "<i8", 4 * n, 8).reshape(n, 4), 8 + 32 * n
            if not directory or not round_.wide:  # what is settled in a slab is repeated
                marked.append(_unpack_places(data, at)[0])
        places = np.sort(np.concatenate(marked)) if marked else np.empty(0, np.int64)
        begin = np.cumsum(entries[:, 3]) - entries[:, 3]
        cuts = np.searchsorted(places, np.append(begin, begin[-1:] + entries[-1:, 3]))
        out = [
            (*entry[:3], (places[a:b] - start).astype("<u2").tobytes())
            for entry, start, a, b in zip(entries.tolist(), begin.tolist(), cuts, cuts[1:])
            if b > a
        ]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema) if out else schema.empty_table().select(names)

    counted = sent.repartition(parts, "route").sortWithinPartitions("route").mapInArrow(released(count), "slab long, directory boolean, data binary")
    found = counted.groupBy("slab").applyInArrow(locate, "key long, twin long, base long, places binary")
    return found.groupBy("key", "twin").agg(F.collect_set(F.struct("base", "places")).alias("found"))


def _table(names: list[str], *columns: list) -> pa.RecordBatch:
    types = {"route": pa.int64(), "slab": pa.int64(), "directory": pa.bool_(), "data": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[n]) for n, c in zip(names, columns)], names=names)


def _sent(src: DataFrame, round_: Round, segments) -> DataFrame:
    """(route, slab, data) of all slabs; ``segments(row)`` gives what ``Slab.add`` takes, one after the other."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab = Slab(round_, TaskContext.get().partitionId())

        def sent() -> Iterator[pa.RecordBatch]:
            rows = list(slab.rows())
            slab.clear()
            for at in range(0, len(rows), 256):
                yield _table(["route", "slab", "data"], *zip(*rows[at : at + 256]))

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    for segment in segments(*row):
                        slab.add(*segment)
                        if slab.size >= round_.slab:
                            yield from sent()
        yield from sent()

    return src.mapInArrow(released(read), "route long, slab long, data binary")


def _places_of(found: list[dict] | None) -> np.ndarray:
    return np.unique(np.concatenate([np.frombuffer(f["places"], "<u2").astype(np.int64) + f["base"] for f in found])) if found else np.empty(0, np.int64)


def removal_masks(docs: DataFrame, schema: str, make, width: int = WIDTH, bits: int = 64, **cols: str) -> DataFrame:
    """One row per document: doc_id and what ``make(text, words, mask)`` gives for its removed words.

    ``bits`` of the first hash count; fewer make more work for the second round, and the same result.
    """
    src = texts(docs, **cols)
    src = src.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.xxhash64(F.lit("twin"), "text", "doc_id").alias("twin"), "text")
    ship(docs.sparkSession)
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # About six bytes a word; a wrong guess changes the size of a route, not the result.
    route_bits = min(MOST_ROUTE_BITS, max(ROUTE_BITS, (size // 6 // ROUTE_WINDOWS).bit_length()))
    slab = SLAB if route_bits == ROUTE_BITS else max(SLAB, BLOCK_WINDOWS << route_bits)
    mask = (1 << 64) - (1 << (64 - bits))

    def every(_, key: int, twin: int, text: bytes) -> Iterator[tuple]:
        hashes = window_hashes(text.split(), width)
        for at in range(0, len(hashes), _SEGMENT):
            own = hashes[at : at + _SEGMENT]
            yield (key, twin), at, len(own), np.arange(len(own)), own, np.zeros(len(own), np.uint64)

    def marked(_, key: int, twin: int, packed: bytes, found: list[dict] | None) -> Iterator[tuple]:
        import zstandard

        if not found:
            return
        words, places = zstandard.decompress(packed).split(), _places_of(found)
        first, second = (window_hashes(words, width, which) for which in (0, 1))
        for at in range(0, len(first), _SEGMENT):
            a, b = np.searchsorted(places, (at, at + _SEGMENT))
            if b > a:
                own = places[a:b]
                yield (key, twin), at, min(_SEGMENT, len(first) - at), own - at, first[own], second[own]

    id_type = src.schema["doc_id"].dataType
    small = StructType().add("doc_id", id_type).add("key", "long").add("twin", "long").add("packed", "binary")
    full = StructType().add("doc_id", id_type)
    for field in StructType.fromDDL(schema):
        full.add(field)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        # Texts move once, to their places; they travel compressed.
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                packed = pa.array(map(press, part.column(3).to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], packed], names=["doc_id", "key", "twin", "packed"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(full)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = []
                for packed, found, refuted in zip(*(c.to_pylist() for c in part.columns[1:])):
                    text = zstandard.decompress(packed)
                    words = text.split()
                    places = _places_of(found)
                    if refuted:
                        places = np.setdiff1d(places, _places_of(refuted), assume_unique=True)
                    mask = covered(len(words), places, width) if len(places) else np.zeros(len(words), bool)
                    made.append(make(text, words, mask))
                columns = [pa.array(c, type=f.type) for c, f in zip(zip(*made), list(target)[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=target)

    short, wide = Round(route_bits, slab, False, mask), Round(route_bits, slab, True, mask)
    found = _marks(_sent(src, short, every), short)
    placed = src.mapInArrow(released(squeeze), small).join(found, ["key", "twin"], "left").select("doc_id", "key", "twin", "packed", "found")
    # Both uses of ``placed`` read the same shuffled texts and places, as they need the same columns and rows.
    refuted = _marks(_sent(placed, wide, marked), wide)
    joined = placed.join(refuted.withColumnRenamed("found", "refuted"), ["key", "twin"], "left")
    return joined.select("doc_id", "packed", "found", "refuted").mapInArrow(released(cut), full)


def removed_intervals(docs: DataFrame, width: int = WIDTH, bits: int = 64, **cols: str) -> DataFrame:
    """(doc_id, n_words, n_removed, intervals, kept_sha256): maximal intervals of removed words, end exclusive."""

    def make(text: bytes, words: list[bytes], mask: np.ndarray) -> tuple:
        kept = [w for w, gone in zip(words, mask.tolist()) if not gone] if mask.any() else words
        spans = [{"from": a, "to": b} for a, b in intervals(mask)]
        return len(words), len(words) - len(kept), spans, hashlib.sha256(b" ".join(kept)).hexdigest()

    schema = "n_words long, n_removed long, intervals array<struct<`from`:long,`to`:long>>, kept_sha256 string"
    return removal_masks(docs, schema, make, width, bits, **cols)


def cut_texts(docs: DataFrame, width: int = WIDTH, bits: int = 64, **cols: str) -> DataFrame:
    """(doc_id, text, n_words, n_removed): texts without their repeated passages; other white space stays as it was."""

    def make(text: bytes, words: list[bytes], mask: np.ndarray) -> tuple:
        removed = int(mask.sum())
        if not removed:
            return text.decode("utf-8", "replace"), len(words), 0
        kept, at = [], 0
        spans = intervals(mask)
        starts = word_starts(text, words)
        for a, b in spans:
            kept.append(text[at : starts[a]])
            at = starts[b] if b < len(words) else starts[b - 1] + len(words[b - 1])
        kept.append(text[at:])
        return b"".join(kept).decode("utf-8", "replace"), len(words), removed

    return removal_masks(docs, "text string, n_words long, n_removed long", make, width, bits, **cols)


def word_starts(text: bytes, words: list[bytes]) -> list[int]:
    starts, at = [], 0
    for w in words:
        at = text.index(w, at)
        starts.append(at)
        at += len(w)
    return starts
