"""Hierarchical multi-length packing of documents into training sequences.

Each scan partition packs what it reads, in one pass and without a shuffle. A document's full windows are sequences of
their own; what is left of it is routed to the smallest tier that holds it. Tiers are packed from the longest: a
sequence opens with the longest rest of its tier, its gap takes the longest shorter rests that fit whole, and the last
tokens of the gap are cut from a longer one, whose remainder is routed anew. So every sequence is full, at a tier's
size, except the last of a partition. Sequences of one tier are dealt into step groups of equal token totals.

Ids come from the streaming transducer of :mod:`keyloom.llm.bpe` and equal the tokenizer library's. Memory is bounded by ``POOL``
tokens of rests, the transducer's table and the texts of one slice. A partition that is computed again gives the same rows. Each partition leaves up to one short
step group a tier.

Null and empty texts yield the end token alone; an empty table yields no rows; repeated rows are packed as often as they occur;
a text of any length is cut at full windows. Rests of equal length are taken in order of arrival. Extra columns are ignored,
also under names that differ from ``doc_id`` and ``text`` only in case.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from keyloom.session import ship

from .bpe import encoder
from .common import SLICE, released, texts

TIERS = (256, 512, 1024, 2048)
#: Tokens that wait for a sequence, at most.
POOL = 1_000_000
#: Tokens of a step group.
STEP = 16_384
END_TOKEN = 1


class Rest(NamedTuple):
    """A stretch of a document that has no sequence yet; ordered by length, then by arrival."""

    length: int
    number: int
    doc_id: object
    start: int
    ids: bytes
    doc_tokens: int


class Packer:
    """Packs documents given one after the other; ``rows`` are the pieces of finished sequences."""

    def __init__(self, first_sequence: int, tiers: tuple[int, ...] = TIERS, pool: int = POOL, step: int = STEP):
        self.tiers, self.step = sorted(tiers), step
        self.pool = max(pool, 4 * self.tiers[-1])  # so what is left can always fill a sequence
        self.rests: list[Rest] = []
        self.held = self.arrived = 0
        self.next_sequence = self.first = first_sequence
        self.dealt: dict[int, tuple[int, int]] = {}
        self.groups = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: object, ids: bytes) -> None:
        total, size = len(ids) // 4, self.tiers[-1]
        at = 0
        while total - at >= size:
            self._emit([Rest(size, 0, doc_id, at, ids[4 * at : 4 * (at + size)], total)], size)
            at += size
        if at < total:
            self._keep(doc_id, at, ids[4 * at :], total)
        if self.held > self.pool:
            self.pack(self.pool // 2)

    def _keep(self, doc_id: object, start: int, ids: bytes, total: int) -> None:
        self.arrived += 1
        insort(self.rests, Rest(len(ids) // 4, self.arrived, doc_id, start, ids, total), key=lambda r: r[:2])
        self.held += len(ids) // 4

    def _take(self, i: int) -> Rest:
        rest = self.rests.pop(i)
        self.held -= rest.length
        return rest

    def pack(self, leave: int) -> None:
        """Finish sequences, longest tier first, until at most ``leave`` tokens wait."""
        while self.rests and self.held > leave:
            first = self._take(len(self.rests) - 1)
            size = next(t for t in self.tiers if t >= first.length)
            sequence, gap = [first], size - first.length
            while gap and self.rests:
                i = bisect_right(self.rests, gap, key=lambda r: r.length)
                rest = self._take(i - 1 if i else 0)
                if rest.length > gap:
                    self._keep(rest.doc_id, rest.start + gap, rest.ids[4 * gap :], rest.doc_tokens)
                    rest = rest._replace(length=gap, ids=rest.ids[: 4 * gap])
                sequence.append(rest)
                gap -= rest.length
            self._emit(sequence, size)

    def _emit(self, sequence: list[Rest], size: int) -> None:
        group, filled = self.dealt.get(size, (None, self.step))
        if filled >= self.step:
            group, filled = self.first + self.groups, 0
            self.groups += 1
        self.dealt[size] = (group, filled + size)
        offset = 0
        for r in sequence:
            self.rows.append((r.doc_id, r.start, r.length, zlib.crc32(r.ids), r.doc_tokens, self.next_sequence, offset, size, group))
            offset += r.length
        self.next_sequence += 1


COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def pack_documents(docs: DataFrame, vocabulary: str, tiers: tuple[int, ...] = TIERS, pool: int = POOL, **cols: str) -> DataFrame:
    """One row per piece of a document: where it lies in the document and in which sequence."""
    src = texts(docs, **cols)
    ship(docs.sparkSession)
    full = StructType().add("doc_id", src.schema["doc_id"].dataType)
    for field in StructType.fromDDL(COLUMNS):
        full.add(field)
    end = END_TOKEN.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(full)
        bpe = encoder(vocabulary)
        packer = Packer(TaskContext.get().partitionId() << 36, tiers, pool)

        def finished() -> pa.RecordBatch:
            columns = list(zip(*packer.rows))
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, target)], schema=target)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = bpe.encode_all([t.decode("utf-8", "replace") for t in part.column(1).to_pylist()])
                for doc_id, ids in zip(part.column(0).to_pylist(), found):
                    packer.add(doc_id, ids + end)
                if len(packer.rows) > 8192:
                    yield finished()
        packer.pack(0)
        if packer.rows:
            yield finished()

    return src.mapInArrow(released(run), full)
