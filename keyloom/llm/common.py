"""Shared pieces of the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keyloom.session import pick, ship

#: Rows of an Arrow batch that are Python objects at the same time.
SLICE = 512


def release() -> None:
    """Give freed memory back to the system: a worker stays between tasks, beside its executor's other users of memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a partition's batches, and ``release`` behind it."""

    def run_and_release(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return run_and_release


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text as UTF-8 bytes, null: empty). Extra columns, clashing names included, are ignored."""
    out = pick(docs, doc_id=id_col, text=text_col)
    return out.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def map_texts(docs: DataFrame, schema: str, rows: Callable[[list[bytes]], list[list]], **cols: str) -> DataFrame:
    """One output row per document: doc_id and the columns that ``rows`` makes from a list of whole texts."""
    src = texts(docs, **cols)
    ship(docs.sparkSession)
    out = StructType.fromDDL(schema)
    id_type = src.schema["doc_id"].dataType
    full = StructType().add("doc_id", id_type)
    for field in out:
        full.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(full)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = rows(part.column(1).to_pylist())
                columns = [part.column(0)] + [pa.array(v, type=target.field(i + 1).type) for i, v in enumerate(made)]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return src.mapInArrow(released(run), full)
