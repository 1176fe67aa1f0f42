"""Labelled documents: which rows may be learnt from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.session import pick

#: Labelled rows that a model is fitted on, at most: those with the smallest hashes of their ids.
SAMPLE = 20_000
FOLDS = 5


def held_out(doc_id):
    """True where crc32 of the id as text leaves no remainder by 5. Rows without an id are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def sample_ids(labels: DataFrame, label: str, limit: int = SAMPLE) -> DataFrame:
    """(doc_id, y) of at most ``limit`` learnable labelled rows; contradicting repeats count with their largest label."""
    own = pick(labels, doc_id="doc_id", y=label).where("doc_id is not null and y is not null").where(~held_out(F.col("doc_id")))
    return own.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def with_labels(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of a bounded id sample, with y. ``ids`` is bounded by its limit, so it may be broadcast."""
    return pick(docs, doc_id="doc_id", text="text").join(F.broadcast(ids), "doc_id")
