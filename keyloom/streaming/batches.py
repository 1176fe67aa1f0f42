"""Reports as batches complete: the marker table as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from keyloom.functions.formatting import format_rfc3339_ns
from keyloom.plans.report import ReportData, build_report
from keyloom.schema import MARKER_SCHEMA
from keyloom.sinks.batches import Store


def completed_batches(spark: SparkSession, store: Store) -> DataFrame:
    """A stream of completion markers."""
    return spark.readStream.schema(MARKER_SCHEMA).parquet(store.markers_dir)


def report_new_batches(spark: SparkSession, store: Store, checkpoint: str, deliver: Callable[[ReportData], None]) -> StreamingQuery:
    """Deliver a report of every batch that completed since the last run, then stop. Markers are seen once each."""

    def each(markers: DataFrame, _epoch: int) -> None:
        for row in markers.select("cluster", "batch_ns").orderBy("batch_ns").toLocalIterator():
            batch = format_rfc3339_ns(row["batch_ns"])
            deliver(build_report(store.read(row["cluster"], batch), row["cluster"], batch))

    stream = completed_batches(spark, store).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start()
