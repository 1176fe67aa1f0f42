"""The ``rdb`` data source: snapshots as record rows, one partition an instance.

    spark.dataSource.register(RdbDataSource)
    spark.read.format("rdb").options(mode="file", path="/data/dump.rdb", instance="10.0.0.1:6379", cluster="c").load()

Modes: ``file`` (paths every executor can open, comma-separated, with as many instances), ``standalone`` (addr),
``cluster`` (nodes), ``codis`` (dashboard). Servers are discovered on the driver and read in the tasks. For files in a
store that only Spark can open, use :func:`read_files`.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from keyloom.functions.formatting import parse_rfc3339_ns
from keyloom.schema import RECORD_SCHEMA
from keyloom.session import ship

from . import discovery, rdb, wire

BATCH_ROWS = 8192
MODES = ("file", "standalone", "cluster", "codis")


def record_batches(records: Iterator[rdb.Record], cluster: str, batch_ns: int, instance: str, source_type: str) -> Iterator[pa.RecordBatch]:
    """Records as Arrow batches of RECORD_SCHEMA."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(RECORD_SCHEMA)
    rows: list[rdb.Record] = []

    def flush() -> pa.RecordBatch:
        n = len(rows)
        by_slot = [rdb.slots(source_type, r.key) for r in rows]
        columns = [
            [cluster] * n,
            [batch_ns // 1000] * n,
            [instance] * n,
            [r.db for r in rows],
            [r.key for r in rows],
            [r.type for r in rows],
            [r.member_count for r in rows],
            [r.rdb_size for r in rows],
            [r.encoding for r in rows],
            [None if r.expire_at_ms is None else r.expire_at_ms * 1000 for r in rows],
            [r.idle_seconds for r in rows],
            [r.freq for r in rows],
            [s[0] for s in by_slot],
            [s[1] for s in by_slot],
            [batch_ns] * n,
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, target)], schema=target)

    for record in records:
        rows.append(record)
        if len(rows) == BATCH_ROWS:
            yield flush()
            rows = []
    if rows:
        yield flush()


class InstancePartition(InputPartition):
    def __init__(self, instance: str, path: str | None):
        self.instance, self.path = instance, path


class RdbReader(DataSourceReader):
    def __init__(self, options: dict):
        get = lambda k, d="": options.get(k, d)
        self.mode = get("mode", "file").lower()
        if self.mode not in MODES:
            raise ValueError(f"mode {self.mode!r} is none of {MODES}")
        self.username, self.password = get("username"), get("password")
        self.require_slave = get("require_slave", "false").lower() == "true"
        self.on_truncate = get("on_truncate", "raise")
        self.paths = [p for p in get("path").split(",") if p]
        self.instances = [i for i in get("instance").split(",") if i]
        self.nodes = [n for n in (get("nodes") or get("addr")).split(",") if n]
        self.dashboard = get("dashboard")
        self.cluster = get("cluster") or (discovery.codis_product(self.dashboard) if self.mode == "codis" else "")
        if not self.cluster:
            raise ValueError("option cluster is missing")
        batch = get("batch")
        self.batch_ns = parse_rfc3339_ns(batch) if batch else int(datetime.now(timezone.utc).timestamp() * 10**6) * 1000
        if self.mode == "file" and (not self.paths or len(self.paths) != len(self.instances)):
            raise ValueError("options path and instance must name as many files as instances")
        if self.mode in ("standalone", "cluster") and not self.nodes:
            raise ValueError("option addr or nodes is missing")
        for address in self.nodes:
            wire.parse_address(address)

    def partitions(self) -> list[InputPartition]:
        if self.mode == "file":
            return [InstancePartition(i, p) for i, p in zip(self.instances, self.paths)]
        if self.mode == "standalone":
            found = self.nodes
        elif self.mode == "cluster":
            found = discovery.cluster_instances(self.nodes, self.username, self.password, self.require_slave)
        else:
            found = discovery.codis_instances(self.dashboard, self.require_slave)
        return [InstancePartition(i, None) for i in found]

    def read(self, partition: InstancePartition) -> Iterator[pa.RecordBatch]:
        link = None
        if partition.path is not None:
            stream = open(partition.path, "rb")
        else:
            link, stream = wire.open_snapshot(partition.instance, self.username, self.password)
        try:
            found = rdb.records(stream, self.on_truncate)
            yield from record_batches(found, self.cluster, self.batch_ns, partition.instance, self.mode)
        finally:
            (link or stream).close()


class RdbDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rdb"

    def schema(self):
        return RECORD_SCHEMA

    def reader(self, schema) -> RdbReader:
        return RdbReader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(RdbDataSource)


def read_files(spark: SparkSession, path: str, cluster: str, batch: str, source_type: str = "file", on_truncate: str = "raise") -> DataFrame:
    """Snapshots under a path of any Hadoop file system, at most 2 GB each; the file name is the instance."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return read_blobs(files, cluster, batch, source_type, on_truncate)


def read_blobs(blobs: DataFrame, cluster: str, batch: str, source_type: str = "file", on_truncate: str = "raise") -> DataFrame:
    """Snapshots held as rows (name, content); the name is the instance. Contents are decoded where they lie, without a copy."""
    ship(blobs.sparkSession)
    batch_ns = parse_rfc3339_ns(batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for name, content in zip(rows.column(0).to_pylist(), rows.column(1)):
                with pa.BufferReader(content.as_buffer()) as stream:
                    found = rdb.records(stream, on_truncate)
                    yield from record_batches(found, cluster, batch_ns, name.removesuffix(".rdb"), source_type)

    return blobs.select("name", "content").mapInArrow(run, RECORD_SCHEMA)
