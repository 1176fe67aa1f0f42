"""Batches of records as Parquet: one directory a batch, made visible at once by a rename and a completion marker.

Layout: ``<dir>/cluster=<name>/batch=<slug>/`` for records, ``<dir>/completed/`` for markers. A batch is written under a
name that starts with a dot, which Spark's readers pass over, and renamed when every instance is in it. Renames go
through the Hadoop file system, so the store may be anywhere Spark writes.

A batch carries its own summary in ``_summary/`` (readers pass over that too): totals by database, type and instance, the largest
keys, and the instances of each slot that has several. Reports of a stored batch take these from there, so no row is read for
them. Row groups hold ``ROW_GROUP`` rows, sorted by instance, database and key, so their statistics prune reads by these.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions.formatting import batch_slug, format_rfc3339_ns, parse_rfc3339_ns
from keyloom.operators import aggregates
from keyloom.schema import MARKER_SCHEMA, RECORD_SCHEMA

COMPRESSIONS = {"zstd": "zstd", "snappy": "snappy", "none": "none", "lz4": "lz4_raw", "gzip": "gzip"}
#: The order of rows in a batch's files, and rows of a row group.
SORT = ("instance", "db", "key")
ROW_GROUP = 8192
SUMMARY = "_summary"
SUMMARY_SCHEMA = T.StructType(
    [
        T.StructField("part", T.StringType()),  # totals, top, codis_slot or redis_slot
        T.StructField("db", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("instance", T.StringType()),
        T.StructField("key_count", T.LongType()),  # of totals; of a slot: its instances
        T.StructField("rdb_size", T.LongType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("member_count", T.LongType()),
        T.StructField("encoding", T.StringType()),
        T.StructField("expire_at", T.TimestampType()),
        T.StructField("slot", T.IntegerType()),
    ]
)


class BatchError(ValueError):
    """A batch exists already, is missing, or is not what its directory says."""


class Store:
    """Batches under one base directory."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def _names(self, path: str) -> list[str]:
        if not self._exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)))

    def cluster_dir(self, cluster: str) -> str:
        return f"{self.base}/cluster={cluster}"

    def batch_dir(self, cluster: str, slug: str) -> str:
        return f"{self.cluster_dir(cluster)}/batch={slug}"

    @property
    def markers_dir(self) -> str:
        return f"{self.base}/completed"

    def write(
        self, records: DataFrame, cluster: str, batch: str, instances: list[str] | None = None, compression: str = "zstd",
        dedupe: Column | None = None, rows_per_file: int = 0,
    ) -> str:
        """Write and complete one batch; returns its directory. Nothing is visible before the rename.

        ``dedupe`` orders the rows of one key: the last of them is kept.
        """
        if compression not in COMPRESSIONS:
            raise BatchError(f"compression {compression!r} is none of {sorted(COMPRESSIONS)}")
        ns = parse_rfc3339_ns(batch)
        final = self.batch_dir(cluster, batch_slug(ns))
        if self._exists(final):
            raise BatchError(f"{final} exists")
        made = f"{self.cluster_dir(cluster)}/.making-{batch_slug(ns)}"
        self._fs.delete(self._path(made), True)
        rows = records.select(*RECORD_SCHEMA.fieldNames())
        if dedupe is not None:
            rows = aggregates.deduplicate(rows, dedupe)
        # Keys of a large instance spread over many files; each file is sorted, so row groups prune by db and key.
        sorted_rows = rows.repartition("instance", "db", F.pmod(F.xxhash64("key"), F.lit(64))).sortWithinPartitions(*SORT)
        writer = sorted_rows.write.option("compression", COMPRESSIONS[compression]).option("parquet.block.row.count.limit", ROW_GROUP)
        if rows_per_file:
            writer = writer.option("maxRecordsPerFile", rows_per_file)
        writer.parquet(made)
        # From the written rows, so that it is theirs whatever the source; a batch's own files are cheap to scan by column.
        summarize(self.spark.read.schema(RECORD_SCHEMA).parquet(made)).coalesce(1).write.parquet(f"{made}/{SUMMARY}")
        if not self._fs.rename(self._path(made), self._path(final)):
            raise BatchError(f"cannot rename {made}")
        if instances is None:
            instances = [r["instance"] for r in self.spark.read.parquet(final).select("instance").distinct().orderBy("instance").collect()]
        marker = self.spark.createDataFrame([(cluster, ns)], "cluster string, batch_ns long").select(
            "cluster", F.timestamp_micros(F.expr("batch_ns div 1000")).alias("batch"), "batch_ns", F.array(*map(F.lit, instances)).cast("array<string>").alias("instances")
        )
        marker.coalesce(1).write.mode("append").parquet(self.markers_dir)
        return final

    def find(self, cluster: str, batch: str | None = None) -> str:
        """The directory of a batch (RFC 3339 or slug), or of the last one by name."""
        names = [n for n in self._names(self.cluster_dir(cluster)) if n.startswith("batch=")]
        if batch:
            try:
                batch = batch_slug(parse_rfc3339_ns(batch))
            except ValueError:
                pass
            if f"batch={batch}" not in names:
                raise BatchError(f"no batch {batch} of {cluster}")
            return self.batch_dir(cluster, batch)
        if not names:
            raise BatchError(f"no batch of {cluster}")
        return f"{self.cluster_dir(cluster)}/{names[-1]}"

    def files(self, directory: str) -> list[str]:
        found = [f"{directory}/{n}" for n in self._names(directory) if n.lower().endswith(".parquet")]
        if not found:
            raise BatchError(f"no Parquet file in {directory}")
        return found

    def read(self, cluster: str, batch: str | None = None) -> DataFrame:
        """The records of one batch; files of other writers (nanosecond times, unsigned counts) are converted."""
        return read_records(self.spark, self.files(self.find(cluster, batch)))

    def summary(self, cluster: str, batch: str | None = None) -> DataFrame | None:
        """The summary of one batch; None if its writer left none."""
        path = f"{self.find(cluster, batch)}/{SUMMARY}"
        return self.spark.read.schema(SUMMARY_SCHEMA).parquet(path) if self._exists(path) else None

    def footers(self, cluster: str, batch: str | None = None) -> DataFrame:
        """(file, rows, row_groups, most_rows) of a batch, from its files' footers alone."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        rows = []
        for path in self.files(self.find(cluster, batch)):
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(self._path(path), conf))
            try:
                groups = [g.getRowCount() for g in reader.getFooter().getBlocks()]
            finally:
                reader.close()
            rows.append((path.rpartition("/")[2], sum(groups), len(groups), max(groups, default=0)))
        return self.spark.createDataFrame(rows, "file string, rows long, row_groups long, most_rows long")

    def markers(self) -> DataFrame:
        if not self._exists(self.markers_dir):
            return self.spark.createDataFrame([], MARKER_SCHEMA)
        return self.spark.read.schema(MARKER_SCHEMA).parquet(self.markers_dir)

    def latest(self, cluster: str) -> str:
        """The last completed batch, as RFC 3339."""
        last = self.markers().where(F.col("cluster") == cluster).agg(F.max("batch_ns")).first()[0]
        if last is None:
            raise BatchError(f"no completed batch of {cluster}")
        return format_rfc3339_ns(last)

    def raw(self) -> DataFrame:
        """All batches of all clusters."""
        found = [
            f for c in self._names(self.base) if c.startswith("cluster=")
            for b in self._names(f"{self.base}/{c}") if b.startswith("batch=")
            for f in self._names(f"{self.base}/{c}/{b}") if f.lower().endswith(".parquet")
            for f in [f"{self.base}/{c}/{b}/{f}"]
        ]
        return read_records(self.spark, found) if found else self.spark.createDataFrame([], RECORD_SCHEMA)


def summarize(records: DataFrame) -> DataFrame:
    """A batch's summary (SUMMARY_SCHEMA): at most a row a (db, type, instance), ``TOP`` keys, and a row a skewed slot."""

    def part(name: str, rows: DataFrame) -> DataFrame:
        known = {f.name: F.col(f.name) if f.name in rows.columns else F.lit(None) for f in SUMMARY_SCHEMA} | {"part": F.lit(name)}
        return rows.select(*[known[f.name].cast(f.dataType).alias(f.name) for f in SUMMARY_SCHEMA])

    slots = lambda c: aggregates.skewed_slots(records, c).withColumnsRenamed({c: "slot", "instances": "key_count"})
    parts = [
        part("totals", aggregates.summary(records).withColumnRenamed("total_size", "rdb_size")), part("top", aggregates.top_keys(records)),
        part("codis_slot", slots("codis_slot")), part("redis_slot", slots("redis_slot")),
    ]
    return reduce(DataFrame.unionByName, parts)


def read_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Record files under RECORD_SCHEMA's types, whoever wrote them.

    Other writers' nanosecond times can only be read with ``spark.sql.legacy.parquet.nanosAsLong``, which is set if they are met.
    """
    try:
        found = spark.read.parquet(*paths)
    except AnalysisException as e:
        if "NANOS" not in str(e):
            raise
        spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
        found = spark.read.parquet(*paths)
    if found.schema["batch"].dataType.simpleString() == "bigint":
        found = found.withColumn("batch_ns", F.col("batch")).withColumn("batch", F.timestamp_micros(F.expr("batch div 1000")))
    if "batch_ns" not in found.columns:
        found = found.withColumn("batch_ns", F.unix_micros("batch") * 1000)
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORD_SCHEMA])


def check_consistency(records: DataFrame) -> tuple[str, int]:
    """(cluster, batch_ns) of records that must all be of one batch."""
    row = records.agg(
        F.min("cluster"), F.max("cluster"), F.min(F.coalesce("batch_ns", F.unix_micros("batch") * 1000)), F.max(F.coalesce("batch_ns", F.unix_micros("batch") * 1000))
    ).first()
    if row[0] is None:
        raise BatchError("no records")
    if row[0] != row[1] or row[2] != row[3]:
        raise BatchError(f"records of several batches: {row[0]}..{row[1]}, {row[2]}..{row[3]}")
    return row[0], row[2]


# The record store as tables of the session's catalog

TABLES = ("records_raw", "import_batches_completed")
VIEW = "records_view"


def ddl(database: str = "default") -> list[str]:
    """Statements that make the two tables and the view of the latest completed batches."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in RECORD_SCHEMA)
    markers = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in MARKER_SCHEMA)
    return [
        f"CREATE TABLE {database}.{TABLES[0]} ({columns}) USING parquet PARTITIONED BY (cluster, batch)",
        f"CREATE TABLE {database}.{TABLES[1]} ({markers}) USING parquet",
        f"CREATE VIEW {database}.{VIEW} AS SELECT r.* FROM {database}.{TABLES[0]} r LEFT SEMI JOIN "
        f"(SELECT cluster, max(batch) AS batch FROM {database}.{TABLES[1]} GROUP BY cluster) l ON r.cluster = l.cluster AND r.batch = l.batch",
    ]


def ensure_tables(spark: SparkSession, create: bool, database: str = "default") -> None:
    """All three objects exist, or none does and they are made; anything else is an error."""
    names = [*TABLES, VIEW]
    missing = [n for n in names if not spark.catalog.tableExists(f"{database}.{n}")]
    if not missing:
        return
    if len(missing) < len(names):
        raise BatchError(f"missing: {', '.join(missing)}")
    if not create:
        raise BatchError("the tables do not exist; pass create to make them")
    for statement in ddl(database):
        spark.sql(statement)


def append_to_tables(spark: SparkSession, records: DataFrame, cluster: str, batch: str, instances: list[str], create: bool = False, database: str = "default") -> None:
    """Records into the raw table, then the marker that makes them visible."""
    ensure_tables(spark, create, database)
    ns = parse_rfc3339_ns(batch)
    target = spark.table(f"{database}.{TABLES[0]}")
    # Every task writes its own rows to the batch's table partition: no shuffle. A second run replaces what the first one wrote.
    mode = "spark.sql.sources.partitionOverwriteMode"
    was = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")  # only the partitions that are written are replaced
    try:
        records.select(*target.columns).write.insertInto(f"{database}.{TABLES[0]}", overwrite=True)
    finally:
        spark.conf.set(mode, was)
    marker = spark.createDataFrame([(cluster, ns, instances)], "cluster string, batch_ns long, instances array<string>")
    marker.select("cluster", F.timestamp_micros(F.expr("batch_ns div 1000")).alias("batch"), "batch_ns", "instances").write.mode("append").insertInto(
        f"{database}.{TABLES[1]}"
    )
