"""Records into and out of a ClickHouse server over its HTTP interface, in Arrow streams.

Tasks insert their own rows, a new request every ``INSERT_ROWS``; the completion marker follows when all have. The raw
table replaces rows of equal sort key, so a task that runs again does no harm. Reading is one partition an instance.
"""

from __future__ import annotations

import base64
import io
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from keyloom.functions.formatting import parse_rfc3339_ns
from keyloom.schema import RECORD_SCHEMA
from keyloom.session import ship

from . import socks

RAW, MARKERS, VIEW = "redis_records_raw", "import_batches_completed", "redis_records_view"
INSERT_ROWS, TIMEOUT_S = 1_000_000, 60
# Column types by name (fixed values of the table format).
COLUMN_TYPES = {
    "cluster": "String", "batch": "DateTime64(9, 'UTC')", "instance": "String", "db": "UInt64", "key": "String", "type": "LowCardinality(String)",
    "member_count": "UInt64", "rdb_size": "UInt64", "encoding": "LowCardinality(String)", "expire_at": "Nullable(DateTime64(3, 'UTC'))",
    "idle_seconds": "Nullable(UInt64)", "freq": "Nullable(UInt8)", "codis_slot": "Nullable(UInt16)", "redis_slot": "Nullable(UInt16)",
}
ARROW = pa.schema(
    [
        ("cluster", pa.string()), ("batch", pa.timestamp("ns", "UTC")), ("instance", pa.string()), ("db", pa.uint64()), ("key", pa.binary()),
        ("type", pa.string()), ("member_count", pa.uint64()), ("rdb_size", pa.uint64()), ("encoding", pa.string()), ("expire_at", pa.timestamp("ms", "UTC")),
        ("idle_seconds", pa.uint64()), ("freq", pa.uint8()), ("codis_slot", pa.uint16()), ("redis_slot", pa.uint16()),
    ]
)


class ClickHouseError(RuntimeError):
    """The server refused, or its tables are not as they should be."""


@dataclass(frozen=True)
class ClickHouse:
    """A server's database: ``http[s]://[user[:password]@]host:port?database=name``."""

    url: str
    proxy: str = ""

    def __post_init__(self) -> None:
        parts = urllib.parse.urlsplit(self.url)
        if parts.scheme not in ("http", "https") or not parts.hostname:
            raise ValueError("the address must start with http:// or https:// and name a host")
        if parts.port is None:
            raise ValueError("the address must name a port")
        if not urllib.parse.parse_qs(parts.query).get("database"):
            raise ValueError("the address must end with ?database=<name>")
        proxy = urllib.parse.urlsplit(self.proxy)
        if self.proxy and (proxy.scheme not in ("http", "socks5") or not proxy.hostname or (proxy.scheme == "socks5" and proxy.port is None)):
            raise ValueError("a proxy must start with http:// or socks5:// and name a host, and a port for socks5")

    def request(self, sql: str, body: bytes | None = None, **params: str) -> bytes:
        parts = urllib.parse.urlsplit(self.url)
        options = {k: v[0] for k, v in urllib.parse.parse_qs(parts.query).items()}
        options |= {"query": sql} | {f"param_{k}": v for k, v in params.items()}
        target = f"{parts.scheme}://{parts.hostname}:{parts.port}/?{urllib.parse.urlencode(options)}"
        call = urllib.request.Request(target, data=body if body is not None else b"")
        if parts.username:
            pair = f"{urllib.parse.unquote(parts.username)}:{urllib.parse.unquote(parts.password or '')}"
            call.add_header("Authorization", "Basic " + base64.b64encode(pair.encode()).decode())
        through = [urllib.request.ProxyHandler({})]
        if self.proxy.startswith("socks5"):
            through.append(socks.Handler(self.proxy))
        elif self.proxy:
            through = [urllib.request.ProxyHandler({"http": self.proxy, "https": self.proxy})]
        opener = urllib.request.build_opener(*through)
        try:
            with opener.open(call, timeout=TIMEOUT_S) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            raise ClickHouseError(e.read().decode("utf-8", "replace").strip()) from None

    def rows(self, sql: str, **params: str) -> list[str]:
        """Single-column answers as text."""
        return self.request(sql + " FORMAT TSVRaw", **params).decode().splitlines()


def ddl() -> list[str]:
    """The raw table, the marker table, and the view of each cluster's last completed batch."""
    columns = ", ".join(f"{n} {t}" for n, t in COLUMN_TYPES.items())
    keep = "PARTITION BY toYYYYMMDD(batch) ORDER BY ({}) TTL toDateTime(batch) + INTERVAL 3 DAY"
    last = f"SELECT cluster, max(batch) FROM {MARKERS} GROUP BY cluster"
    return [
        f"CREATE TABLE {RAW} ({columns}) ENGINE = ReplacingMergeTree {keep.format('cluster, batch, instance, db, key')}",
        f"CREATE TABLE {MARKERS} (cluster String, batch {COLUMN_TYPES['batch']}) ENGINE = ReplacingMergeTree {keep.format('cluster, batch')}",
        f"CREATE VIEW {VIEW} AS SELECT * FROM {RAW} WHERE (cluster, batch) IN ({last})",
    ]


def ensure_tables(server: ClickHouse, create: bool = False) -> None:
    """All three objects exist, or none does and they are made; anything else is an error."""
    names = (RAW, MARKERS, VIEW)
    missing = [n for n in names if server.rows(f"EXISTS {n}") != ["1"]]
    if missing and len(missing) < len(names):
        raise ClickHouseError(f"missing: {', '.join(missing)}")
    if missing and not create:
        raise ClickHouseError("the tables do not exist; pass create to make them")
    for statement in ddl() if missing else []:
        server.request(statement)
    if not missing:
        _check_columns(server, RAW, COLUMN_TYPES)
        _check_columns(server, MARKERS, {n: COLUMN_TYPES[n] for n in ("cluster", "batch")})


def _check_columns(server: ClickHouse, table: str, wanted: dict[str, str]) -> None:
    """Every column is there under its type; a table may have others."""
    found = dict(r.split("\t", 1) for r in server.rows("SELECT concat(name, '\\t', type) FROM system.columns WHERE database = currentDatabase() AND table = {t:String}", t=table))
    wrong = [f"{n} is {found.get(n, 'missing')}, not {t}" for n, t in wanted.items() if found.get(n) != t]
    if wrong:
        raise ClickHouseError(f"{table}: {'; '.join(wrong)}")


def _outgoing(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of RECORD_SCHEMA as the server's columns."""
    columns = []
    for field in ARROW:
        column = batch.column(batch.schema.get_field_index("batch_ns" if field.name == "batch" else field.name))
        if field.name == "member_count":
            column = column.fill_null(0)
        columns.append(column.cast(field.type, safe=False))
    return pa.RecordBatch.from_arrays(columns, schema=ARROW)


def write(records: DataFrame, server: ClickHouse, cluster: str, batch: str, create: bool = False, rows_per_insert: int = INSERT_ROWS) -> int:
    """Insert one batch and then its marker; returns the number of rows."""
    ensure_tables(server, create)
    ship(records.sparkSession)
    parse_rfc3339_ns(batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, held, rows = 0, [], 0

        def post() -> None:
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, ARROW) as out:
                for b in held:
                    out.write_batch(b)
            server.request(f"INSERT INTO {RAW} FORMAT ArrowStream", sink.getvalue())

        for b in batches:
            for at in range(0, b.num_rows, rows_per_insert):
                part = _outgoing(b.slice(at, rows_per_insert))
                if rows + part.num_rows > rows_per_insert and held:
                    post()
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
                sent += part.num_rows
        if held:
            post()
        yield pa.RecordBatch.from_arrays([pa.array([sent], pa.int64())], names=["n"])

    total = records.select(*RECORD_SCHEMA.fieldNames()).mapInArrow(run, "n long").agg({"n": "sum"}).first()[0] or 0
    when = "parseDateTime64BestEffort({b:String}, 9, 'UTC')"
    server.request(f"INSERT INTO {MARKERS} (cluster, batch) SELECT {{c:String}}, {when}", c=cluster, b=batch)
    return total


def latest(server: ClickHouse, cluster: str) -> str:
    """The last completed batch, as RFC 3339."""
    found = server.rows(f"SELECT formatDateTime(max(batch), '%Y-%m-%dT%H:%i:%S.%fZ', 'UTC') FROM {MARKERS} WHERE cluster = {{c:String}} HAVING count() > 0", c=cluster)
    if not found:
        raise ClickHouseError(f"no completed batch of {cluster}")
    return found[0]


class InstancePartition(InputPartition):
    def __init__(self, instance: str):
        self.instance = instance


class Reader(DataSourceReader):
    """One completed batch of a cluster."""

    _WHERE = (
        "WHERE cluster = {c:String} AND batch = parseDateTime64BestEffort({b:String}, 9, 'UTC') "
        f"AND (cluster, batch) IN (SELECT cluster, batch FROM {MARKERS})"
    )

    def __init__(self, options: dict):
        self.server = ClickHouse(options.get("url", ""), options.get("proxy", ""))
        self.cluster = options.get("cluster", "")
        self.batch = options.get("batch") or latest(self.server, self.cluster)

    def partitions(self) -> list[InputPartition]:
        found = self.server.rows(f"SELECT DISTINCT instance FROM {RAW} {self._WHERE} ORDER BY instance", c=self.cluster, b=self.batch)
        return [InstancePartition(i) for i in found] or [InstancePartition("")]

    def read(self, partition: InstancePartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(RECORD_SCHEMA)
        columns = ", ".join(n if n not in ("type", "encoding") else f"CAST({n} AS String) AS {n}" for n in COLUMN_TYPES)
        sql = f"SELECT {columns} FROM {RAW} {self._WHERE} AND instance = {{i:String}} FORMAT ArrowStream"
        answer = self.server.request(sql, c=self.cluster, b=self.batch, i=partition.instance)
        if not answer:
            return
        for found in pa.ipc.open_stream(answer):
            given = {n: found.column(i) for i, n in enumerate(found.schema.names)}
            given["batch_ns"] = given["batch"].cast(pa.int64())
            given["batch"] = given["batch"].cast(pa.timestamp("us", "UTC"), safe=False)
            yield pa.RecordBatch.from_arrays([given[f.name].cast(f.type, safe=False) for f in target], schema=target)


class ClickHouseDataSource(DataSource):
    """``spark.read.format("clickhouse_records")`` with options url, cluster, batch (default: the last) and proxy."""

    @classmethod
    def name(cls) -> str:
        return "clickhouse_records"

    def schema(self):
        return RECORD_SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ClickHouseDataSource)
