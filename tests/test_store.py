import base64
import csv
import io
import json
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from keyloom import cli
from keyloom.functions.formatting import parse_rfc3339_ns
from keyloom.plans import render
from keyloom.plans.report import build_report
from keyloom.schema import RECORD_SCHEMA
from keyloom.sinks import batches
from keyloom.sinks.batches import BatchError, Store, check_consistency
from keyloom.streaming.batches import report_new_batches

from . import rdb_builder as b

BATCH, LATER = "2024-01-01T00:00:00.000000001Z", "2024-02-01T00:00:00Z"


def fixture(spark, batch=BATCH, cluster="c"):
    ns = parse_rfc3339_ns(batch)
    when = datetime.fromtimestamp(ns // 10**9, timezone.utc)
    rows = [
        (cluster, when, i, db, bytearray(k), t, n, s, e, None, None, None, None, None, ns)
        for i in ("10.0.0.1:6379", "10.0.0.2:6379")
        for db, k, t, e, s, n in ((0, b"user:1", "string", "raw", 100, 1), (0, b"user:2", "string", "raw", 200, 1), (1, b"hash:1", "hash", "raw", 300, 2))
    ]
    return spark.createDataFrame(rows, RECORD_SCHEMA)


def test_report_of_the_fixture(spark):
    report = build_report(fixture(spark))
    assert report.db_aggregates == [{"db": 0, "key_count": 4, "total_size": 600}, {"db": 1, "key_count": 2, "total_size": 600}]
    assert report.type_aggregates == [{"data_type": "hash", "key_count": 2, "total_size": 600}, {"data_type": "string", "key_count": 4, "total_size": 600}]
    assert [r["total_size"] for r in report.instance_aggregates] == [600, 600]
    assert [r["rdb_size"] for r in report.top_keys] == [300, 300, 200, 200, 100, 100]
    assert report.cluster_issues == {"big_keys": [], "codis_slot_skew": False, "redis_cluster_slot_skew": False}
    decoded = [(base64.b64decode(r["prefix_base64"]), r["total_size"], r["key_count"]) for r in report.top_prefixes]
    assert decoded == [(b"hash:1", 600, 2), (b"user:", 600, 4), (b"user:1", 200, 2), (b"user:2", 400, 2)]
    assert (report.cluster, report.batch) == ("c", BATCH)


def test_empty_report(spark):
    report = build_report(spark.createDataFrame([], RECORD_SCHEMA), "c", BATCH)
    assert report.db_aggregates == report.top_keys == report.top_prefixes == [] and not report.cluster_issues["codis_slot_skew"]


def test_page_and_exports(spark):
    rows = fixture(spark).withColumn("key", F.when(F.col("db") == 1, F.lit(b"</script>\xff,\"")).otherwise(F.col("key")))
    report = build_report(rows)
    page = render.render_page(report)
    data = page.split('type="application/json">')[1].split("</script>")[0]
    assert json.loads(data) == json.loads(report.to_json())
    with pytest.raises(ValueError):
        render.render_page(report, "<html></html>")
    keys = list(csv.DictReader(io.StringIO(render.keys_csv(report))))
    assert keys[0]["key_human"] == '</script>\\xff,"' and keys[0]["rdb_size_human"] == "300B" and len(keys) == 6
    assert [r["key_human"] for r in csv.DictReader(io.StringIO(render.keys_csv(report, "user", "key", False)))] == ["user:1", "user:1", "user:2", "user:2"]
    found = list(csv.DictReader(io.StringIO(render.prefixes_csv(report))))
    assert [int(r["total_size_bytes"]) for r in found] == sorted((int(r["total_size_bytes"]) for r in found), reverse=True)
    readable = json.loads(report.to_json(readable=True))
    assert readable["top_keys"][-1]["key"] == "user:1"


def test_several_batches_are_refused(spark):
    with pytest.raises(BatchError, match="several"):
        build_report(fixture(spark).union(fixture(spark, LATER)))
    with pytest.raises(BatchError, match="several"):
        check_consistency(fixture(spark).union(fixture(spark, cluster="d")))
    with pytest.raises(BatchError, match="no records"):
        check_consistency(spark.createDataFrame([], RECORD_SCHEMA))


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with pytest.raises(BatchError):
        store.find("c")
    with pytest.raises(BatchError):
        store.latest("c")
    store.write(fixture(spark, LATER), "c", LATER, compression="none")
    directory = store.write(fixture(spark), "c", BATCH, instances=["10.0.0.1:6379", "10.0.0.2:6379", "empty:1"])
    assert directory.endswith("cluster=c/batch=2024-01-01_00-00-00.000Z")
    assert store.latest("c") == LATER and store.find("c").endswith("batch=2024-02-01_00-00-00.000Z")
    assert store.find("c", BATCH) == store.find("c", "2024-01-01_00-00-00.000Z") == directory
    back = store.read("c", BATCH)
    assert back.schema.simpleString() == RECORD_SCHEMA.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, fixture(spark).collect()))
    assert store.raw().count() == 12
    assert ["empty:1" in r["instances"] for r in store.markers().orderBy("batch_ns").collect()] == [True, False]
    with pytest.raises(BatchError, match="exists"):
        store.write(fixture(spark), "c", BATCH)
    with pytest.raises(BatchError):
        store.write(fixture(spark), "c", "2024-03-01T00:00:00Z", compression="zip")
    with pytest.raises(BatchError, match="no batch"):
        store.find("c", "2025-01-01T00:00:00Z")


def test_failed_write_stays_invisible(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    bad = fixture(spark).withColumn("db", F.when(F.col("rdb_size") > 0, F.raise_error(F.lit("lost"))).cast("long"))
    with pytest.raises(Exception, match="lost"):
        store.write(bad, "c", BATCH)
    with pytest.raises(BatchError):
        store.find("c")
    assert store.markers().count() == 0
    assert store.write(fixture(spark), "c", BATCH)


@pytest.mark.parametrize("compression", ["zstd", "snappy", "none", "lz4", "gzip"])
def test_compressions_and_order(spark, tmp_path, compression):
    store = Store(spark, str(tmp_path))
    twice = fixture(spark).unionByName(fixture(spark).withColumn("rdb_size", F.col("rdb_size") + 7))
    store.write(twice, "c", BATCH, compression=compression, dedupe=F.col("rdb_size"))
    assert {r["rdb_size"] for r in store.read("c").collect()} == {107, 207, 307}  # the last of each key
    rows = []
    for path in store.files(store.find("c")):
        table = pq.ParquetFile(path).read().to_pylist()
        own = [(r["instance"], r["db"], r["key"]) for r in table]
        assert own == sorted(own)
        rows += own
    assert len(rows) == 6


def test_summary_and_footers(spark, tmp_path):
    """The report from the summary is that from the records; row groups are small, and pruned by key."""
    store = Store(spark, str(tmp_path))
    many = spark.range(30_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).cast("binary").alias("key"), (F.col("id") % 7).alias("rdb_size"))
    rows = fixture(spark).limit(1).drop("key", "rdb_size").crossJoin(many).select(*RECORD_SCHEMA.fieldNames())
    skewed = fixture(spark).withColumn("codis_slot", F.lit(5))
    store.write(rows.unionByName(skewed), "c", BATCH)
    assert build_report(store.read("c"), summary=store.summary("c")).to_json() == build_report(store.read("c")).to_json()
    assert build_report(store.read("c"), summary=store.summary("c")).cluster_issues["codis_slot_skew"]
    footers = store.footers("c").collect()
    assert sum(r["rows"] for r in footers) == 30_006 and max(r["most_rows"] for r in footers) <= batches.ROW_GROUP
    groups = [pq.ParquetFile(p).metadata.num_row_groups for p in store.files(store.find("c"))]
    assert sorted(groups) == sorted(r["row_groups"] for r in footers)
    assert store.summary("c").count() <= 30_006 / 50
    with pytest.raises(BatchError):
        store.summary("d")


def test_files_of_another_writer(spark, tmp_path):
    """Nanosecond times and unsigned counts."""
    folder = tmp_path / "cluster=c" / "batch=2024-01-01_00-00-00.000Z"
    folder.mkdir(parents=True)
    n = 3
    table = pa.table(
        {
            "cluster": ["c"] * n, "batch": pa.array([parse_rfc3339_ns(BATCH)] * n, pa.timestamp("ns", "UTC")), "instance": ["i:1"] * n,
            "db": pa.array([0] * n, pa.uint64()), "key": pa.array([b"a", b"b\xff", b"c"], pa.binary()), "type": ["string"] * n,
            "member_count": pa.array([1] * n, pa.uint64()), "rdb_size": pa.array([5] * n, pa.uint64()), "encoding": ["raw"] * n,
            "expire_at": pa.array([None, 1691999999000, None], pa.timestamp("ms", "UTC")), "idle_seconds": pa.array([None, 3, None], pa.uint64()),
            "freq": pa.array([5, None, None], pa.uint8()), "codis_slot": pa.array([1, None, None], pa.uint16()), "redis_slot": pa.array([None, 8192, None], pa.uint16()),
        }
    )
    pq.write_table(table, folder / "i-1.PARQUET")
    (folder / "notes.txt").write_text("x")
    rows = Store(spark, str(tmp_path)).read("c")
    assert rows.schema.simpleString() == RECORD_SCHEMA.simpleString()
    assert {r["batch_ns"] for r in rows.collect()} == {parse_rfc3339_ns(BATCH)}
    assert build_report(rows).batch == BATCH


def test_tables(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS kl")
    with pytest.raises(BatchError, match="do not exist"):
        batches.ensure_tables(spark, False, "kl")
    batches.append_to_tables(spark, fixture(spark), "c", BATCH, ["a"], create=True, database="kl")
    for _ in range(2):  # a second run replaces the first one's rows
        batches.append_to_tables(spark, fixture(spark, LATER), "c", LATER, ["a"], database="kl")
    assert spark.table("kl.records_raw").count() == 12 and spark.table("kl.records_view").count() == 6
    fixture(spark, "2024-03-01T00:00:00Z").select(*spark.table("kl.records_raw").columns).write.insertInto("kl.records_raw")  # not completed
    found = spark.sql("SELECT DISTINCT batch_ns FROM kl.records_view").collect()
    assert [r[0] for r in found] == [parse_rfc3339_ns(LATER)]
    spark.sql("DROP TABLE kl.import_batches_completed")
    with pytest.raises(BatchError, match="missing: import_batches_completed"):
        batches.ensure_tables(spark, True, "kl")
    spark.sql("DROP DATABASE kl CASCADE")


def test_stream_of_completed_batches(spark, tmp_path):
    store, seen = Store(spark, str(tmp_path / "store")), []
    store.write(fixture(spark), "c", BATCH)
    run = lambda: report_new_batches(spark, store, str(tmp_path / "checkpoint"), lambda r: seen.append(r.batch)).awaitTermination()
    run()
    store.write(fixture(spark, LATER), "c", LATER)
    run()
    run()
    assert seen == [BATCH, LATER]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    dump = tmp_path / "dump.rdb"
    dump.write_bytes(b.full_dump())
    monkeypatch.setenv("KEYLOOM_CLUSTER", "shop")
    args = ["dump", "from-file", "--path", str(dump), "--instance", "1.1.1.1:1", "--batch", BATCH, "into-parquet", "--dir", str(tmp_path / "store")]
    assert cli.main(args) == 0
    for kind in ("html", "json", "prefixes-csv", "keys-csv"):
        out = tmp_path / f"out.{kind}"
        assert cli.main(["report", "--dir", str(tmp_path / "store"), "--output", str(out), "--format", kind]) == 0
        assert "string" in out.read_text() or kind == "prefixes-csv"
    assert cli.main(["misc", "schema"]) == 0
    assert "CREATE VIEW" in capsys.readouterr().out
    for bad in (["dump", "from-file", "--path", "x", "--instance", "i", "--batch", "yesterday", "into-parquet", "--dir", "d"], ["dump", "--concurrency", "0", "from-file"]):
        with pytest.raises(SystemExit):
            cli.main(bad)
