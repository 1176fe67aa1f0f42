"""Every query of the engine against its DuckDB oracle."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from keyloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, oracle, name):
    frame = registry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    clean = lambda v: round(v, 9) if isinstance(v, float) else v
    found = sorted((tuple(clean(r[c]) for c in columns) for r in frame.collect()), key=repr)
    rows = oracle.sql(registry.oracle_sql()[name])
    at = [rows.columns.index(c) for c in columns]
    assert found == sorted((tuple(clean(r[i]) for i in at) for r in rows.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.oracle_sql()) == set(registry.queries())


@pytest.fixture(scope="module")
def odd_pages(tmp_path_factory):
    """The small tables with pages that share an address, short and long, and addresses of any length."""
    folder = tmp_path_factory.mktemp("odd")
    for t in TABLES:
        if t != "pages":
            (folder / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    pages = pq.read_table(f"{SF}/pages.parquet")
    urls = ["http://a.example/twice"] * 3 + [f"http://a.example/{'x' * n}" for n in (40, 41, 50, 60, 200, 200, 17_000, 17_000)]
    html = [None, "first", "second " * 10, "", "b", "c" * 70, "d", "e", "f" * 20_000, "g", "h"]
    more = {f.name: pa.array(urls if f.name == "url" else html if f.name == "html" else range(10**6, 10**6 + len(urls)), f.type) for f in pages.schema}
    pq.write_table(pa.concat_tables([pages, pa.table(more, schema=pages.schema)]), folder / "pages.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["formatted_keys", "rdb_file_scan"])
def test_long_and_shared_addresses(spark, odd_pages, name):
    with duckdb.connect() as connection:
        for t in TABLES:
            connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{odd_pages}/{t}.parquet'")
        rows = connection.sql(entry.oracle_sql()[name])
        columns, want = rows.columns, rows.fetchall()
    found = entry.queries()[name](spark, odd_pages).select(*columns).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
