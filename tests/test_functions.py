import math

import pytest
from pyspark.sql import functions as F

from keyloom.functions import formatting as f


@pytest.mark.parametrize(
    ("value", "text"),
    [(0, "0"), (999, "999"), (1000, "1.00K"), (999_999, "999.99K"), (1.5e6, "1.50M"), (1e9, "1.00B"), (1e15, "1000.00T"), (math.nan, "NaN"),
     (math.inf, "inf"), (-math.inf, "-inf"), (-1500, "-1.50K")],
)
def test_numbers(value, text):
    assert f.format_number(value) == text


SIZES = [(0, "0B"), (1023, "1023B"), (1024, "1.00KB"), (1536, "1.50KB"), (5_767_168, "5.50MB"), (1024**5, "1.00PB"), (1024**4 * 3, "3.00TB"), (1157, "1.13KB")]


def test_sizes(spark):
    for size, text in SIZES:
        assert f.format_bytesize(size) == text
    frame = spark.createDataFrame([(s,) for s, _ in SIZES] + [(s,) for s in range(1000, 9000, 7)], "n long")
    for r in frame.select("n", f.bytesize_column(F.col("n")).alias("t")).collect():
        assert r["t"] == f.format_bytesize(r["n"])


def test_urls():
    assert f.sanitize_url("http://u:p@h:1/x?database=d") == "http://u:***@h:1/x?database=d"
    assert f.sanitize_url("http://h:1/x") == "http://h:1/x"
    assert f.sanitize_url("nonsense") == f.sanitize_url("http://h:x/") == "<invalid-url>"


def test_times():
    ns = f.parse_rfc3339_ns("2023-08-14T07:54:56.123456789Z")
    assert ns == 1691999696123456789
    assert f.format_rfc3339_ns(ns) == "2023-08-14T07:54:56.123456789Z"
    assert f.batch_slug(ns) == "2023-08-14_07-54-56.123Z"
    assert f.parse_rfc3339_ns("2023-08-14T09:54:56+02:00") == ns // 10**9 * 10**9
    assert f.format_rfc3339_ns(0) == "1970-01-01T00:00:00Z" and f.format_rfc3339_ns(500_000_000) == "1970-01-01T00:00:00.5Z"
    for bad in ("2023-08-14", "x", "2023-08-14T07:54:56", "2023-13-14T07:54:56Z"):
        with pytest.raises(ValueError):
            f.parse_rfc3339_ns(bad)


def test_names_and_keys(spark):
    assert f.instance_file("10.0.0.1:6379 x") == "10.0.0.1-6379_x"
    assert f.report_name("c", "2024-01-01T00:00:00+00:00") == "rdb_report_c_2024-01-01T00-00-00_00-00.html"
    assert f.escape_ascii(b"a\x00\n\"\xff") == 'a\\x00\\n\\"\\xff'
    assert f.display_key("é".encode()) == "é" and f.display_key(b"a\xff") == "a\\xff"
    frame = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"a\xff"),)], "key binary")
    assert [r[0] for r in frame.select(f.display_key_column(F.col("key"))).collect()] == ["é", "61ff"]


PREFIXES = [
    (b"user:profile:active:1", b"user:profile:active:2", b"user:profile:active:"), (b"user:session:web:123", b"user:session:api:456", b"user:session:"),
    (b"user123", b"user456", b"user"), (b"abc", b"def", b""), (b"", b"any", b""), (b"\x00\x01\x02\x03\x04", b"\x00\x01\x02\xff\xfe", b"\x00\x01\x02"),
    (b"same", b"same", b"same"),
]


def test_common_prefixes(spark):
    frame = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b, _ in PREFIXES], "a binary, b binary")
    found = [bytes(r[0]) for r in frame.select(f.common_prefix_column(F.col("a"), F.col("b"))).collect()]
    assert found == [f.common_prefix(a, b) for a, b, _ in PREFIXES] == [p for _, _, p in PREFIXES]
