import random

import pytest
from pyspark.sql import functions as F

from keyloom.operators import aggregates, prefixes


def keyed(spark, rows):
    return spark.createDataFrame([(bytearray(k), s) for k, s in rows], "key binary, rdb_size long")


def brute_prefixes(rows, divisor):
    least = max(1, sum(s for _, s in rows) // divisor)
    sums = {}
    for key, size in rows:
        for i in range(1, len(key) + 1):
            n, total = sums.get(key[:i], (0, 0))
            sums[key[:i]] = n + 1, total + size
    kept = {p: v for p, v in sums.items() if v[1] >= least}
    out = [(p, t, n) for p, (n, t) in kept.items() if not any(q[:-1] == p and kept[q][0] == n for q in kept if len(q) == len(p) + 1)]
    return sorted(out)


def rows_of(frame):
    return [(bytes(r["prefix"]), r["total_size"], r["key_count"]) for r in frame.collect()]


@pytest.mark.parametrize("seed", range(6))
def test_prefix_plans_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    alphabet = [b"a", b"b", b":", b"\xff", b"\x00"][: rnd.randint(2, 5)]
    rows = [(b"".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))), rnd.randint(0, 50)) for _ in range(80)]
    rows += [(b"a very long and lonely key:" + b"x" * 30, 500)]
    frame = keyed(spark, rows)
    for divisor in (3, 100):
        want = brute_prefixes(rows, divisor)
        assert rows_of(prefixes.by_explosion(frame, divisor)) == want
        assert rows_of(prefixes.by_blocks(frame, divisor, block=rnd.choice([1, 3, 8]))) == want
        if divisor == 3:
            assert rows_of(prefixes.by_descent(frame, divisor)) == want


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("f", 100, 3), ("fo", 100, 3), ("foo", 100, 3)], ["foo"]),
        ([("f", 100, 3), ("fo", 50, 2), ("foo", 30, 1)], ["f", "fo", "foo"]),
        ([("f", 100, 3), ("fo", 30, 1), ("foo", 30, 1)], ["f", "foo"]),
    ],
)
def test_nested_prefixes(spark, rows, want):
    frame = spark.createDataFrame([(bytearray(p.encode()), t, n) for p, t, n in rows], prefixes.PREFIX_SCHEMA)
    for f in (prefixes.drop_shorter_equals, prefixes.deduplicate_nested):
        assert [bytes(r["prefix"]).decode() for r in f(frame).collect()] == want


def test_no_keys(spark):
    assert rows_of(prefixes.by_blocks(keyed(spark, []))) == rows_of(prefixes.by_explosion(keyed(spark, []))) == []


def test_flame_parents(spark):
    frame = spark.createDataFrame([(bytearray(p), t, 1) for p, t in ((b"a", 10), (b"a:b", 6), (b"a:b:c", 2), (b"z", 1))], prefixes.PREFIX_SCHEMA)
    found = {bytes(r["prefix"]): (r["parent"] and bytes(r["parent"]), r["self_size"]) for r in prefixes.with_parents(frame).collect()}
    assert found == {b"a": (None, 4), b"a:b": (b"a", 4), b"a:b:c": (b"a:b", 2), b"z": (None, 1)}


def test_top_keys_have_full_order(spark):
    rows = [(bytearray(b"k%d" % (i % 3)), 10, 1, "string", f"i{i}", 0, "raw", None) for i in range(9)]
    frame = spark.createDataFrame(rows, "key binary, rdb_size long, member_count long, type string, instance string, db long, encoding string, expire_at timestamp")
    assert [(bytes(r["key"]), r["instance"]) for r in aggregates.top_keys(frame, 4).collect()] == [(b"k0", "i0"), (b"k0", "i3"), (b"k0", "i6"), (b"k1", "i1")]


def test_big_key_limits_are_strict(spark):
    rows = [("string", 1 << 20), ("string", (1 << 20) + 1), ("hash", 1 << 30), ("hash", (1 << 30) + 1), ("hash", (1 << 30) + 5)]
    frame = spark.createDataFrame([(bytearray(b"k"), s, t, "i", 0) for t, s in rows], "key binary, rdb_size long, type string, instance string, db long")
    assert [(r["type"], r["rdb_size"]) for r in aggregates.big_keys_by_type(frame).collect()] == [("hash", (1 << 30) + 5), ("string", (1 << 20) + 1)]
    assert aggregates.all_big_keys(frame).count() == 3


def test_skew(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (None, "a"), (None, "b")], "codis_slot int, instance string")
    assert [tuple(r) for r in aggregates.skewed_slots(frame, "codis_slot").collect()] == [(2, 2)]
    assert aggregates.has_skew(frame, "codis_slot").first()[0]
    assert not aggregates.has_skew(frame.where("codis_slot = 1"), "codis_slot").first()[0]


def test_plans(spark):
    """Filters and columns reach the scan, and top keys are no full sort."""
    frame = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").selectExpr(
        "l_orderkey as rdb_size", "l_suppkey as db", "l_returnflag as type"
    )
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    narrow = plan(frame.where("db = 1").select("rdb_size"))
    assert "EqualTo(l_suppkey,1)" in narrow and "l_returnflag" not in narrow
    assert "TakeOrderedAndProject" in plan(frame.orderBy(F.desc("rdb_size")).limit(100))


def test_nested_dedupe_query_has_prefixes_to_drop(spark, monkeypatch):
    """The query's operator gets chains of prefixes with the same keys, not the list that has none left."""
    from keyloom.plans import registry

    given, plain = [], prefixes.deduplicate_nested
    monkeypatch.setattr(prefixes, "deduplicate_nested", lambda found: given.append(found) or plain(found))
    left = registry.queries()["prefix_nested_dedupe"](spark, "/root/testdata/sf0.001")
    assert given[0].count() > left.count() > 0
