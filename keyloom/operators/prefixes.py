"""Significant key prefixes: those that hold a hundredth of all bytes or more.

A prefix is kept if its keys' total size is at least max(1, total div 100); of nested prefixes with the same keys only
the longest is kept; the empty prefix never is. Three plans give the same rows:

* ``by_blocks`` (the report's) expands a few bytes of prefix length at a time, and only below prefixes that were still
  significant. Significant prefixes of one length are disjoint, so at most 100 pass (199 where the threshold is floored
  to small totals): that bound is why they may be broadcast.
* ``by_explosion`` expands every prefix of every key in one plan, for short keys.
* ``by_descent`` carries one prefix length a key and grows all of them level by level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType
from pyspark.sql.window import Window

DIVISOR = 100
PREFIX_SCHEMA = StructType([StructField("prefix", BinaryType()), StructField("total_size", LongType()), StructField("key_count", LongType())])


def threshold(total: int, divisor: int = DIVISOR) -> int:
    return max(1, total // divisor)


def _sums(prefixes: DataFrame) -> DataFrame:
    return prefixes.groupBy("prefix").agg(F.sum("rdb_size").alias("total_size"), F.count("*").alias("key_count"))


def drop_shorter_equals(found: DataFrame) -> DataFrame:
    """Of a chain of prefixes with the same keys, the longest.

    ``found`` has every significant prefix, so a chain has no gaps: a prefix goes if one byte more has as many keys.
    """
    longer = found.where(F.length("prefix") > 1).select(
        F.substring("prefix", F.lit(1), F.length("prefix") - 1).alias("prefix"), "key_count"
    )
    return found.join(longer, ["prefix", "key_count"], "left_anti").select("prefix", "total_size", "key_count").orderBy("prefix")


def deduplicate_nested(found: DataFrame) -> DataFrame:
    """As above for any list of prefixes, gaps included: a prefix goes if a listed extension has as many keys."""
    longer = found.select(F.col("prefix").alias("other"), F.col("key_count").alias("key_count"))
    nested = (F.length("other") > F.length("prefix")) & F.startswith(F.col("other"), F.col("prefix"))
    return found.join(longer, (found["key_count"] == longer["key_count"]) & nested, "left_anti").orderBy("prefix")


def _expand(records: DataFrame, low: int, high: int | None) -> DataFrame:
    """A row for each prefix of ``low`` to ``high`` bytes; keys shorter than ``low`` give none."""
    last = F.length("key") if high is None else F.least(F.length("key"), F.lit(high))
    return (
        records.select("key", "rdb_size")
        .where(F.length("key") >= low)
        .select("rdb_size", F.explode(F.transform(F.sequence(F.lit(low), last), lambda i: F.substring("key", F.lit(1), i))).alias("prefix"))
    )


def by_explosion(records: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    least = threshold(records.agg(F.sum("rdb_size")).first()[0] or 0, divisor)
    return drop_shorter_equals(_sums(_expand(records, 1, None)).where(F.col("total_size") >= least))


def by_blocks(records: DataFrame, divisor: int = DIVISOR, block: int = 8) -> DataFrame:
    return drop_shorter_equals(significant(records, divisor, block))


def significant(records: DataFrame, divisor: int = DIVISOR, block: int = 8) -> DataFrame:
    """Every significant prefix, shorter ones with the same keys included."""
    spark = records.sparkSession
    least = threshold(records.agg(F.sum("rdb_size")).first()[0] or 0, divisor)
    found: list[tuple] = []
    frontier: list[bytes] | None = None
    low = 1
    while frontier is None or frontier:
        below = records
        if frontier is not None:
            ends = spark.createDataFrame([(bytearray(p),) for p in frontier], StructType([StructField("prefix", BinaryType())]))
            below = records.join(F.broadcast(ends), F.substring("key", F.lit(1), F.lit(low - 1)) == F.col("prefix"), "left_semi")
        sums = _sums(_expand(below, low, low + block - 1)).where(F.col("total_size") >= least).collect()
        found += [(r["prefix"], r["total_size"], r["key_count"]) for r in sums]
        frontier = [bytes(r["prefix"]) for r in sums if len(r["prefix"]) == low + block - 1]
        low += block
    return spark.createDataFrame(found, PREFIX_SCHEMA)


def by_descent(records: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """Level by level: partition the keys below each open prefix by their next byte, keep the significant parts, and let
    each part's common prefix (of its least and greatest key) be the next open prefix."""
    from keyloom.functions.formatting import common_prefix

    spark = records.sparkSession
    total = records.agg(F.sum("rdb_size")).first()[0] or 0
    least = threshold(total, divisor)
    found: list[tuple] = []
    open_: list[bytes] = [b""]
    schema = StructType([StructField("open", BinaryType())])
    while open_:
        lengths = sorted({len(p) for p in open_})
        ends = spark.createDataFrame([(bytearray(p),) for p in open_], schema)
        tails = F.transform(F.array(*map(F.lit, lengths)), lambda n: F.substring("key", F.lit(1), n))
        below = records.select("key", "rdb_size", F.explode(tails).alias("open")).join(F.broadcast(ends), "open")
        parts = (
            below.where(F.length("key") > F.length("open"))
            .groupBy(F.substring("key", F.lit(1), F.length("open") + 1).alias("part"))
            .agg(F.sum("rdb_size").alias("total_size"), F.count("*").alias("key_count"), F.min("key").alias("low"), F.max("key").alias("high"))
            .where(F.col("total_size") >= least)
            .collect()
        )
        open_ = []
        for p in parts:
            prefix = common_prefix(bytes(p["low"]), bytes(p["high"]))
            found.append((bytearray(prefix), p["total_size"], p["key_count"]))
            open_.append(prefix)
    return spark.createDataFrame(found, PREFIX_SCHEMA).orderBy("prefix")


def partitions(records: DataFrame, prefix: bytes) -> DataFrame:
    """Keys below a prefix by their next byte."""
    below = records.where(F.startswith(F.col("key"), F.lit(prefix))) if prefix else records
    part = F.substring("key", F.lit(1), F.lit(len(prefix) + 1))
    return below.groupBy(part.alias("prefix")).agg(
        F.sum("rdb_size").alias("total_size"), F.count("*").alias("key_count"), F.min("key").alias("min_key"), F.max("key").alias("max_key")
    )


def with_parents(found: DataFrame) -> DataFrame:
    """(prefix, total_size, key_count, parent, self_size): the flame graph. ``found`` has at most a few hundred rows."""
    other = found.select(F.col("prefix").alias("parent"))
    inside = (F.length("parent") < F.length("prefix")) & F.startswith(F.col("prefix"), F.col("parent"))
    nearest = Window.partitionBy("prefix").orderBy(F.length("parent").desc_nulls_last())
    linked = found.join(F.broadcast(other), inside, "left").withColumn("rank", F.row_number().over(nearest)).where("rank = 1").drop("rank")
    children = linked.where("parent is not null").groupBy(F.col("parent").alias("prefix")).agg(F.sum("total_size").alias("below"))
    return linked.join(children, "prefix", "left").select(
        "prefix", "total_size", "key_count", "parent", (F.col("total_size") - F.coalesce("below", F.lit(0))).alias("self_size")
    )
