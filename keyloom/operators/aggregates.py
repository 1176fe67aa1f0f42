"""Aggregates, top keys, big keys, slot skew, views and ordered merges over records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.schema import BIG_OTHER, BIG_STRING

TOP = 100


def _totals(records: DataFrame, *by: str) -> DataFrame:
    return records.groupBy(*by).agg(F.count("*").alias("key_count"), F.sum("rdb_size").alias("total_size"))


def by_db(records: DataFrame) -> DataFrame:
    return _totals(records, "db").orderBy("db")


def by_type(records: DataFrame) -> DataFrame:
    return _totals(records, "type").withColumnRenamed("type", "data_type").orderBy(F.desc("total_size"), "data_type")


def by_instance(records: DataFrame) -> DataFrame:
    return _totals(records, "instance").orderBy(F.desc("total_size"), "instance")


def grand_total(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("key_count"), F.coalesce(F.sum("rdb_size"), F.lit(0)).alias("total_size"))


def summary(records: DataFrame) -> DataFrame:
    """Counts and sizes by (db, type, instance): one pass from which every total follows."""
    return _totals(records, "db", "type", "instance")


def overview(records: DataFrame) -> DataFrame:
    """Totals and the numbers of instances and databases, from partial sums by (instance, db): no distinct over rows."""
    parts = _totals(records, "instance", "db")
    return parts.agg(
        F.coalesce(F.sum("total_size"), F.lit(0)).alias("total_size"),
        F.coalesce(F.sum("key_count"), F.lit(0)).alias("key_count"),
        F.count_distinct("instance").alias("instances"),
        F.count_distinct("db").alias("databases"),
    )


def shares(records: DataFrame, column: str) -> DataFrame:
    """Totals by a column with their share of all bytes."""
    every = F.sum("total_size").over(Window.partitionBy())
    # The window sees one row a value, not one a key.
    return _totals(records, column).withColumn("share", F.col("total_size") / every).orderBy(F.desc("total_size"), column)


def top_keys(records: DataFrame, n: int = TOP) -> DataFrame:
    """The largest keys; ties by key, instance and database."""
    columns = ("key", "rdb_size", "member_count", "type", "instance", "db", "encoding", "expire_at")
    return records.select(*columns).orderBy(F.desc("rdb_size"), "key", "instance", "db").limit(n)


def is_big(string_limit: int = BIG_STRING, other_limit: int = BIG_OTHER) -> Column:
    return ((F.col("type") == "string") & (F.col("rdb_size") > string_limit)) | ((F.col("type") != "string") & (F.col("rdb_size") > other_limit))


def all_big_keys(records: DataFrame, string_limit: int = BIG_STRING, other_limit: int = BIG_OTHER) -> DataFrame:
    return records.where(is_big(string_limit, other_limit)).select("key", "rdb_size", "type", "instance", "db")


def big_keys_by_type(records: DataFrame, string_limit: int = BIG_STRING, other_limit: int = BIG_OTHER) -> DataFrame:
    """The largest big key of each type; a group limit keeps one candidate a type and task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("rdb_size"), "key", "instance", "db"))
    big = all_big_keys(records, string_limit, other_limit)
    return big.withColumn("rank", rank).where("rank = 1").drop("rank").orderBy(F.desc("rdb_size"), "type")


def skewed_slots(records: DataFrame, slot: str) -> DataFrame:
    """Slots whose keys are on more than one instance.

    Distinct (slot, instance) pairs are combined in the readers; there are at most slots times instances of them.
    """
    pairs = records.where(F.col(slot).isNotNull()).select(slot, "instance").distinct()
    return pairs.groupBy(slot).agg(F.count("*").alias("instances")).where("instances > 1")


def has_skew(records: DataFrame, slot: str) -> DataFrame:
    return skewed_slots(records, slot).limit(1).agg((F.count("*") > 0).alias("skewed"))


def latest_completed(records: DataFrame, markers: DataFrame, batch: str = "batch") -> DataFrame:
    """Records of each cluster's last completed batch. There is one marker a cluster, so the join moves no records."""
    last = markers.groupBy("cluster").agg(F.max(batch).alias(batch))
    return records.join(last, ["cluster", batch], "left_semi")


def completed_batch(records: DataFrame, markers: DataFrame, cluster: str, batch: Column, column: str = "batch") -> DataFrame:
    """Records of one batch, latest or not, if it is completed."""
    done = markers.where((F.col("cluster") == cluster) & (F.col(column) == batch)).select("cluster", column).distinct()
    return records.where((F.col("cluster") == cluster) & (F.col(column) == batch)).join(done, ["cluster", column], "left_semi")


def deduplicate(records: DataFrame, order: Column) -> DataFrame:
    """The last row of each (cluster, batch, instance, db, key): the greatest by ``order``, combined before the shuffle."""
    keys = ["cluster", "batch", "instance", "db", "key"]
    rest = [c for c in records.columns if c not in keys]
    last = F.max_by(F.struct(*rest), order)
    return records.groupBy(*keys).agg(last.alias("last")).select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest]).select(*records.columns)


def merge_sorted(parts: list[DataFrame], *by: str) -> DataFrame:
    """All parts in one order."""
    return reduce(DataFrame.unionByName, parts).orderBy(*by)


def expired(records: DataFrame, now: Column) -> DataFrame:
    return records.where(F.coalesce(now > F.col("expire_at"), F.lit(False)))


def whitelist_violations(records: DataFrame, whitelist: list[str], separator: str = ":") -> DataFrame:
    """(prefix, key) of keys whose part up to the first separator is not listed."""
    text = F.col("key").cast("string")
    prefix = F.substring(text, F.lit(1), F.instr(text, separator))
    return records.select(prefix.alias("prefix"), text.alias("key")).where(~F.col("prefix").isin(*whitelist))


def whitelist_counts(records: DataFrame, pattern: str) -> DataFrame:
    """Keys by what the pattern's first group matches in them."""
    found = F.regexp_extract(F.col("key").cast("string"), pattern, 1)
    return records.select(found.alias("prefix")).where("prefix != ''").groupBy("prefix").agg(F.count("*").alias("key_cnt")).orderBy(F.desc("key_cnt"), "prefix")
