"""A deterministic projection of the star-schema test tables to the record model, in Spark and in DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLUSTER, BATCH, OLD_BATCH = "demo", "2024-01-01T00:00:00Z", "2023-12-31T00:00:00Z"
#: Smaller limits than production's, so that the test tables have big keys.
BIG_STRING, BIG_OTHER = 3000, 1500

SQL = f"""
WITH parts AS (
  SELECT 'string' AS type, 'raw' AS encoding, url AS key, CAST(length(html) AS BIGINT) AS rdb_size, CAST(1 AS BIGINT) AS member_count,
         CAST(page_id AS BIGINT) AS n, CAST(page_id % 3 AS BIGINT) AS db, CAST(NULL AS TIMESTAMP) AS expire_at FROM pages
  UNION ALL
  SELECT 'string', 'raw', 'doc:' || lang || ':' || source || ':' || CAST(doc_id AS VARCHAR), CAST(n_chars AS BIGINT), 1, doc_id, doc_id % 3, NULL FROM documents
  UNION ALL
  SELECT 'list', 'quick_list2', 'conv:' || CAST(conv_id AS VARCHAR), CAST(sum(length(text)) AS BIGINT), count(*), conv_id, 0, NULL FROM conversations GROUP BY conv_id
  UNION ALL
  SELECT 'hash', 'list_pack', 'order:' || o_orderstatus || ':' || o_orderpriority || ':' || CAST(o_orderkey AS VARCHAR),
         CAST(floor(o_totalprice / 1000) AS BIGINT), 1, o_custkey, 1, NULL FROM orders
  UNION ALL
  SELECT 'zset', 'skip_list', 'supp:' || CAST(l_suppkey AS VARCHAR), count(*) * 16, count(*), l_suppkey, 2, NULL FROM lineitem GROUP BY l_suppkey
  UNION ALL
  SELECT 'stream', 'list_packs3', 'ev:' || event_type || ':' || CAST(user_id AS VARCHAR), CAST(sum(length(props)) AS BIGINT), count(*), user_id, 0, max(ts)
  FROM events GROUP BY user_id, event_type
),
records AS (
  SELECT '{CLUSTER}' AS cluster, '{BATCH}' AS batch, 'node-' || CAST(n % 4 AS VARCHAR) AS instance, db, key, type, member_count, rdb_size, encoding,
         expire_at, CAST((n // 4) % 1024 AS INTEGER) AS codis_slot, CAST(CASE WHEN type = 'hash' THEN n % 4 ELSE NULL END AS INTEGER) AS redis_slot
  FROM parts WHERE key IS NOT NULL AND rdb_size IS NOT NULL
)
"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one batch: key is binary, batch is its RFC 3339 text."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = lambda c: F.col(c).cast("string")
    never = F.lit(None).cast("timestamp_ntz")
    one = F.lit(1)

    def part(df: DataFrame, kind, encoding, key, size, members, n, db, expire=never) -> DataFrame:
        return df.select(
            F.lit(kind).alias("type"), F.lit(encoding).alias("encoding"), key.cast("binary").alias("key"), size.cast("long").alias("rdb_size"),
            members.cast("long").alias("member_count"), n.cast("long").alias("n"), db.cast("long").alias("db"), expire.alias("expire_at"),
        )

    talks = read("conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("size"), F.count("*").alias("members"))
    sold = read("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("members"))
    done = read("events").groupBy("user_id", "event_type").agg(F.sum(F.length("props")).alias("size"), F.count("*").alias("members"), F.max("ts").alias("last"))
    c = F.col
    order = F.concat(F.lit("order:"), c("o_orderstatus"), F.lit(":"), c("o_orderpriority"), F.lit(":"), text("o_orderkey"))
    doc = F.concat(F.lit("doc:"), c("lang"), F.lit(":"), c("source"), F.lit(":"), text("doc_id"))
    parts = [
        part(read("pages"), "string", "raw", c("url"), F.length("html"), one, c("page_id"), c("page_id") % 3),
        part(read("documents"), "string", "raw", doc, c("n_chars"), one, c("doc_id"), c("doc_id") % 3),
        part(talks, "list", "quick_list2", F.concat(F.lit("conv:"), text("conv_id")), c("size"), c("members"), c("conv_id"), F.lit(0)),
        part(read("orders"), "hash", "list_pack", order, F.floor(c("o_totalprice") / 1000), one, c("o_custkey"), one),
        part(sold, "zset", "skip_list", F.concat(F.lit("supp:"), text("l_suppkey")), c("members") * 16, c("members"), c("l_suppkey"), F.lit(2)),
        part(
            done, "stream", "list_packs3", F.concat(F.lit("ev:"), c("event_type"), F.lit(":"), text("user_id")), c("size"), c("members"), c("user_id"),
            F.lit(0), c("last").cast("timestamp_ntz"),
        ),
    ]
    every = reduce(DataFrame.unionByName, parts).where("key is not null and rdb_size is not null")
    return every.select(
        F.lit(CLUSTER).alias("cluster"), F.lit(BATCH).alias("batch"), F.concat(F.lit("node-"), (c("n") % 4).cast("string")).alias("instance"), "db", "key",
        "type", "member_count", "rdb_size", "encoding", "expire_at", F.expr("n div 4 % 1024").cast("int").alias("codis_slot"),
        F.when(c("type") == "hash", c("n") % 4).cast("int").alias("redis_slot"),
    )


def markers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(CLUSTER, OLD_BATCH), (CLUSTER, BATCH), ("other", OLD_BATCH)], "cluster string, batch string")


MARKERS_SQL = f"markers AS (SELECT * FROM (VALUES ('{CLUSTER}', '{OLD_BATCH}'), ('{CLUSTER}', '{BATCH}'), ('other', '{OLD_BATCH}')) m(cluster, batch))"
