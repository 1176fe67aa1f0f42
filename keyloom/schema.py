"""The record model: one row of metadata per key of a snapshot."""

from __future__ import annotations

from pyspark.sql import types as T

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("cluster", T.StringType(), False),
        T.StructField("batch", T.TimestampType(), False),
        T.StructField("instance", T.StringType(), False),
        T.StructField("db", T.LongType(), False),
        T.StructField("key", T.BinaryType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("member_count", T.LongType(), True),  # null for modules
        T.StructField("rdb_size", T.LongType(), False),
        T.StructField("encoding", T.StringType(), False),
        T.StructField("expire_at", T.TimestampType(), True),
        T.StructField("idle_seconds", T.LongType(), True),
        T.StructField("freq", T.ShortType(), True),
        T.StructField("codis_slot", T.IntegerType(), True),
        T.StructField("redis_slot", T.IntegerType(), True),
        # The batch to the nanosecond, which a Spark timestamp cannot hold.
        T.StructField("batch_ns", T.LongType(), True),
    ]
)

MARKER_SCHEMA = T.StructType(
    [
        T.StructField("cluster", T.StringType(), False),
        T.StructField("batch", T.TimestampType(), False),
        T.StructField("batch_ns", T.LongType(), True),
        T.StructField("instances", T.ArrayType(T.StringType()), True),
    ]
)

# Value types and encodings by the snapshot's type byte (fixed values).
TYPES = {
    0: "string", 1: "list", 2: "set", 3: "zset", 4: "hash", 5: "zset", 7: "module", 9: "hash", 10: "list", 11: "set", 12: "zset",
    13: "hash", 14: "list", 15: "stream", 16: "hash", 17: "zset", 18: "list", 19: "stream", 20: "set", 21: "stream", 24: "hash", 25: "hash",
}
ENCODINGS = {
    1: "list", 2: "raw", 3: "skip_list", 4: "raw", 5: "skip_list", 7: "module", 9: "zip_map", 10: "zip_list", 11: "int_set", 12: "zip_list",
    13: "zip_list", 14: "quick_list", 15: "list_packs", 16: "list_pack", 17: "list_pack", 18: "quick_list2", 19: "list_packs2",
    20: "list_pack", 21: "list_packs3", 24: "metadata", 25: "list_pack_ex",
}

#: A key over its type's limit is a big key (fixed values).
BIG_STRING, BIG_OTHER = 1 << 20, 1 << 30
#: The largest millisecond that a record may expire at: the end of the year 9999.
MAX_EXPIRE_MS = 253_402_300_799_999
