"""The diagnostic report over the records of one batch, whatever they were read from."""

from __future__ import annotations

import base64
import json
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.formatting import display_key, format_rfc3339_ns
from keyloom.operators import aggregates, prefixes
from keyloom.schema import BIG_OTHER, BIG_STRING
from keyloom.sinks.batches import check_consistency


@dataclass
class ReportData:
    cluster: str
    batch: str
    db_aggregates: list[dict] = field(default_factory=list)
    type_aggregates: list[dict] = field(default_factory=list)
    instance_aggregates: list[dict] = field(default_factory=list)
    top_keys: list[dict] = field(default_factory=list)
    top_prefixes: list[dict] = field(default_factory=list)
    cluster_issues: dict = field(default_factory=lambda: {"big_keys": [], "codis_slot_skew": False, "redis_cluster_slot_skew": False})

    def to_json(self, readable: bool = False) -> str:
        """``readable`` adds decoded keys beside the encoded ones, as the page's own export has them."""
        data = asdict(self)
        if readable:
            for row in data["top_keys"]:
                row["key"] = display_key(base64.b64decode(row["key_base64"]))
            for row in data["top_prefixes"]:
                row["prefix"] = display_key(base64.b64decode(row["prefix_base64"]))
        return json.dumps(data, indent=2, ensure_ascii=False, sort_keys=True)


def _encoded(key: bytes) -> str:
    return base64.b64encode(bytes(key)).decode()


def _time(value: datetime | None) -> str | None:
    if value is None:
        return None
    return format_rfc3339_ns(int(value.replace(tzinfo=value.tzinfo or timezone.utc).timestamp() * 10**6) * 1000)


def build_report(
    records: DataFrame, cluster: str | None = None, batch: str | None = None, big_string: int = BIG_STRING, big_other: int = BIG_OTHER,
    summary: DataFrame | None = None,
) -> ReportData:
    """All parts of the report. Records must be of one batch; without any, ``cluster`` and ``batch`` name an empty report.

    ``summary`` is what the store keeps beside a batch: totals, top keys and slot skew then come from it, and only prefixes and big
    keys from the records. The columns that the parts need are kept once, spilling to disk; every part then collects at most a few
    hundred rows.
    """
    needed = records.select(
        "cluster", "batch", "batch_ns", "instance", "db", "key", "type", "member_count", "rdb_size", "encoding", "expire_at", "codis_slot", "redis_slot"
    ).persist(StorageLevel.DISK_ONLY)
    try:
        if needed.isEmpty():
            return ReportData(cluster or "", batch or "")
        found, ns = check_consistency(needed)
        out = ReportData(cluster or found, batch or format_rfc3339_ns(ns))
        # One pass gives every total: the summary has a row a (db, type, instance).
        kept = lambda part: summary.where(F.col("part") == part)
        parts = (aggregates.summary(needed).withColumnRenamed("total_size", "rdb_size") if summary is None else kept("totals")).persist()
        totals = lambda c: parts.groupBy(c).agg(F.sum("key_count").alias("key_count"), F.sum("rdb_size").alias("total_size"))
        rows = lambda df: [r.asDict() for r in df.collect()]
        out.db_aggregates = rows(totals("db").orderBy("db"))
        out.type_aggregates = rows(totals("type").withColumnRenamed("type", "data_type").orderBy(F.desc("total_size"), "data_type"))
        out.instance_aggregates = rows(totals("instance").orderBy(F.desc("total_size"), "instance"))
        parts.unpersist()
        top = needed if summary is None else kept("top")
        for r in rows(aggregates.top_keys(top)):
            key, expires = r.pop("key"), r.pop("expire_at")
            out.top_keys.append({"key_base64": _encoded(key), **r, "member_count": r["member_count"] or 0, "expire_at": _time(expires)})
        for r in rows(prefixes.by_blocks(needed)):
            out.top_prefixes.append({"prefix_base64": _encoded(r["prefix"]), "total_size": r["total_size"], "key_count": r["key_count"]})
        skewed = lambda slot: aggregates.has_skew(needed, slot).first()["skewed"] if summary is None else not kept(slot).isEmpty()
        out.cluster_issues = {
            "big_keys": [{"key_base64": _encoded(r.pop("key")), **r} for r in rows(aggregates.big_keys_by_type(needed, big_string, big_other))],
            "codis_slot_skew": skewed("codis_slot"),
            "redis_cluster_slot_skew": skewed("redis_slot"),
        }
        return out
    finally:
        needed.unpersist()
