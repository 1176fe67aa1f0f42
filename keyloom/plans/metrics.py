"""Counters of a dump, in the text format that Prometheus reads."""

from __future__ import annotations

import threading
from collections import Counter
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame

VERSION = "0.1.0"


class _Counts(AccumulatorParam):
    """Sums by key."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:
        for k, n in b.items():
            a[k] = a.get(k, 0) + n
        return a


class Metrics:
    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._parsed: dict[tuple[str, str, str], int] = {}
        self._sources: list[tuple] = []

    def add(self, cluster: str, batch: str, instance: str, n: int) -> None:
        with self._lock:
            k = (cluster, batch, instance)
            self._parsed[k] = self._parsed.get(k, 0) + n

    def observed(self, records: DataFrame, batch: str) -> DataFrame:
        """``records``, counted by instance while a job reads them, whatever it does with them.

        Tasks add to an accumulator as their rows pass; the driver sees what finished tasks have counted. Tasks that run again
        count again: these are rows parsed.
        """
        counts = records.sparkSession.sparkContext.accumulator({}, _Counts())
        self._sources.append((counts, batch))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                found = Counter(zip(*(rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("cluster", "instance"))))
                counts.add(dict(found))
                yield rows

        return records.mapInArrow(run, records.schema)

    def text(self) -> str:
        quote = lambda s: s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
        lines = ["# TYPE build_info gauge", f'build_info{{version="{VERSION}"}} 1', "# TYPE records_parsed_total counter"]
        with self._lock:
            parsed = Counter(self._parsed)
            for counts, batch in self._sources:
                parsed.update({(c, batch, i): n for (c, i), n in counts.value.items()})
            for (c, b, i), n in sorted(parsed.items()):
                lines.append(f'records_parsed_total{{cluster="{quote(c)}",batch="{quote(b)}",instance="{quote(i)}"}} {n}')
        return "\n".join(lines) + "\n"


def serve(metrics: Metrics, address: str) -> ThreadingHTTPServer:
    """Serve /metrics at ``http://host:port`` until ``shutdown``."""
    parts = urlsplit(address)
    if parts.scheme != "http" or not parts.hostname or parts.port is None or parts.path not in ("", "/"):
        raise ValueError("the address must be http://host:port")

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            found = self.path == "/metrics"
            body = metrics.text().encode() if found else b"not found\n"
            self.send_response(200 if found else 404)
            self.send_header("Content-Type", "text/plain; version=0.0.4")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_args) -> None:
            pass

    server = ThreadingHTTPServer((parts.hostname, parts.port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
