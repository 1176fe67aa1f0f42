import io
import socket
import threading
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pyarrow as pa
import pytest

from keyloom import cli
from keyloom.plans.metrics import Metrics, serve
from keyloom.plans.report import build_report
from keyloom.sinks import clickhouse as ch

from .test_store import BATCH, fixture


class Fake:
    """As much of a server as the connector uses: tables by name, inserts and selects in Arrow streams."""

    def __init__(self, tables=()):
        self.tables, self.inserts, self.markers, self.calls, self.auth = set(tables), [], [], [], set()
        self.types = {}  # columns that are not as they should be
        fake = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                options = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
                body = self.rfile.read(int(self.headers["Content-Length"] or 0))
                fake.auth.add(self.headers.get("Authorization"))
                try:
                    status, out = 200, fake.answer(options["query"], body, options)
                except Exception as e:
                    status, out = 500, repr(e).encode()
                self.send_response(status)
                self.send_header("Content-Length", str(len(out)))
                self.end_headers()
                self.wfile.write(out)

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://user:p%40ss@127.0.0.1:{self.server.server_port}?database=db"

    def answer(self, sql, body, options):
        self.calls.append(sql)
        assert options["database"] == "db"
        if sql.startswith("EXISTS"):
            return b"1\n" if sql.split()[1] in self.tables else b"0\n"
        if sql.startswith("CREATE"):
            self.tables.add(sql.split()[2])
            return b""
        if sql.startswith(f"INSERT INTO {ch.RAW}"):
            self.inserts.append(pa.ipc.open_stream(body).read_all())
            return b""
        if sql.startswith(f"INSERT INTO {ch.MARKERS}"):
            self.markers.append((options["param_c"], options["param_b"]))
            return b""
        if "system.columns" in sql:
            return "".join(f"{n}\t{self.types.get(n, t)}\n" for n, t in ch.COLUMN_TYPES.items()).encode()
        if "formatDateTime" in sql:
            assert "'UTC'" in sql
            return "".join(b + "\n" for c, b in self.markers if c == options["param_c"]).encode()
        rows = pa.concat_tables(self.inserts)
        if "DISTINCT instance" in sql:
            return "".join(sorted({i + "\n" for i in rows["instance"].to_pylist()})).encode()
        rows = rows.filter(pa.compute.equal(rows["instance"], options["param_i"]))
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        return sink.getvalue()


def test_round_trip(spark):
    fake = Fake()
    server = ch.ClickHouse(fake.url)
    with pytest.raises(ch.ClickHouseError, match="do not exist"):
        ch.write(fixture(spark), server, "c", BATCH)
    assert ch.write(fixture(spark).coalesce(1), server, "c", BATCH, create=True, rows_per_insert=4) == 6
    assert fake.tables == {ch.RAW, ch.MARKERS, ch.VIEW} and fake.markers == [("c", BATCH)]
    assert [t.num_rows for t in fake.inserts] == [4, 2] and fake.inserts[0].schema == ch.ARROW
    assert fake.auth == {"Basic dXNlcjpwQHNz"}
    ch.register(spark)
    back = spark.read.format("clickhouse_records").options(url=fake.url, cluster="c").load()
    assert sorted(map(str, back.collect())) == sorted(map(str, fixture(spark).collect()))
    assert build_report(back).to_json() == build_report(fixture(spark)).to_json()


def test_partial_tables_and_refusals():
    fake = Fake([ch.RAW])
    with pytest.raises(ch.ClickHouseError, match=f"missing: {ch.MARKERS}, {ch.VIEW}"):
        ch.ensure_tables(ch.ClickHouse(fake.url), create=True)
    with pytest.raises(ch.ClickHouseError, match="no completed batch"):
        ch.latest(ch.ClickHouse(fake.url), "c")
    with pytest.raises(ch.ClickHouseError, match="ArrowInvalid"):
        ch.ClickHouse(fake.url).request(f"INSERT INTO {ch.RAW} FORMAT ArrowStream", b"junk")


def test_columns_are_compared():
    fake = Fake([ch.RAW, ch.MARKERS, ch.VIEW])
    ch.ensure_tables(ch.ClickHouse(fake.url))
    fake.types["db"] = "UInt32"
    with pytest.raises(ch.ClickHouseError, match="db is UInt32, not UInt64"):
        ch.ensure_tables(ch.ClickHouse(fake.url))


def test_times_are_in_utc():
    assert all("DateTime64" not in s or "'UTC'" in s for s in ch.ddl())


def test_proxy():
    """A plain proxy gets the whole address."""
    fake = Fake()
    proxy = f"http://127.0.0.1:{fake.server.server_port}"
    server = ch.ClickHouse("http://no.such.host:8123?database=db", proxy)
    assert server.rows("EXISTS x") == ["0"]


class Socks:
    """A proxy that takes one login and leads every name to one port."""

    def __init__(self, port, status=0):
        self.asked, self.listener = [], socket.create_server(("127.0.0.1", 0))
        self.port, self.to, self.status = self.listener.getsockname()[1], port, status
        threading.Thread(target=self.run, daemon=True).start()

    def run(self):
        while True:
            link, _ = self.listener.accept()
            stream = link.makefile("rb")
            _, n = stream.read(2)
            method = stream.read(n)[0]
            link.sendall(bytes([5, method]))
            login = None
            if method == 2:
                stream.read(1)
                login = tuple(stream.read(stream.read(1)[0]) for _ in range(2))
                link.sendall(b"\x01" + bytes([login != (b"user", b"p@ss")]))
            if login in (None, (b"user", b"p@ss")):
                stream.read(4)
                name = stream.read(stream.read(1)[0])
                self.asked.append((name, int.from_bytes(stream.read(2), "big"), login))
                link.sendall(bytes([5, self.status, 0, 1]) + bytes(6))
                if not self.status:
                    there = socket.create_connection(("127.0.0.1", self.to))
                    for a, b in ((link, there), (there, link)):
                        threading.Thread(target=self.pump, args=(a, b), daemon=True).start()

    @staticmethod
    def pump(a, b):
        while data := a.recv(65536):
            b.sendall(data)


def test_socks_proxy():
    fake = Fake()
    port = fake.server.server_port
    proxy = Socks(port)
    for login, seen in (("", None), ("user:p%40ss@", (b"user", b"p@ss"))):
        server = ch.ClickHouse("http://no.such.host:8123?database=db", f"socks5://{login}127.0.0.1:{proxy.port}")
        assert server.rows("EXISTS x") == ["0"]
        assert proxy.asked[-1] == (b"no.such.host", 8123, seen)
    for bad in (f"socks5://user:wrong@127.0.0.1:{proxy.port}", f"socks5://127.0.0.1:{Socks(port, 5).port}"):
        with pytest.raises(OSError):
            ch.ClickHouse("http://no.such.host:8123?database=db", bad).rows("EXISTS x")
    with pytest.raises(ValueError):
        ch.ClickHouse("http://h:1?database=d", "socks5://p")


@pytest.mark.parametrize("url", ["ftp://h:1?database=d", "http://h?database=d", "http://h:1", "http://:1?database=d"])
def test_bad_addresses(url):
    with pytest.raises(ValueError):
        ch.ClickHouse(url)
    with pytest.raises(ValueError):
        ch.ClickHouse("http://h:1?database=d", "socks4://p:1")


def test_metrics():
    metrics = Metrics()
    metrics.add("c", BATCH, 'i"1', 2)
    metrics.add("c", BATCH, 'i"1', 3)
    server = serve(metrics, "http://127.0.0.1:0")
    text = urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/metrics").read().decode()
    assert f'records_parsed_total{{cluster="c",batch="{BATCH}",instance="i\\"1"}} 5' in text and "build_info" in text
    server.shutdown()
    for bad in ("https://h:1", "http://h", "http://h:1/x"):
        with pytest.raises(ValueError):
            serve(metrics, bad)


def test_rows_are_counted_while_they_pass(spark):
    metrics = Metrics()
    rows = metrics.observed(fixture(spark), BATCH)
    assert "records_parsed_total{" not in metrics.text()
    assert rows.count() == 6
    assert f'records_parsed_total{{cluster="c",batch="{BATCH}",instance="10.0.0.1:6379"}} 3' in metrics.text()


def test_command_line(spark, tmp_path, capsys):
    from . import rdb_builder as b

    fake = Fake()
    (tmp_path / "dump.rdb").write_bytes(b.full_dump())
    args = ["dump", "from-file", "--path", f"{tmp_path}/dump.rdb", "--instance", "1.1.1.1:1", "--cluster", "c", "--batch", BATCH]
    assert cli.main([*args, "into-clickhouse", "--url", fake.url, "--auto-create-tables"]) == 0
    assert cli.main(["report", "--url", fake.url, "--cluster", "c", "--output", f"{tmp_path}/r.json", "--format", "json"]) == 0
    assert "intset8" in (tmp_path / "r.json").read_text()
    with pytest.raises(SystemExit):
        cli.main(["report", "--cluster", "c"])
    capsys.readouterr()
    assert cli.main(["misc", "clickhouse-schema"]) == 0 and "ReplacingMergeTree" in capsys.readouterr().out
    for shell in ("bash", "zsh", "fish"):
        assert cli.main(["misc", "completion", "--shell", shell]) == 0 and "from-cluster" in capsys.readouterr().out
