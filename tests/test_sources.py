import io
import json
import socket
import threading

import pytest

from keyloom.sources import discovery, rdb, wire
from keyloom.sources.rdb_source import read_files, register

from . import rdb_builder as b

BATCH = "2024-01-01T00:00:00.123456789Z"
DELIMITER = b"d" * 40


class Server(threading.Thread):
    """Answers a replica's handshake on a local port, once for every connection it is told of."""

    def __init__(self, body=None, chunks=1000, password=None, rdb_only=True, first=(), answer=None):
        super().__init__(daemon=True)
        self.body, self.chunks, self.password, self.rdb_only, self.first, self.answer = body, chunks, password, rdb_only, list(first), answer
        self.seen = []
        self.listener = socket.create_server(("127.0.0.1", 0))
        self.address = f"127.0.0.1:{self.listener.getsockname()[1]}"
        self.start()

    def run(self):
        while True:
            try:
                link, _ = self.listener.accept()
            except OSError:
                return
            with link, link.makefile("rb") as read:
                try:
                    self.serve(link, read)
                except (OSError, ValueError):
                    pass

    def words(self, read):
        head = read.readline()
        if not head:
            raise ValueError
        out = []
        for _ in range(int(head[1:])):
            size = int(read.readline()[1:])
            out.append(read.read(size).decode())
            read.read(2)
        self.seen.append(out)
        return out

    def serve(self, link, read):
        while True:
            words = self.words(read)
            if self.first:
                link.sendall(self.first.pop(0))
                return
            if words[0] == "AUTH":
                link.sendall(b"+OK\r\n" if words[1:] == self.password else b"-WRONGPASS no\r\n")
            elif words[0] == "PING":
                link.sendall(b"\n+PONG\r\n")
            elif words[:2] == ["REPLCONF", "rdb-only"]:
                link.sendall(b"+OK\r\n" if self.rdb_only else b"-ERR Unrecognized REPLCONF option\r\n")
            elif words[0] == "REPLCONF":
                link.sendall(b"+OK\r\n")
            elif words[0] == "CLUSTER":
                link.sendall(b"$%d\r\n%s\r\n" % (len(self.answer), self.answer))
            else:
                link.sendall(b"+FULLRESYNC abc 0\r\n\n\n")
                for at in range(0, len(self.body), self.chunks):
                    link.sendall(self.body[at : at + self.chunks])
                return

    def close(self):
        self.listener.close()


def disk(data):
    return b"$%d\r\n" % len(data) + data


def diskless(data):
    return b"$EOF:" + DELIMITER + b"\r\n" + data + DELIMITER


@pytest.mark.parametrize("form", [disk, diskless])
@pytest.mark.parametrize(("chunks", "password", "rdb_only"), [(1 << 20, None, True), (7, None, False), (1000, ["pass word"], True), (1000, ["user", "p"], True)])
def test_snapshot_from_a_server(form, chunks, password, rdb_only):
    data = b.dump(b"".join(b.key_value(c, n.encode(), v) for n, c, v, *_ in b.values() if len(v) < 3000))
    server = Server(form(data), chunks, password, rdb_only)
    user, secret = ([*([""] if len(password) == 1 else []), *password]) if password else ("", "")
    link, stream = wire.open_snapshot(server.address, user, secret)
    assert list(rdb.records(stream)) == list(rdb.records(io.BytesIO(data)))
    assert ["REPLCONF", "capa", "eof"] in server.seen and server.seen[-1] == ["PSYNC", "?", "-1"]
    link.close()
    server.close()


@pytest.mark.parametrize("body", [disk(b.full_dump())[:-20], diskless(b.full_dump())[:-20]])
def test_closed_before_the_end(body):
    server = Server(body)
    link, stream = wire.open_snapshot(server.address)
    with pytest.raises(wire.WireError, match="closed the connection"):
        while stream.read(100):
            pass
    link.close()
    server.close()


def test_wrong_password_is_not_tried_again_and_loading_is():
    server = Server(disk(b.dump()), password=["good"])
    with pytest.raises(wire.WireError, match="WRONGPASS"):
        wire.open_snapshot(server.address, "", "bad")
    assert len(server.seen) == 1
    server.close()
    waits = []
    server = Server(disk(b.dump()), first=[b"-LOADING wait\r\n", b"-LOADING wait\r\n"])
    link, stream = wire.open_snapshot(server.address, sleep=waits.append)
    assert waits == [0.5, 1.0] and stream.read(5) == b"REDIS"
    link.close()
    server.close()


@pytest.mark.parametrize("text", ["host", "host:", ":1", "h:0", "h:70000", "h:x"])
def test_addresses(text):
    with pytest.raises(ValueError):
        wire.parse_address(text)
    assert wire.parse_address("[::1]:6379") == ("::1", 6379)


NODES = """\
m1 10.0.0.1:7000@17000 myself,master - 0 0 1 connected 0-5460
m2 10.0.0.2:7000@17000,host master - 0 0 2 connected 5461-10922
m3 10.0.0.3:7000@17000 master - 0 0 3 connected 10923-16383
broken line
s1 10.0.0.4:7000@17000 slave,fail? m1 0 0 1 connected
s2 10.0.0.5:7000@17000 slave m1 0 0 1 connected
s3 10.0.0.6:7000@17000 slave,fail m2 0 0 1 connected
"""


def test_cluster_nodes():
    nodes = discovery.parse_cluster_nodes(NODES)
    assert [n.node_id for n in nodes] == ["m1", "m2", "m3", "s1", "s2", "s3"]
    assert nodes[3].master_id == "m1" and not nodes[3].healthy and nodes[0].master_id is None
    assert discovery.choose_nodes(nodes) == ["10.0.0.5:7000", "10.0.0.6:7000", "10.0.0.3:7000"]
    with pytest.raises(discovery.DiscoveryError, match="no replica"):
        discovery.choose_nodes(nodes, require_slave=True)
    with pytest.raises(discovery.DiscoveryError):
        discovery.parse_cluster_nodes("")


def test_codis():
    server = lambda a, reads=False: {"server": a, "replica_group": reads}
    groups = [
        {"id": 1, "servers": [server("m1"), server("r1", True), server("q1")]}, {"id": 2, "servers": [server("m2"), server("r2", True)]},
        {"id": 3, "servers": [server("m3")]}, {"id": 4, "servers": []},
    ]
    urls = []

    def fetch(url):
        urls.append(url)
        return {"model": {"product_name": "shop"}, "stats": {"group": {"models": groups}}}

    assert discovery.codis_instances("d:11080", fetch=fetch) == ["q1", "r2", "m3"]
    assert discovery.codis_product("http://d:11080/", fetch=fetch) == "shop" and set(urls) == {"http://d:11080/topom"}
    for k in (1, 2):
        with pytest.raises(discovery.DiscoveryError):
            discovery.choose_server(groups[k], require_slave=True)
    with pytest.raises(discovery.DiscoveryError):
        discovery.codis_instances("d", fetch=lambda _: json.loads("{}"))


def test_file_source(spark, tmp_path):
    register(spark)
    for name in ("a", "b"):
        (tmp_path / f"{name}.rdb").write_bytes(b.full_dump())
    options = {"mode": "file", "path": f"{tmp_path}/a.rdb,{tmp_path}/b.rdb", "instance": "1.1.1.1:1,2.2.2.2:2", "cluster": "c", "batch": BATCH}
    rows = spark.read.format("rdb").options(**options).load()
    assert rows.rdd.getNumPartitions() == 2
    found = rows.collect()
    assert len(found) == 2 * len(b.values()) and {r["instance"] for r in found} == {"1.1.1.1:1", "2.2.2.2:2"}
    assert {r["batch_ns"] for r in found} == {1704067200123456789} and {r["codis_slot"] for r in found} == {None}
    by_files = read_files(spark, str(tmp_path), "c", BATCH, source_type="cluster").collect()
    assert sorted(r["key"] for r in by_files) == sorted(r["key"] for r in found)
    assert {r["instance"] for r in by_files} == {"a", "b"} and None not in {r["redis_slot"] for r in by_files}


def test_server_sources(spark):
    register(spark)
    server = Server(diskless(b.full_dump()), answer=b"")
    options = {"cluster": "c", "batch": BATCH}
    rows = spark.read.format("rdb").options(mode="standalone", addr=server.address, **options).load()
    assert rows.count() == len(b.values())
    port = server.address.rpartition(":")[2]
    server.answer = f"m1 {server.address}@1{port} master - 0 0 1 connected 0-16383\n".encode()
    rows = spark.read.format("rdb").options(mode="cluster", nodes=f"127.0.0.1:1,{server.address}", **options).load().collect()
    assert {r["instance"] for r in rows} == {server.address} and None not in {r["redis_slot"] for r in rows}
    server.close()


@pytest.mark.parametrize("options", [{}, {"cluster": "c"}, {"cluster": "c", "mode": "x"}, {"cluster": "c", "path": "a,b", "instance": "i"}, {"cluster": "c", "mode": "standalone"}, {"cluster": "c", "mode": "standalone", "addr": "h"}])
def test_bad_options(options):
    from keyloom.sources.rdb_source import RdbReader

    with pytest.raises(ValueError):
        RdbReader(options)


def test_truncated_file(spark, tmp_path):
    register(spark)
    (tmp_path / "cut.rdb").write_bytes(b.full_dump()[:-3000])
    options = {"path": f"{tmp_path}/cut.rdb", "instance": "i:1", "cluster": "c", "batch": BATCH}
    with pytest.raises(Exception, match="ends at"):
        spark.read.format("rdb").options(**options).load().collect()
    assert 0 < spark.read.format("rdb").options(on_truncate="ignore", **options).load().count() < len(b.values())
