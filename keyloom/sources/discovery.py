"""Which servers of a cluster or a Codis product to read."""

from __future__ import annotations

import json
import logging
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from . import wire

log = logging.getLogger(__name__)


class DiscoveryError(ValueError):
    """No server, or not the kind of server that was asked for."""


@dataclass(frozen=True)
class Node:
    node_id: str
    address: str
    flags: tuple[str, ...]
    master_id: str | None

    @property
    def is_master(self) -> bool:
        return "master" in self.flags

    @property
    def healthy(self) -> bool:
        return not any("fail" in f for f in self.flags)


def parse_cluster_nodes(text: str) -> list[Node]:
    """The nodes of a CLUSTER NODES answer; lines of another form are passed over."""
    nodes = []
    for line in text.splitlines():
        fields = line.split()
        if len(fields) < 8:
            if fields:
                log.warning("passing over %r", line)
            continue
        address = fields[1].split("@", 1)[0]
        nodes.append(Node(fields[0], address, tuple(fields[2].split(",")), None if fields[3] == "-" else fields[3]))
    if not nodes:
        raise DiscoveryError("no cluster nodes")
    return nodes


def choose_node(master: Node, slaves: list[Node], require_slave: bool = False) -> Node:
    """A healthy replica, else any, else the master unless replicas are required."""
    for slave in slaves:
        if slave.healthy:
            return slave
    if slaves:
        return slaves[0]
    if require_slave:
        raise DiscoveryError(f"shard {master.address} has no replica")
    log.warning("shard %s has no replica: reading its master", master.address)
    return master


def choose_nodes(nodes: list[Node], require_slave: bool = False) -> list[str]:
    """One address for each shard."""
    masters = [n for n in nodes if n.is_master]
    if not masters:
        raise DiscoveryError("no master among the cluster nodes")
    return [choose_node(m, [n for n in nodes if n.master_id == m.node_id], require_slave).address for m in masters]


def cluster_instances(addresses: list[str], username: str = "", password: str = "", require_slave: bool = False, ask: Callable = wire.ask) -> list[str]:
    """Asks the given nodes in turn until one answers."""
    last: Exception | None = None
    for address in addresses:
        try:
            answer = ask(address, "CLUSTER", "NODES", username=username, password=password)
            return choose_nodes(parse_cluster_nodes(answer.decode()), require_slave)
        except (OSError, DiscoveryError) as e:
            if isinstance(e, DiscoveryError) and "replica" in str(e):
                raise
            last = e
    raise DiscoveryError(f"no node of {addresses} answered: {last}")


def choose_server(group: dict, require_slave: bool = False) -> str | None:
    """A group's replica that serves no reads, else one that does, else its master; None for an empty group."""
    servers = group.get("servers") or []
    if not servers:
        return None
    master, replicas = servers[0], servers[1:]
    for server in replicas:
        if not server.get("replica_group"):
            return server["server"]
    if require_slave:
        raise DiscoveryError(f"group {group.get('id')} has no replica that serves no reads")
    if replicas:
        log.warning("group %s: reading a replica that serves reads", group.get("id"))
        return replicas[0]["server"]
    log.warning("group %s: reading its master", group.get("id"))
    return master["server"]


def _fetch(url: str) -> dict:
    with urllib.request.urlopen(url, timeout=30) as answer:
        return json.load(answer)


def _topology(dashboard: str, fetch: Callable[[str], dict]) -> dict:
    url = dashboard if "://" in dashboard else f"http://{dashboard}"
    return fetch(f"{url.rstrip('/')}/topom")


def codis_instances(dashboard: str, require_slave: bool = False, fetch: Callable[[str], dict] = _fetch) -> list[str]:
    stats = _topology(dashboard, fetch).get("stats") or {}
    groups = stats.get("group", {}).get("models") or []
    found = [a for a in (choose_server(g, require_slave) for g in groups) if a]
    if not found:
        raise DiscoveryError("the dashboard names no server")
    return found


def codis_product(dashboard: str, fetch: Callable[[str], dict] = _fetch) -> str:
    name = _topology(dashboard, fetch).get("model", {}).get("product_name")
    if not name:
        raise DiscoveryError("the dashboard names no product")
    return name
