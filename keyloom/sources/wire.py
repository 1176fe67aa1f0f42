"""The replication side of a server: handshake, and the snapshot that it sends."""

from __future__ import annotations

import logging
import socket
import time
from collections.abc import Callable

log = logging.getLogger(__name__)

HANDSHAKE_S, RETRIES, FIRST_DELAY_S, LONGEST_DELAY_S, RETRY_S = 30.0, 3, 0.5, 5.0, 30.0
# Parts of messages after which another try may help (fixed values).
_TRANSIENT = ("LOADING", "MASTERDOWN", "NOMASTERLINK", "TRYAGAIN", "timed out", "Connection refused", "Connection reset", "Broken pipe", "closed the connection")
DELIMITER_LENGTH = 40


class WireError(ConnectionError):
    """The server answered something else than was asked for, or went away."""


def parse_address(text: str) -> tuple[str, int]:
    host, _, port = text.strip().rpartition(":")
    if not host or not port.isdigit() or not 0 < int(port) < 65536:
        raise ValueError(f"not host:port: {text!r}")
    return host.strip("[]"), int(port)


def command(*words: str) -> bytes:
    """A request as an array with one element a word, so words may hold blanks."""
    parts = [w.encode() for w in words]
    return b"*%d\r\n" % len(parts) + b"".join(b"$%d\r\n%s\r\n" % (len(p), p) for p in parts)


class Connection:
    """A socket with buffered reads."""

    def __init__(self, address: tuple[str, int], timeout: float = HANDSHAKE_S):
        self._socket = socket.create_connection(address, timeout)
        self._held = b""

    def close(self) -> None:
        self._socket.close()

    def send(self, *words: str) -> None:
        self._socket.sendall(command(*words))

    def some(self, n: int) -> bytes:
        """Up to ``n`` bytes; empty at the end."""
        if not self._held:
            return self._socket.recv(n)
        out, self._held = self._held[:n], self._held[n:]
        return out

    def push_back(self, data: bytes) -> None:
        self._held = data + self._held

    def line(self) -> str:
        while b"\r\n" not in self._held:
            more = self._socket.recv(4096)
            if not more:
                raise WireError("the server closed the connection")
            self._held += more
        out, self._held = self._held.split(b"\r\n", 1)
        return out.decode("utf-8", "replace")

    def reply(self) -> str:
        """One simple reply. Newlines before it keep the link alive and mean nothing."""
        while True:
            text = self.line().lstrip("\n")
            if text:
                break
        if text[0] == "-":
            raise WireError(text[1:])
        if text[0] != "+":
            raise WireError(f"unexpected reply {text!r}")
        return text[1:]

    def bulk(self) -> bytes:
        """One bulk reply, as a whole."""
        head = self.line()
        if head[:1] == "-":
            raise WireError(head[1:])
        if head[:1] != "$":
            raise WireError(f"unexpected reply {head!r}")
        need, out = int(head[1:]) + 2, b""
        while len(out) < need:
            more = self.some(need - len(out))
            if not more:
                raise WireError("the server closed the connection")
            out += more
        return out[:-2]


def authenticate(link: Connection, username: str = "", password: str = "") -> None:
    if password:
        link.send("AUTH", *([username] if username else []), password)  # never logged
        link.reply()


def handshake(link: Connection, username: str = "", password: str = "") -> None:
    """Up to the point where the server sends its snapshot."""
    authenticate(link, username, password)
    link.send("PING")
    link.reply()
    link.send("REPLCONF", "capa", "eof")
    link.reply()
    link.send("REPLCONF", "rdb-only", "1")
    try:
        link.reply()
    except WireError as e:
        log.warning("the server does not know rdb-only: %s", e)
    link.send("PSYNC", "?", "-1")
    answer = link.reply()
    if not answer.startswith("FULLRESYNC"):
        raise WireError(f"no full resynchronisation: {answer}")


class DiskSnapshot:
    """Exactly ``size`` bytes; fewer are an error."""

    def __init__(self, link: Connection, size: int):
        self._link, self._left = link, size

    def read(self, n: int) -> bytes:
        if not self._left:
            return b""
        data = self._link.some(min(n, self._left))
        if not data:
            raise WireError(f"the server closed the connection {self._left} bytes before the end")
        self._left -= len(data)
        return data


class DisklessSnapshot:
    """Everything up to the delimiter, which may come in parts; an end without it is an error."""

    def __init__(self, link: Connection, delimiter: bytes):
        self._link, self._delimiter = link, delimiter
        self._held, self._done = b"", False

    def read(self, n: int) -> bytes:
        keep = len(self._delimiter)
        while not self._done:
            at = self._held.find(self._delimiter)
            if at >= 0:
                self._held, self._done = self._held[:at], True
                break
            if len(self._held) > keep:
                # What is far enough from the end cannot be part of the delimiter.
                ready = min(n, len(self._held) - keep)
                out, self._held = self._held[:ready], self._held[ready:]
                return out
            more = self._link.some(max(n, 4096))
            if not more:
                raise WireError("the server closed the connection before the delimiter")
            self._held += more
        out, self._held = self._held[:n], self._held[n:]
        return out


def snapshot(link: Connection) -> DiskSnapshot | DisklessSnapshot:
    """The stream behind the line that names its size or its delimiter."""
    while True:
        first = link.some(1)
        if not first:
            raise WireError("the server closed the connection")
        if first != b"\n":
            break
    link.push_back(first)
    head = link.line()
    if head.startswith("$EOF:") and len(head) == 5 + DELIMITER_LENGTH:
        return DisklessSnapshot(link, head[5:].encode())
    if head[:1] == "$" and head[1:].isdigit():
        return DiskSnapshot(link, int(head[1:]))
    raise WireError(f"neither a size nor a delimiter: {head!r}")


def is_transient(error: Exception) -> bool:
    return any(part.lower() in str(error).lower() for part in _TRANSIENT)


def open_snapshot(address: str, username: str = "", password: str = "", sleep: Callable[[float], None] = time.sleep):
    """(connection, snapshot stream), after a few tries."""
    delay, began = FIRST_DELAY_S, time.monotonic()
    for attempt in range(RETRIES + 1):
        link = None
        try:
            link = Connection(parse_address(address))
            handshake(link, username, password)
            return link, snapshot(link)
        except OSError as e:
            if link:
                link.close()
            if attempt == RETRIES or not is_transient(e) or time.monotonic() - began + delay > RETRY_S:
                raise
            log.warning("%s: %s; trying again in %s s", address, e, delay)
            sleep(delay)
            delay = min(2 * delay, LONGEST_DELAY_S)
    raise AssertionError


def ask(address: str, *words: str, username: str = "", password: str = "") -> bytes:
    """The bulk answer to one command."""
    link = Connection(parse_address(address))
    try:
        authenticate(link, username, password)
        link.send(*words)
        return link.bulk()
    finally:
        link.close()
