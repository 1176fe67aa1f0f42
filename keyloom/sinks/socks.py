"""HTTP requests through a SOCKS5 proxy (RFC 1928, user names by RFC 1929); names are resolved by the proxy."""

from __future__ import annotations

import http.client
import socket
import urllib.parse
import urllib.request

_VERSION, _CONNECT, _NAME = 5, 1, 3
_NO_LOGIN, _LOGIN = 0, 2
#: Bytes of the bound address in an answer, by its type; a name's length stands before it.
_BOUND = {1: 4, 4: 16}


class SocksError(OSError):
    """The proxy refused, or speaks something else."""


def _exactly(link: socket.socket, n: int) -> bytes:
    found = b""
    while len(found) < n:
        part = link.recv(n - len(found))
        if not part:
            raise SocksError("the proxy closed the connection")
        found += part
    return found


def open_link(proxy: str, host: str, port: int, timeout: float) -> socket.socket:
    """A connection to ``host:port`` through ``socks5://[user[:password]@]host:port``."""
    parts = urllib.parse.urlsplit(proxy)
    link = socket.create_connection((parts.hostname, parts.port), timeout)
    try:
        login = parts.username is not None
        link.sendall(bytes([_VERSION, 1, _LOGIN if login else _NO_LOGIN]))
        version, method = _exactly(link, 2)
        if version != _VERSION or method not in (_NO_LOGIN, _LOGIN):
            raise SocksError("the proxy takes no such login")
        if method == _LOGIN:
            fields = [urllib.parse.unquote(x or "").encode() for x in (parts.username, parts.password)]
            link.sendall(b"\x01" + b"".join(bytes([len(x)]) + x for x in fields))
            if _exactly(link, 2)[1]:
                raise SocksError("the proxy refused the login")
        name = host.encode("idna")
        link.sendall(bytes([_VERSION, _CONNECT, 0, _NAME, len(name)]) + name + port.to_bytes(2, "big"))
        _, status, _, kind = _exactly(link, 4)
        if status:
            raise SocksError(f"the proxy answered {status} for {host}:{port}")
        _exactly(link, (_BOUND[kind] if kind in _BOUND else _exactly(link, 1)[0]) + 2)
        return link
    except BaseException:
        link.close()
        raise


class Handler(urllib.request.HTTPHandler, urllib.request.HTTPSHandler):
    """Opens http and https addresses through a proxy."""

    def __init__(self, proxy: str):
        urllib.request.HTTPSHandler.__init__(self)
        self.proxy = proxy

    def _connection(self, base):
        proxy = self.proxy

        class Connection(base):
            def __init__(self, *args, **options):
                super().__init__(*args, **options)
                self._create_connection = lambda address, timeout, _source=None: open_link(proxy, *address, timeout)

        return Connection

    def http_open(self, request):
        return self.do_open(self._connection(http.client.HTTPConnection), request)

    def https_open(self, request):
        return self.do_open(self._connection(http.client.HTTPSConnection), request, context=self._context)
