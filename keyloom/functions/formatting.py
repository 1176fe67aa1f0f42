"""Rendering of numbers, sizes, keys, addresses and batch times."""

from __future__ import annotations

import math
import re
from datetime import datetime, timezone
from urllib.parse import urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER_UNITS = ("", "K", "M", "B", "T")
_BYTE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
_RFC3339 = re.compile(r"(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?([Zz]|[+-]\d\d:\d\d)")


def format_number(value: float) -> str:
    """Thousands as K, M, B, T with two decimals, cut and not rounded; smaller numbers as integers."""
    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "inf" if value > 0 else "-inf"
    sign, size, unit = "-" if value < 0 else "", abs(value), 0
    while size >= 1000 and unit < len(_NUMBER_UNITS) - 1:
        size /= 1000
        unit += 1
    if not unit:
        return f"{sign}{int(size)}"
    return f"{sign}{math.floor(size * 100 + 1e-9) / 100:.2f}{_NUMBER_UNITS[unit]}"


def format_bytesize(size: int) -> str:
    """Bytes in powers of 1024 with two decimals."""
    if size < 1024:
        return f"{size}B"
    unit = min((size.bit_length() - 1) // 10, len(_BYTE_UNITS) - 1)
    return f"{size / 1024**unit:.2f}{_BYTE_UNITS[unit]}"


def bytesize_column(size: Column) -> Column:
    """``format_bytesize`` as an expression; both round ties to even."""
    out = F.when(size < 1024, F.concat(size.cast("string"), F.lit("B")))
    for unit in range(1, len(_BYTE_UNITS)):
        text = F.concat(F.format_string("%.2f", F.bround(size / F.lit(float(1024**unit)), 2)), F.lit(_BYTE_UNITS[unit]))
        out = out.when(size < 1024 ** (unit + 1), text) if unit < len(_BYTE_UNITS) - 1 else out.otherwise(text)
    return out


def sanitize_url(url: str) -> str:
    """The address with its password masked."""
    try:
        parts = urlsplit(url)
        if not parts.scheme or not parts.hostname:
            return "<invalid-url>"
        _ = parts.port
    except ValueError:
        return "<invalid-url>"
    if parts.password is None:
        return url
    user, host = parts.netloc.rsplit("@", 1)
    return urlunsplit(parts._replace(netloc=f"{user.split(':', 1)[0]}:***@{host}"))


def parse_rfc3339_ns(text: str) -> int:
    """Nanoseconds since the epoch; raises ValueError for anything but an RFC 3339 time."""
    m = _RFC3339.fullmatch(text.strip())
    if not m:
        raise ValueError(f"not an RFC 3339 time: {text!r}")
    zone = "+00:00" if m[4] in "Zz" else m[4]
    seconds = int(datetime.fromisoformat(f"{m[1]}T{m[2]}{zone}").timestamp())
    return seconds * 10**9 + int((m[3] or "").ljust(9, "0"))


def format_rfc3339_ns(ns: int) -> str:
    """UTC, with as many decimals as are not zero."""
    seconds, rest = divmod(ns, 10**9)
    decimals = f".{rest:09d}".rstrip("0") if rest else ""
    return datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S") + decimals + "Z"


def batch_slug(ns: int) -> str:
    """The batch's directory name: UTC to the millisecond, without colons."""
    seconds, rest = divmod(ns, 10**9)
    return datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%d_%H-%M-%S") + f".{rest // 10**6:03d}Z"


def instance_file(instance: str) -> str:
    return instance.replace(":", "-").replace(" ", "_")


def report_name(cluster: str, batch: str, suffix: str = "html") -> str:
    return f"rdb_report_{cluster}_{batch}.{suffix}".replace(":", "-").replace("+", "_")


def escape_ascii(key: bytes) -> str:
    """Printable ASCII as it is, the rest as escapes."""
    named = {9: "\\t", 10: "\\n", 13: "\\r", 34: '\\"', 39: "\\'", 92: "\\\\"}
    return "".join(named.get(b) or (chr(b) if 32 <= b < 127 else f"\\x{b:02x}") for b in key)


def display_key(key: bytes) -> str:
    """The key as text where it is UTF-8, else with hexadecimal escapes."""
    try:
        return key.decode()
    except UnicodeDecodeError:
        return "".join(chr(b) if 32 <= b < 127 else f"\\x{b:02x}" for b in key)


def display_key_column(key: Column) -> Column:
    """The key as text where it is UTF-8, else in hexadecimal."""
    return F.coalesce(F.try_validate_utf8(key.cast("string")), F.lower(F.hex(key)))


def common_prefix(a: bytes, b: bytes) -> bytes:
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[:n]


def common_prefix_column(a: Column, b: Column) -> Column:
    """The longest common prefix of two binary columns."""
    n = F.least(F.length(a), F.length(b))
    same = lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)
    longest = F.when(n > 0, F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), n), same)), F.lit(0))).otherwise(0)
    return F.substring(a, F.lit(1), longest)
