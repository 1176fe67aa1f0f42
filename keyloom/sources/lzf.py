"""LZF decompression."""

from __future__ import annotations


class LzfError(ValueError):
    """The compressed data is damaged."""


def decompress(data: bytes, size: int) -> bytes:
    """A control byte below 32 starts a run of literals; else it names a length and the distance back to copy from."""
    out = bytearray()
    at, end = 0, len(data)
    try:
        while at < end:
            control = data[at]
            at += 1
            if control < 32:
                run = data[at : at + control + 1]
                if len(run) != control + 1:
                    raise LzfError("cut literal run")
                out += run
                at += control + 1
                continue
            length = control >> 5
            if length == 7:
                length += data[at]
                at += 1
            start = len(out) - ((control & 31) << 8 | data[at]) - 1
            at += 1
            if start < 0:
                raise LzfError("reference before the start")
            length += 2
            step = len(out) - start
            if step >= length:
                out += out[start : start + length]
            else:  # the copy feeds on itself
                out += (bytes(out[start:]) * (length // step + 1))[:length]
    except IndexError as e:
        raise LzfError("cut reference") from e
    if len(out) != size:
        raise LzfError(f"{len(out)} bytes, not {size}")
    return bytes(out)
