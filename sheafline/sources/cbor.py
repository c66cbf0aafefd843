"""CBOR (RFC 8949) without tags beyond numbers and times."""

from __future__ import annotations

import math
import struct

LONG = 1 << 63


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for code, form, limit in ((24, ">B", 1 << 8), (25, ">H", 1 << 16), (26, ">I", 1 << 32), (27, ">Q", 1 << 64)):
        if n < limit:
            return bytes([major << 5 | code]) + struct.pack(form, n)
    raise ValueError("number too large for CBOR")


def encode(value: object) -> bytes:
    if value is None:
        return b"\xf6"
    if isinstance(value, bool):
        return b"\xf5" if value else b"\xf4"
    if isinstance(value, int):
        return _head(0, value) if value >= 0 else _head(1, -1 - value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, str):
        b = value.encode()
        return _head(3, len(b)) + b
    if isinstance(value, bytes | bytearray):
        return _head(2, len(value)) + bytes(value)
    if isinstance(value, list | tuple):
        return _head(4, len(value)) + b"".join(map(encode, value))
    if isinstance(value, dict):
        return _head(5, len(value)) + b"".join(encode(k) + encode(v) for k, v in value.items())
    raise TypeError(f"no CBOR for {type(value).__name__}")


def _half(b: bytes) -> float:
    return struct.unpack(">e", b)[0]


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("CBOR ends too early")
        self.at += n
        return out

    def number(self, low: int) -> int | None:
        if low < 24:
            return low
        if low == 31:
            return None
        if low > 27:
            raise ValueError("CBOR with a reserved length")
        return int.from_bytes(self.take(1 << (low - 24)), "big")

    def value(self) -> object:
        first = self.take(1)[0]
        major, low = first >> 5, first & 31
        if major == 7:
            if low in (20, 21):
                return low == 21
            if low in (22, 23):
                return None
            if low in (25, 26, 27):
                b = self.take({25: 2, 26: 4, 27: 8}[low])
                return {25: _half, 26: lambda x: struct.unpack(">f", x)[0], 27: lambda x: struct.unpack(">d", x)[0]}[low](b)
            if low == 31:
                raise StopIteration
            raise ValueError("unknown simple value in CBOR")
        n = self.number(low)
        if major in (0, 1):
            v = n if major == 0 else -1 - n
            return v if -LONG <= v < LONG else float(v)
        if major in (2, 3):
            if n is None:
                parts = list(self.items(None))
                return b"".join(parts) if major == 2 else "".join(parts)
            b = self.take(n)
            return b if major == 2 else b.decode()
        if major == 4:
            return list(self.items(n))
        if major == 5:
            flat = list(self.items(None if n is None else 2 * n))
            return dict(zip(flat[::2], flat[1::2], strict=True))
        inner = self.value()
        if n in (2, 3) and isinstance(inner, bytes):
            big = int.from_bytes(inner, "big")
            v = big if n == 2 else -1 - big
            return v if -LONG <= v < LONG else float(v)
        return inner

    def items(self, n: int | None) -> object:
        k = 0
        while n is None or k < n:
            if n is None and self.data[self.at : self.at + 1] == b"\xff":
                self.at += 1
                return
            yield self.value()
            k += 1


def decode(data: bytes) -> object:
    """One value; integers beyond 64 bits become floats."""
    reader = _Reader(data)
    out = reader.value()
    if reader.at != len(data):
        raise ValueError("CBOR with something after its value")
    return out


def is_nan(x: object) -> bool:
    return isinstance(x, float) and math.isnan(x)
