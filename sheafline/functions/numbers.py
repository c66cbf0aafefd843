"""Integers, floats, decimals and their bytes."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import guarded

MINUS = chr(0x2212)


def to_int(x: Column, base: int = 10) -> Column:
    """Integer of a boolean, number (truncated), or text in some base, with a minus sign of either kind."""
    if base == 10:
        return x.cast("bigint")
    plain = F.regexp_replace(x, f"^[-{MINUS}]", "")
    value = F.conv(plain, base, 10).cast("bigint")
    good = plain.rlike(_digits(base))
    return guarded(F.when(x.rlike(f"^[-{MINUS}]"), -value).otherwise(value), ~good, "string contains invalid digits")


def _digits(base: int) -> str:
    if base <= 10:
        return f"^[0-{base - 1}]+$"
    last = chr(ord("a") + base - 11)
    return f"(?i)^[0-9a-{last}]+$"


def to_str(x: Column, base: int = 10) -> Column:
    """Lower-case digits of an integer, with U+2212 as minus unless the base is ten."""
    if base == 10:
        return x.cast("string")
    digits = F.lower(F.conv(F.abs(x).cast("string"), 10, base))
    return F.when(x < 0, F.concat(F.lit(MINUS), digits)).otherwise(digits)


def signum(x: Column) -> Column:
    return F.signum(x)


def bit_not(x: Column) -> Column:
    return F.bitwise_not(x)


def bit_and(a: Column, b: Column | int) -> Column:
    return a.bitwiseAND(b)


def bit_or(a: Column, b: Column | int) -> Column:
    return a.bitwiseOR(b)


def bit_xor(a: Column, b: Column | int) -> Column:
    return a.bitwiseXOR(b)


def bit_lshift(x: Column, shift: int) -> Column:
    """An error where bits would be lost."""
    if shift > 63:
        return guarded(F.lit(0).cast("bigint"), x != 0, "the result is too large")
    moved = F.shiftleft(x.cast("bigint"), shift)
    return guarded(moved, F.shiftright(moved, shift) != x, "the result is too large")


def bit_rshift(x: Column, shift: int, logical: bool = False) -> Column:
    """Arithmetic or logical; beyond 63 places nothing but the sign is left."""
    long = x.cast("bigint")
    if logical:
        return F.shiftrightunsigned(long, shift) if shift < 64 else F.lit(0).cast("bigint")
    return F.shiftright(long, min(shift, 63))


def int_from_bytes(b: Column, endian: str = "little", signed: bool = True) -> Column:
    """At most 8 bytes as an integer."""
    hexed = F.hex(b)
    if endian == "little":
        hexed = F.array_join(F.reverse(F.regexp_extract_all(hexed, F.lit(".."), 0)), "")
    n = F.octet_length(b)
    value = F.conv(hexed, 16, -10).cast("bigint")
    if signed:
        bits = 64 - 8 * n
        value = F.when(n == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftright", F.call_function("shiftleft", value, bits), bits))
    return guarded(F.when(n == 0, F.lit(0).cast("bigint")).otherwise(value), n > 8, "too many bytes to convert to a 64 bit number")


def int_to_bytes(x: Column, endian: str = "little", size: int = 8) -> Column:
    """The two's complement in so many bytes, sign-extended or cut."""
    wide = F.lpad(F.hex(x.cast("bigint")), 16, "0")
    fill = F.when(x < 0, F.lit("FF")).otherwise(F.lit("00"))
    digits = F.concat(F.repeat(fill, F.lit(max(size - 8, 0))), wide)
    cut = F.substring(digits, 2 * (max(size, 8) - size) + 1, 2 * size)
    if endian == "little":
        cut = F.array_join(F.reverse(F.regexp_extract_all(cut, F.lit(".."), 0)), "")
    return F.unhex(cut)


def to_float(x: Column) -> Column:
    return x.cast("double")


def is_nan(x: Column) -> Column:
    return F.isnan(x)


def is_infinite(x: Column) -> Column:
    return F.abs(x) == float("inf")


def float_from_bytes(b: Column, endian: str = "little") -> Column:
    """IEEE double or single of 8 or 4 bytes."""
    mark = "<" if endian == "little" else ">"

    @F.arrow_udf("double")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else struct.unpack(mark + {8: "d", 4: "f"}[len(v)], v)[0] for v in values.to_pylist()], pa.float64())

    return run(b)


def float_to_bytes(x: Column, endian: str = "little", size: int = 8) -> Column:
    form = ("<" if endian == "little" else ">") + {8: "d", 4: "f"}[size]

    @F.arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else struct.pack(form, v) for v in values.to_pylist()], pa.binary())

    return run(x)


def decimal(x: Column, scale: int = 10) -> Column:
    """A decimal of fixed scale; text that isn't a number is an error."""
    return x.cast(f"decimal(38,{scale})")
