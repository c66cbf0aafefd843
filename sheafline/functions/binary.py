"""Bytes, versions, labels and types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import col, guarded


def to_bytes(x: Column) -> Column:
    """UTF-8 of a text."""
    return x.cast("binary")


def bytes_of_array(x: Column) -> Column:
    """Bytes of an array of integers from 0 to 255."""
    bad = F.exists(x, lambda v: (v < 0) | (v > 255))
    return guarded(F.unhex(F.array_join(F.transform(x, lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0")), "")), bad, "number must be between 0 and 255")


def array_of_bytes(b: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.hex(b), F.lit(".."), 0), lambda h: F.conv(h, 16, 10).cast("bigint"))


def length(b: Column) -> Column:
    return F.octet_length(b).cast("bigint")


def at(b: Column, index: int, default: int | None = None) -> Column:
    n = F.octet_length(b)
    i = F.lit(index) if index >= 0 else n + index
    inside = (i >= 0) & (i < n)
    value = F.when(inside, F.conv(F.hex(F.substring(b, i + 1, F.lit(1))), 16, 10).cast("bigint"))
    return F.coalesce(value, F.lit(default)) if default is not None else guarded(value, ~inside, "byte index out of bounds")


def slice_(b: Column, start: int, end: int | None = None) -> Column:
    n = F.octet_length(b)
    a = F.lit(start) if start >= 0 else n + start
    z = n if end is None else F.lit(end) if end >= 0 else n + end
    return guarded(F.substring(b, a + 1, F.greatest(z - a, F.lit(0))), (a < 0) | (z > n), "byte index out of bounds")


def version(s: Column) -> Column:
    """Components of a dotted version; arrays of them compare component by component."""
    return F.transform(F.split(s, r"\."), lambda x: x.cast("int"))


def version_at(v: Column, index: int) -> Column:
    """A component, 0 past the end."""
    return F.coalesce(F.get(v, F.lit(index)) if index >= 0 else F.try_element_at(v, F.lit(index)), F.lit(0))


def version_padded(v: Column, n: int) -> Column:
    """So many components, so that 1.2 and 1.2.0 compare as equal."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0), n)), 1, n)


def label(name: Column | str) -> Column:
    n = col(name)
    return guarded(n, n.isNull() | (n == ""), "label name must not be empty")


def type_of(x: Column) -> Column:
    return F.typeof(x)


def repr_(x: Column) -> Column:
    """JSON of nested values, else text."""
    return F.coalesce(F.to_json(F.struct(x.alias("v"))), F.lit("{}"))
