"""Dictionaries as maps, and bundles of arguments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.guards import col, guarded
from .arrays import MISSING, _found

Mapper = Callable[[Column], Column]


def construct(**entries: Column) -> Column:
    """A dictionary of named values of one type, in the order they are given."""
    return F.map_from_arrays(F.array(*[F.lit(k) for k in entries]), F.array(*entries.values()))


def length(m: Column) -> Column:
    return F.size(m).cast("bigint")


def at(m: Column, key: Column | str, default: object = MISSING) -> Column:
    k = col(key)
    return _found(F.try_element_at(m, k), F.map_contains_key(m, k), default, "dictionary does not contain the key")


def insert(m: Column, key: Column | str, value: Column) -> Column:
    """Replaces at its place, or adds at the end."""
    k = col(key)
    entry = F.map_from_arrays(F.array(k), F.array(value))
    replaced = F.transform_values(m, lambda key_, v: F.when(key_ == k, value).otherwise(v))
    return F.when(F.map_contains_key(m, k), replaced).otherwise(F.map_concat(F.map_filter(m, lambda key_, _: key_ != k), entry))


def remove(m: Column, key: Column | str, default: object = MISSING) -> Column:
    """{rest, value}; the others keep their order."""
    k = col(key)
    return F.struct(F.map_filter(m, lambda key_, _: key_ != k).alias("rest"), at(m, k, default).alias("value"))


def keys(m: Column) -> Column:
    return F.map_keys(m)


def values(m: Column) -> Column:
    return F.map_values(m)


def pairs(m: Column) -> Column:
    return F.map_entries(m)


def filter_(m: Column, test: Mapper) -> Column:
    """By value."""
    return F.map_filter(m, lambda _, v: guarded(test(v), test(v).isNull(), "expected boolean, found none"))


def map_(m: Column, mapper: Mapper) -> Column:
    """Of values."""
    return F.transform_values(m, lambda _, v: mapper(v))


def merge(a: Column, b: Column) -> Column:
    """Entries of both; where both have a key, b's value at a's place."""
    kept = F.transform_values(a, lambda k, v: F.when(F.map_contains_key(b, k), F.try_element_at(b, k)).otherwise(v))
    return F.map_concat(kept, F.map_filter(b, lambda k, _: ~F.map_contains_key(a, k)))


def equal(a: Column, b: Column) -> Column:
    """The same entries in any order."""
    return F.array_sort(F.map_entries(a)).eqNullSafe(F.array_sort(F.map_entries(b)))


def rest_of(m: Column, used: list[str]) -> Column:
    """What a destructuring leaves for its rest."""
    return F.map_filter(m, lambda k, _: ~k.isin(used))


def arguments(positional: Column, named: Column) -> Column:
    """A bundle {pos, named}."""
    return F.struct(positional.alias("pos"), named.alias("named"))


def args_len(a: Column) -> Column:
    return (F.size(a["pos"]) + F.size(a["named"])).cast("bigint")


def args_at(a: Column, key: int | str, default: object = MISSING) -> Column:
    if isinstance(key, str):
        return at(a["named"], key, default)
    i = F.lit(key) if key >= 0 else F.size(a["pos"]) + key
    return _found(F.get(a["pos"], i), (i >= 0) & (i < F.size(a["pos"])), default, "arguments do not contain the key")


def args_filter(a: Column, test: Mapper) -> Column:
    return arguments(F.filter(a["pos"], test), filter_(a["named"], test))


def args_map(a: Column, mapper: Mapper) -> Column:
    return arguments(F.transform(a["pos"], mapper), map_(a["named"], mapper))
