"""The array algebra inside a row: every function takes and gives columns.

Indices count from 0, negative ones from the end.  What would be null for a
missing element is an error unless a default is given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.guards import col, guarded, same

Mapper = Callable[[Column], Column]
MISSING = object()


def length(a: Column) -> Column:
    return F.size(a).cast("bigint")


def _found(value: Column, ok: Column, default: object, message: str) -> Column:
    if default is MISSING:
        return guarded(value, ~ok, message)
    return F.when(ok, value).otherwise(col(default))


def _place(a: Column, index: Column | int) -> Column:
    i = col(index)
    return F.when(i < 0, F.size(a) + i).otherwise(i).cast("int")


def at(a: Column, index: Column | int, default: object = MISSING) -> Column:
    i = _place(a, index)
    return _found(F.get(a, i), (i >= 0) & (i < F.size(a)), default, "array index out of bounds")


def first(a: Column, default: object = MISSING) -> Column:
    return _found(F.get(a, F.lit(0)), F.size(a) > 0, default, "array is empty")


def last(a: Column, default: object = MISSING) -> Column:
    return _found(F.try_element_at(a, F.lit(-1)), F.size(a) > 0, default, "array is empty")


def push(a: Column, value: Column) -> Column:
    return F.array_append(a, value)


def pop(a: Column) -> Column:
    """{rest, value} without and of the last element."""
    return F.struct(guarded(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.size(a) == 0, "array is empty").alias("rest"), F.try_element_at(a, F.lit(-1)).alias("value"))


def insert(a: Column, index: Column | int, value: Column) -> Column:
    """Before the element at index; -1 is before the last."""
    i = _place(a, index)
    out = F.concat(F.slice(a, F.lit(1), F.greatest(i, F.lit(0))), F.array(value), F.slice(a, i + 1, F.greatest(F.size(a) - i, F.lit(0))))
    return F.when((i < 0) | (i > F.size(a)), F.raise_error("array index out of bounds")).otherwise(out)


def remove(a: Column, index: Column | int) -> Column:
    """{rest, value} without and of the element at index."""
    i = _place(a, index)
    rest = F.concat(F.slice(a, F.lit(1), F.greatest(i, F.lit(0))), F.slice(a, F.greatest(i, F.lit(0)) + 2, F.greatest(F.size(a) - i - 1, F.lit(0))))
    return F.struct(F.when((i < 0) | (i >= F.size(a)), F.raise_error("array index out of bounds")).otherwise(rest).alias("rest"), F.get(a, i).alias("value"))


def slice_(a: Column, start: Column | int, end: Column | int | None = None, count: Column | int | None = None) -> Column:
    """From start to before end, or count elements; nothing if end is before start."""
    i = _place(a, start)
    j = i + col(count) if count is not None else F.size(a) if end is None else _place(a, end)
    bad = (i < 0) | (i > F.size(a)) | (j < 0) | (j > F.size(a))
    cut = F.slice(a, F.greatest(i, F.lit(0)) + 1, F.greatest(j - i, F.lit(0)))
    return F.when(bad, F.raise_error("array index out of bounds")).otherwise(cut)


def contains(a: Column, value: Column) -> Column:
    return F.exists(a, lambda x: same(x, value))


def find(a: Column, test: Mapper) -> Column:
    return F.get(F.filter(a, test), F.lit(0))


def position(a: Column, test: Mapper) -> Column:
    hits = F.filter(F.transform(a, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())
    return F.get(hits, F.lit(0)).cast("bigint")


def range_(start: Column | int, end: Column | int, step: int = 1, inclusive: bool = False) -> Column:
    """Integers from start towards end; none where the step leads away from it."""
    if step == 0:
        raise ValueError("number must not be zero")
    a, z = col(start).cast("bigint"), col(end).cast("bigint")
    stop = z if inclusive else z - (1 if step > 0 else -1)
    some = a <= stop if step > 0 else a >= stop
    return F.when(some, F.sequence(a, F.when(some, stop).otherwise(a), F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def filter_(a: Column, test: Mapper) -> Column:
    return F.filter(a, lambda x: guarded(test(x), test(x).isNull(), "expected boolean, found none"))


def map_(a: Column, mapper: Mapper) -> Column:
    return F.transform(a, mapper)


def enumerate_(a: Column, start: int = 0) -> Column:
    return F.transform(a, lambda x, i: F.struct((i + start).cast("bigint").alias("index"), x.alias("value")))


def zip_(*arrays: Column, exact: bool = False) -> Column:
    """Structs of the elements at one place, as many as the shortest array has."""
    sizes = [F.size(a) for a in arrays]
    n = F.least(*sizes) if len(sizes) > 1 else sizes[0]
    zipped = F.slice(F.arrays_zip(*[a.alias(f"_{k}") for k, a in enumerate(arrays)]), F.lit(1), n)
    return guarded(zipped, F.greatest(*sizes) != n, "arrays must have the same length") if exact and len(sizes) > 1 else zipped


def fold(a: Column, init: Column, folder: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(a, init, folder)


def reduce_(a: Column, reducer: Callable[[Column, Column], Column]) -> Column:
    """A fold that begins with the first element; none for an empty array."""
    return F.when(F.size(a) > 0, F.aggregate(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.get(a, F.lit(0)), reducer))


def sum_(a: Column, zero: Column, default: object = MISSING) -> Column:
    return _found(F.aggregate(a, zero, lambda s, x: s + x), F.size(a) > 0, default, "cannot calculate sum of empty array with no default")


def product(a: Column, one: Column, default: object = MISSING) -> Column:
    return _found(F.aggregate(a, one, lambda p, x: p * x), F.size(a) > 0, default, "cannot calculate product of empty array with no default")


def any_(a: Column, test: Mapper) -> Column:
    return F.exists(a, test)


def all_(a: Column, test: Mapper) -> Column:
    return F.forall(a, test)


def flatten(a: Column, depth: int = 1) -> Column:
    """Down to the leaves: depth is the number of static nesting levels above them."""
    for _ in range(depth):
        a = F.flatten(a)
    return a


def spread(*parts: Column) -> Column:
    """One array of all parts' elements; a part that is none adds nothing."""
    return F.concat(*[F.coalesce(p, F.array()) for p in parts])


def rev(a: Column) -> Column:
    return F.reverse(a)


def split(a: Column, separator: Column, kind: str) -> Column:
    """Pieces between the elements equal to separator; kind is the type of an element."""
    end = F.aggregate(
        a, F.struct(F.array().cast(f"array<array<{kind}>>").alias("done"), F.array().cast(f"array<{kind}>").alias("open")),
        lambda s, x: F.when(same(x, separator), F.struct(F.array_append(s["done"], s["open"]).alias("done"), F.array().cast(f"array<{kind}>").alias("open")))
        .otherwise(F.struct(s["done"].alias("done"), F.array_append(s["open"], x).alias("open"))),
    )
    return F.array_append(end["done"], end["open"])


def join(a: Column, separator: str = "", last: str | None = None, default: object = None) -> Column:
    """Texts put together; another separator may stand before the last."""
    out = F.array_join(a, separator)
    if last is not None:
        head = F.array_join(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), separator)
        out = F.when(F.size(a) > 1, F.concat(head, F.lit(last), F.try_element_at(a, F.lit(-1)))).otherwise(out)
    return F.when(F.size(a) > 0, out).otherwise(col(default))


def intersperse(a: Column, separator: Column) -> Column:
    return F.slice(F.flatten(F.transform(a, lambda x: F.array(x, separator))), F.lit(1), F.greatest(2 * F.size(a) - 1, F.lit(0)))


def _starts(n: Column, step: int, kind: str = "array<int>") -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast(kind))


def chunks(a: Column, size: int, exact: bool = False) -> Column:
    """Pieces of so many elements; exact drops a shorter last one."""
    n = F.size(a) - F.size(a) % size if exact else F.size(a)
    return F.transform(_starts(n, size), lambda i: F.slice(a, i + 1, size))


def windows(a: Column, size: int) -> Column:
    """All runs of exactly so many neighbours."""
    return F.transform(_starts(F.size(a) - size + 1, 1), lambda i: F.slice(a, i + 1, size))


def sorted_(a: Column, key: Mapper | None = None) -> Column:
    """Stable, by a key; null keys can't be compared."""
    by = key or (lambda x: x)
    keyed = F.transform(a, lambda x, i: F.struct(by(x).alias("key"), i.alias("i"), x.alias("x")))
    out = F.transform(F.array_sort(keyed), lambda s: s["x"])
    return guarded(out, F.exists(a, lambda x: by(x).isNull()), "cannot compare none")


def sorted_by(a: Column, in_order: Callable[[Column, Column], Column]) -> Column:
    """Stable, by a test whether two elements stand in order."""
    placed = F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    compare = lambda p, q: F.when(in_order(p["x"], q["x"]) & in_order(q["x"], p["x"]), F.when(p["i"] < q["i"], -1).when(p["i"] > q["i"], 1).otherwise(0)).when(in_order(p["x"], q["x"]), -1).otherwise(1)
    return F.transform(F.array_sort(placed, compare), lambda s: s["x"])


def dedup(a: Column, key: Mapper | None = None) -> Column:
    """The first of the elements with one key, in their order."""
    if key is None:
        return F.array_distinct(a)
    keys = F.transform(a, key)
    return F.filter(a, lambda x, i: ~F.exists(F.slice(keys, F.lit(1), i), lambda k: same(k, key(x))))


def to_dict(pairs: Column) -> Column:
    """A map of {key, value} structs: the last value counts, at the first place of its key."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    of = lambda k: F.try_element_at(F.filter(pairs, lambda p: same(p["key"], k)), F.lit(-1))["value"]
    return F.map_from_arrays(keys, F.transform(keys, of))
