"""Errors where SQL would give null: strict conditions, assertions and equality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | object) -> Column:
    """A column as it is, anything else as a literal."""
    return x if isinstance(x, Column) else F.lit(x)


def guarded(value: Column, bad: Column, message: str) -> Column:
    """value, or an error with the message where bad holds."""
    return F.when(bad, F.raise_error(F.lit(message))).otherwise(value)


def strict(x: Column) -> Column:
    """A boolean that is not null, else an error: there is no third truth value."""
    return guarded(x, x.isNull(), "expected boolean, found none")


def all_of(*xs: Column) -> Column:
    """Strict `and`; the second operand counts only if the first is true."""
    out = strict(xs[-1])
    for x in reversed(xs[:-1]):
        out = F.when(strict(x), out).otherwise(F.lit(False))
    return out


def any_of(*xs: Column) -> Column:
    """Strict `or`; the second operand counts only if the first is false."""
    out = strict(xs[-1])
    for x in reversed(xs[:-1]):
        out = F.when(strict(x), F.lit(True)).otherwise(out)
    return out


def negate(x: Column) -> Column:
    return ~strict(x)


def same(a: Column, b: Column) -> Column:
    """Equality under which none equals none and nothing else."""
    return a.eqNullSafe(b)


def panic(*values: object) -> Column:
    return F.raise_error(F.concat(F.lit("panicked with: "), F.concat_ws(", ", *[col(v).cast("string") for v in values])))


def assert_that(condition: Column, message: str | None = None) -> Column:
    """null, or an error if the condition is false or null."""
    return F.assert_true(F.coalesce(condition, F.lit(False)), F.lit(message or "assertion failed"))


def assert_eq(a: Column, b: Column, message: str | None = None) -> Column:
    return assert_that(same(a, b), message or "equality assertion failed: values are not equal")


def assert_ne(a: Column, b: Column, message: str | None = None) -> Column:
    return assert_that(~same(a, b), message or "inequality assertion failed: values are equal")


def plus(a: Column, b: Column) -> Column:
    """Sum in which none is neutral."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def divide(a: Column, b: Column) -> Column:
    """Division of numbers: always a float, an error for a zero divisor."""
    return guarded(a.cast("double") / b, b == 0, "cannot divide by zero")


def minus(a: Column, b: Column) -> Column:
    """Difference; overflow is an error under ANSI, and so is none."""
    return guarded(a - b, a.isNull() | b.isNull(), "cannot subtract none")


def times(a: Column, b: Column) -> Column:
    """Product; overflow is an error under ANSI, and so is none."""
    return guarded(a * b, a.isNull() | b.isNull(), "cannot multiply none")


def negative(a: Column) -> Column:
    return guarded(-a, a.isNull(), "cannot negate none")
