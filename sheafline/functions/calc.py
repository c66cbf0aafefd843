"""Mathematics with errors instead of nulls and NaNs."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import col, guarded

# Fixed values.
INF, NAN, PI, TAU, E = math.inf, math.nan, math.pi, math.tau, math.e

LONG_MAX = (1 << 63) - 1


def abs_(x: Column) -> Column:
    return F.abs(x)  # overflow is an error under ANSI


def pow_(base: Column, exponent: Column | int) -> Column:
    """Integer to a non-negative integer power, exactly; overflow and 0^0 are errors."""
    e = col(exponent)
    power = F.aggregate(F.when(e > 0, F.sequence(F.lit(1), e.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(1).cast("bigint"), lambda p, _: p * base.cast("bigint"))
    return guarded(guarded(power, (base == 0) & (e == 0), "zero to the power of zero is undefined"), e < 0, "exponent must be non-negative for integers")


def pow_float(base: Column, exponent: Column) -> Column:
    out = F.pow(base, exponent)
    return guarded(guarded(out, F.isnan(out), "the result is not a real number"), (base == 0) & (exponent == 0), "zero to the power of zero is undefined")


def exp(x: Column) -> Column:
    out = F.exp(x)
    return guarded(out, F.isnan(out), "the result is not a real number")


def sqrt(x: Column) -> Column:
    return guarded(F.sqrt(x), x < 0, "cannot take square root of negative number")


def root(x: Column, index: Column | int) -> Column:
    n = col(index)
    out = F.signum(x) * F.pow(F.abs(x), 1.0 / n)
    return guarded(guarded(out, (x < 0) & (n % 2 == 0), "negative numbers do not have a real nth root when n is even"), n == 0, "cannot take the 0th root of a number")


sin, cos, tan, atan = F.sin, F.cos, F.tan, F.atan
sinh, cosh, tanh, asinh = F.sinh, F.cosh, F.tanh, F.asinh


def asin(x: Column) -> Column:
    return guarded(F.asin(x), F.abs(x) > 1, "value must be between -1 and 1")


def acos(x: Column) -> Column:
    return guarded(F.acos(x), F.abs(x) > 1, "value must be between -1 and 1")


def atan2(x: Column, y: Column) -> Column:
    """The angle of the point (x, y): arguments stand in this order."""
    return F.atan2(y, x)


def acosh(x: Column) -> Column:
    return guarded(F.acosh(x), x < 1, "value must be greater than or equal to 1")


def atanh(x: Column) -> Column:
    return guarded(F.atanh(x), F.abs(x) >= 1, "value must be between -1 and 1 (exclusive)")


def log(x: Column, base: Column | float = 10.0) -> Column:
    b = col(base)
    out = F.when(b == 10.0, F.log10(x)).when(b == 2.0, F.log2(x)).otherwise(F.log(x) / F.log(b))
    return guarded(guarded(out, b <= 0, "base must be strictly positive"), x <= 0, "value must be strictly positive")


def ln(x: Column) -> Column:
    return guarded(F.log(x), x <= 0, "value must be strictly positive")


def erf(x: Column) -> Column:
    """The error function; Spark has none, so Arrow batches go through Python."""

    @F.arrow_udf("double")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else math.erf(v) for v in values.to_pylist()], pa.float64())

    return run(x.cast("double"))


def fact(n: Column) -> Column:
    return guarded(F.factorial(n.cast("int")), (n < 0) | (n > 20), "the result is too large")


def perm(n: Column, k: Column) -> Column:
    steps = F.when((k > 0) & (k <= n), F.sequence(n - k + 1, n)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n, F.lit(0).cast("bigint")).otherwise(F.aggregate(steps, F.lit(1).cast("bigint"), lambda p, x: p * x))


def binom(n: Column, k: Column) -> Column:
    """n over k; each partial product is a binomial coefficient, so division is exact."""
    small = F.least(k, n - k)
    steps = F.when(small > 0, F.sequence(F.lit(0).cast("bigint"), small - 1)).otherwise(F.array().cast("array<bigint>"))
    folded = F.aggregate(steps, F.lit(1).cast("bigint"), lambda r, i: ((r * (n - i) - (r * (n - i)) % (i + 1)) / (i + 1)).cast("bigint"))
    return F.when(k > n, F.lit(0).cast("bigint")).otherwise(folded)


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm in at most 92 steps, which suffice for 64-bit integers."""
    start = F.struct(F.abs(a).cast("bigint").alias("a"), F.abs(b).cast("bigint").alias("b"))
    end = F.aggregate(
        F.sequence(F.lit(1), F.lit(92)), start,
        lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("bigint")).otherwise(s["a"] % F.when(s["b"] != 0, s["b"])).alias("b")),
    )
    return end["a"]


def lcm(a: Column, b: Column) -> Column:
    d = gcd(a, b)
    return F.when((a == 0) | (b == 0), F.lit(0).cast("bigint")).otherwise(F.abs(((a - a % F.when(d != 0, d)) / F.when(d != 0, d)).cast("bigint") * b))


def floor(x: Column) -> Column:
    return F.floor(x).cast("bigint")


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("bigint")


def trunc(x: Column) -> Column:
    return x.cast("bigint")


def fract(x: Column) -> Column:
    return x - x.cast("bigint")


def round_(x: Column, digits: int = 0) -> Column:
    """Half away from zero; negative digits round before the point."""
    return F.round(x, digits)


def clamp(x: Column, low: Column | object, high: Column | object) -> Column:
    lo, hi = col(low), col(high)
    return guarded(F.least(F.greatest(x, lo), hi), hi < lo, "max must be greater than or equal to min")


def min_(*xs: Column) -> Column:
    if not xs:
        raise ValueError("expected at least one value")
    return F.least(*xs) if len(xs) > 1 else xs[0]


def max_(*xs: Column) -> Column:
    if not xs:
        raise ValueError("expected at least one value")
    return F.greatest(*xs) if len(xs) > 1 else xs[0]


def even(x: Column) -> Column:
    return x % 2 == 0


def odd(x: Column) -> Column:
    return x % 2 != 0


def _divisor(value: Column, b: Column) -> Column:
    return guarded(value, b == 0, "divisor must not be zero")


def rem(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend."""
    return _divisor(a % F.when(b != 0, b), b)


def rem_euclid(a: Column, b: Column) -> Column:
    """Remainder that is never negative, whatever the divisor's sign."""
    m = F.abs(F.when(b != 0, b))
    return _divisor(((a % m) + m) % m, b)


def div_euclid(a: Column, b: Column) -> Column:
    """The quotient that belongs to rem_euclid, as an integer."""
    d = F.when(b != 0, b)
    m = F.abs(d)
    return _divisor(((a - ((a % m) + m) % m) / d).cast("bigint"), b)


def quo(a: Column, b: Column) -> Column:
    """Quotient rounded towards minus infinity, as an integer; exact for integers."""
    d = F.when(b != 0, b)
    return _divisor(F.floor((a - (((a % d) + d) % d)) / d).cast("bigint"), b)


def norm(values: Column, p: float = 2.0) -> Column:
    """p-norm of an array of doubles, scaled by its largest magnitude; 0 for none."""
    if p <= 0:
        raise ValueError("p must be greater than zero")
    largest = F.array_max(F.transform(values, F.abs))
    if math.isinf(p):
        return F.coalesce(largest, F.lit(0.0))
    scaled = F.aggregate(values, F.lit(0.0), lambda s, x: s + F.pow(F.abs(x) / F.when(largest != 0, largest), F.lit(p)))
    return F.when(largest.isNull() | (largest == 0), F.lit(0.0)).otherwise(F.pow(scaled, F.lit(1.0 / p)) * largest)
