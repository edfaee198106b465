"""Vector functions as Columns over arrays of numbers, computed in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def with_bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is computed once a row however often f names it: also inside a lambda over an array."""
    return F.transform(F.array(value), f)[0]


def unit(v: Column | str, of_zero: float | None = None) -> Column:
    """Length one; a zero vector stays as it is, or has `of_zero` for each component."""
    v = doubles(v)
    zero = v if of_zero is None else F.array_repeat(F.lit(of_zero), F.size(v))
    return with_bound(norm(v), lambda n: F.when(n == 0, zero).otherwise(F.transform(v, lambda x: x / n)))


def rounded(x: Column, places: int) -> Column:
    """A double under 2^52 / 10^places rounded as SQL engines do, scaled, half away from zero, and with the sign kept of what
    rounds to zero: F.round gives 0.0 for -0.0. Greater ones, too, but for those near the largest double."""
    ten = F.lit(10.0**places)
    scaled = x * ten
    near = F.rint(scaled)  # halves to even
    return F.when(F.abs(scaled - near) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(near) / ten


def argmax(v: Column | str) -> Column:
    """Place, from 0, of the first of the largest."""
    v = doubles(v)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def softmax(v: Column | str) -> Column:
    v = doubles(v)
    powers = with_bound(F.array_max(v), lambda most: F.transform(v, lambda x: F.exp(x - most)))
    return with_bound(powers, lambda e: with_bound(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(e, lambda x: x / total)))
