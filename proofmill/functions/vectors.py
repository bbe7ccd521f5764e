"""Array and bit expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def each_with(a: Column, scalar: Column, fn) -> Column:
    """fn(element, scalar) per element; the scalar is computed once per array, not once per element."""
    return F.zip_with(a, F.array_repeat(scalar, F.size(a)), fn)


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a)


def variance(a: Column) -> Column:
    """Population variance."""
    squares = each_with(a, mean(a), lambda x, m: (x.cast("double") - m) * (x.cast("double") - m))
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def standardised(a: Column) -> Column:
    """Zero mean and unit length: dot products are Pearson's r, and distance^2 = 2 - 2r."""
    return unit(each_with(a, mean(a), lambda x, m: x.cast("double") - m))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Unit length; near-zero vectors stay as they are."""
    return each_with(a, norm(a), lambda x, n: x.cast("double") / F.when(n > 1e-6, n).otherwise(1.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
        F.lit(0.0), lambda s, x: s + x)


def bits_to_long(flags: Column) -> Column:
    """array<boolean>, first flag highest, to one long."""
    return F.aggregate(flags, F.lit(0).cast("long"),
                       lambda acc, f: F.shiftleft(acc, 1).bitwiseOR(f.cast("long")))


def difference_hash(values: Column) -> Column:
    """One bit per neighbouring pair: is the later value at least the earlier one?"""
    n = F.size(values)
    flags = F.zip_with(F.slice(values, 2, n - 1), F.slice(values, 1, n - 1), lambda later, earlier: later >= earlier)
    return bits_to_long(flags)


def sign_hash(values: Column) -> Column:
    """One bit per component: is it at least zero?"""
    return bits_to_long(F.transform(values, lambda x: x >= 0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bit_window(value: Column, low: int, width: int) -> Column:
    """`width` bits of a long starting at bit `low`."""
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
