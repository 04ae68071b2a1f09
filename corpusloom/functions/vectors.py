"""Vector arithmetic on ``array<float>`` columns, in double, as native expressions.

These serve per-row work. Searches over many pairs go through
``operators.nearest``, which multiplies whole Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-8  # fixed value: the floor of a norm in the cosine


def _total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)


def as_double(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(c: Column) -> Column:
    return F.sqrt(dot(c, c))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_total(F.zip_with(
        as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column) -> Column:
    floor = F.lit(NORM_FLOOR)
    return dot(a, b) / (F.greatest(norm(a), floor) * F.greatest(norm(b), floor))


def normalize(c: Column) -> Column:
    """Divide by the L2 norm; a zero vector stays zero.

    The norm is bound to a lambda variable: written into the inner lambda it
    would be computed anew for every element.
    """
    bound = F.array(F.struct(as_double(c).alias("v"), norm(c).alias("n")))
    scaled = F.transform(bound, lambda b: F.when(
        b["n"] > 0, F.transform(b["v"], lambda x: x / b["n"])).otherwise(b["v"]))
    return F.get(scaled, F.lit(0))


def affine(c: Column, scale: float, shift: float = 0.0) -> Column:
    return F.transform(as_double(c), lambda x: x * F.lit(float(scale)) + F.lit(float(shift)))


def negate(c: Column) -> Column:
    return affine(c, -1.0)


def to_float(c: Column) -> Column:
    return c.cast("array<float>")


def to_codes(c: Column) -> Column:
    """Signed 16-bit codes; a value out of range is an error under ANSI mode."""
    return c.cast("array<smallint>")


def checked_dim(c: Column, dim: int | Column) -> Column:
    """The vector itself, or an error at run time if it is not ``dim`` wide."""
    want = F.lit(dim) if isinstance(dim, int) else dim
    message = F.concat(F.lit("vector of width "), F.size(c).cast("string"),
                       F.lit(" where "), want.cast("string"), F.lit(" was expected"))
    return F.when(F.size(c) == want, c).otherwise(F.raise_error(message))
