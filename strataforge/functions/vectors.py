"""Arithmetic on array<double> columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is made once for a row, however often ``f`` and the lambdas in it look at it."""
    return F.transform(F.array(x), f)[0]


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def unit(x: Column) -> Column:
    """``x`` at length 1; a length under 1e-12 counts as 1e-12."""
    return once(F.greatest(norm(x), F.lit(1e-12)), lambda size: F.transform(x, lambda v: v / size))


def as_double(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def literal(rows: Sequence[Sequence[float]]) -> Column:
    """A small fixed matrix, such as class means, as array<array<double>>."""
    return F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in rows])


def logsumexp(z: Column) -> Column:
    return once(F.array_max(z), lambda top: top + F.log(total(F.transform(z, lambda v: F.exp(v - top)))))


def softmax(z: Column, temperature: float = 1.0) -> Column:
    scaled = F.transform(z, lambda v: v / F.lit(temperature))
    return once(scaled, lambda s: once(logsumexp(s), lambda whole: F.transform(s, lambda v: F.exp(v - whole))))


def entropy(p: Column) -> Column:
    """-sum p ln p, with p cut off at 1e-12 within the logarithm."""
    return -total(F.transform(p, lambda v: v * F.log(F.greatest(v, F.lit(1e-12)))))


def argmax(x: Column) -> Column:
    """Position from 0 of the largest value; the first of equal ones."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def mixture(p: Column, q: Column, weight: float) -> Column:
    """ln(weight * p + (1 - weight) * q) by element."""
    return F.zip_with(p, q, lambda a, b: F.log(F.lit(weight) * a + F.lit(1 - weight) * b))
