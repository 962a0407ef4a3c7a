"""Array expressions on vectors and label lists, kept JVM-side (higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often lambdas refer to it (a named
    column would be pasted into them by the optimiser)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a, b) -> Column:
    """Inner product of two equal-length numeric arrays."""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def sq_norm(a) -> Column:
    return F.aggregate(as_double(a), F.lit(0.0), lambda acc, x: acc + x * x)


def l2_normalize(v) -> Column:
    """v / ||v||; a zero (or null) vector gives NULL instead of NaNs."""
    # the norm is named: the optimiser would paste it into the division of every component
    return let(F.sqrt(sq_norm(v)), lambda n: F.when(n > 0, F.transform(as_double(v), lambda x: x / n)))


def sq_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)),
                       F.lit(0.0), lambda acc, x: acc + x)


def euclidean(a, b, eps: float = 1e-7) -> Column:
    """sqrt(max(squared distance, eps)): the floored form used by the pair losses."""
    return F.sqrt(F.greatest(sq_distance(a, b), F.lit(eps)))


def cosine(a, b) -> Column:
    return dot(a, b) / (F.sqrt(sq_norm(a)) * F.sqrt(sq_norm(b)))


def vscale(a, s) -> Column:
    s = _c(s) if not isinstance(s, (int, float)) else F.lit(float(s))
    return F.transform(as_double(a), lambda x: x * s)
