"""Vector scalars over ``array<double>`` columns (JVM higher-order functions)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(u, v) -> Column:
    return F.aggregate(F.zip_with(_c(u), _c(v), lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b)


def norm(u) -> Column:
    return F.sqrt(dot(u, u))


def let(expr: Column, fn) -> Column:
    """Evaluate ``expr`` once, pass it to ``fn`` as a lambda variable."""
    return F.element_at(F.transform(F.array(expr), fn), 1)


def cosine_distance(u, v) -> Column:
    """``1 - u.v / (|u| |v|)``; NULL when either vector is all zero."""
    uv = F.struct(_c(u).alias("u"), _c(v).alias("v"))
    return let(uv, lambda p: F.lit(1.0) - F.try_divide(dot(p["u"], p["v"]), norm(p["u"]) * norm(p["v"])))


def is_zero(u) -> Column:
    return ~F.exists(_c(u), lambda x: x != F.lit(0.0))


def zeros(d: int) -> Column:
    return F.array_repeat(F.lit(0.0), d)


def literal(values) -> Column:
    """A small, bounded vector (model parameter) as one array literal."""
    return F.lit(np.asarray(values, dtype=np.float64))


def circular_correlation(a, b, d: int) -> Column:
    """``c_k = sum_i a_i * b_{(k+i) mod d}``; an all-zero operand is the identity.

    Native form (interpreted higher-order functions, O(d^2)) against which the
    tests hold the FFT form of :mod:`qaspark.operators.holographic`."""
    idx = F.sequence(F.lit(0), F.lit(d - 1))

    def body(p):
        x, y = p["a"], p["b"]
        full = F.transform(idx, lambda k: F.aggregate(
            idx, F.lit(0.0),
            lambda acc, i: acc + F.element_at(x, i + 1) * F.element_at(y, F.pmod(k + i, F.lit(d)) + 1)))
        return F.when(is_zero(x), y).when(is_zero(y), x).otherwise(full)
    return let(F.struct(_c(a).alias("a"), _c(b).alias("b")), body)


def fold_correlation(vecs, d: int) -> Column:
    """Left fold of :func:`circular_correlation` over an array of vectors, from zeros."""
    return F.aggregate(_c(vecs), zeros(d), lambda acc, v: circular_correlation(acc, v, d))
