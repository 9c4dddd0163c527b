"""Vector expressions over array columns, in Catalyst's higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cosine; a zero vector is at distance 1 from everything. Pass norms that are columns already."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(size > 0, 1 - dot(a, b) / size).otherwise(F.lit(1.0))


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def let(value: Column, body) -> Column:
    """body(value), with value computed once: what a lambda mentions besides its arguments is computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def l2_normalize(a: Column) -> Column:
    """a over its length; a zero vector stays as it is."""
    return let(norm(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))


def softmax(values: Column, temperature: float = 1.0) -> Column:
    """Softmax of an array, shifted by its maximum."""

    def shares(powers: Column) -> Column:
        return let(F.aggregate(powers, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(powers, lambda p: p / total))

    return let(F.array_max(values), lambda top: let(F.transform(values, lambda x: F.exp((x - top) / temperature)), shares))
