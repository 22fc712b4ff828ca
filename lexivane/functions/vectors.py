"""Vector arithmetic over ``array`` columns, in double precision on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Distances closer than this many decimals tie; the id then decides the rank.
RANK_DECIMALS = 9


def dot(a: Column, b: Column) -> Column:
    """Null when the lengths differ or an element is null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(a: Column) -> Column:
    squares = F.aggregate(
        a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def cosine_distance(a: Column, b: Column, b_norm: Column | None = None) -> Column:
    """1 - cosine; null for a zero vector or vectors of different length."""
    scale = norm(a) * (norm(b) if b_norm is None else b_norm)
    return F.lit(1.0) - F.try_divide(dot(a, b), scale)


def similarity(distance: Column) -> Column:
    """1 at distance 0, falling towards 0."""
    return F.lit(1.0) / (F.lit(1.0) + F.greatest(distance, F.lit(0.0)))


def l2_normalize(a: Column) -> Column:
    """Unit length in single precision; a zero vector becomes null."""
    size = norm(a)
    unit = F.transform(a, lambda x: (x.cast("double") / size).cast("float"))
    return F.when(size > 0, unit)


def rank_key(distance: Column) -> Column:
    return F.round(distance, RANK_DECIMALS).asc_nulls_last()
