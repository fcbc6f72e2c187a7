"""Vector and numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for other lengths or a zero vector."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), dot(a, b) / scale).otherwise(0.0)


def dot_over_square_norms(a: Column, b: Column) -> Column:
    """Inner product over the product of squared norms: equals the cosine for unit vectors only."""
    scale = dot(a, a) * dot(b, b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), dot(a, b) / scale).otherwise(0.0)


def shifted_cosine(a: Column, b: Column) -> Column:
    """Cosine mapped to 0..1."""
    return (1 + cosine(a, b)) / 2


def l2_normalise(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def to_vector(texts: Column) -> Column:
    """Numbers among a list of texts, the others skipped."""
    return F.filter(F.transform(texts, lambda x: x.try_cast("float")), lambda x: x.isNotNull())


def has_dimensions(a: Column, n: int) -> Column:
    return F.coalesce(F.size(a) == n, F.lit(False))


def backoff_seconds(attempt: Column, initial: float = 1.0, factor: float = 2.0, most: float = 60.0) -> Column:
    return F.least(F.lit(initial) * F.pow(F.lit(factor), attempt - 1), F.lit(most))
