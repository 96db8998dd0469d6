"""Vector functions as columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine clipped to 0 and 1; 0 for a zero vector, null for a null one. Raises for empty or unequally long vectors."""
    lengths = F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), F.raise_error(F.lit("vectors must have one positive length")).cast("double"))
    both = norm(a) * norm(b)
    return F.coalesce(lengths, F.when(both == 0, 0.0).when(both.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(both, F.lit(0.0))))))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def unit(v: Column) -> Column:
    """Length 1; a zero vector stays zero."""
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def similarity_of_distance(distance: Column) -> Column:
    """Similarity of unit vectors from their Euclidean distance."""
    return 1 - distance * distance / 2
