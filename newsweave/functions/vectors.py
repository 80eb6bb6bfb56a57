"""Functions on vectors held as arrays."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, functions as F

__all__ = [
    "array_to_vector", "vector_to_array", "vector_text", "parsed_vector",
    "well_formed", "dot", "norm", "unit_vector", "cosine",
]


def vector_text(vector: Column) -> Column:
    """Numbers joined by commas."""
    return F.array_join(F.transform(vector, lambda x: x.cast("string")), ",")


def parsed_vector(text: Column, kind: str = "float") -> Column:
    """The inverse of :func:`vector_text`; an unreadable number becomes null."""
    return F.transform(F.split(text, ","), lambda part: part.try_cast(kind))


def well_formed(vector: Column) -> Column:
    """True for a vector with at least one number, all of them readable and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    squares = F.transform(vector, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def unit_vector(vector: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    length = norm(vector)
    scale = F.when(length > 0, length).otherwise(F.lit(1.0))
    # As a variable of an outer function the length is worked out once, not for each number.
    return F.get(F.transform(F.array(scale), lambda one: F.transform(vector, lambda x: x.cast("double") / one)), 0)


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity of one pair of vectors; 0 when one has no length."""
    lengths = norm(left) * norm(right)
    return F.when(lengths > 0, dot(left, right) / lengths).otherwise(F.lit(0.0))
