"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Scalar product, accumulated in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine within [-1, 1]; NaN where a vector is zero, as in the store this follows, and null where one is null."""
    value = F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(float("nan")))
    bounded = F.when(F.isnan(value), value).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))
    return F.when(a.isNotNull() & b.isNotNull(), bounded)


def has_dimension(a: Column, dimension: int) -> Column:
    return F.coalesce(F.size(a) == dimension, F.lit(False))


def parse_vector(text: Column) -> Column:
    """``[1,2.5]`` as floats; empty brackets are an empty array and null stays null."""
    inner = F.regexp_replace(text, r"^\s*\[|\]\s*$", "")
    parts = F.filter(F.split(inner, ","), lambda x: F.trim(x) != "")
    return F.transform(parts, lambda x: F.trim(x).cast("float"))
