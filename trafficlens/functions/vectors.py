"""Expressions on feature vectors held as ARRAY<DOUBLE>."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def fit_width(vector: Column, width: int = 76) -> Column:
    """Pad with zeros or cut, so that every vector has ``width`` values."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0), width)), 1, width)


def argmax(scores: Column) -> Column:
    """Zero-based position of the first largest value."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
