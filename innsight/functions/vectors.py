"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def double_array(df: DataFrame, name: str) -> Column:
    """The vector column as ``array<double>``, from an ML vector or any numeric array."""
    if isinstance(df.schema[name].dataType, VectorUDT):
        return vector_to_array(F.col(name))
    return F.col(name).cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def l2_norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when one of the norms is zero."""
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))


def has_nan(a: Column) -> Column:
    return F.exists(a, lambda x: F.isnan(x) | x.isNull())
