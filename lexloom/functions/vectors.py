"""Vectors as arrays of floats; sums run in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZERO = 0.0


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(ZERO), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(F.try_divide(dot(a, b), norms))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def distance_score(distance: Column) -> Column:
    return 1 / (1 + distance)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def mean_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, centroid): element-wise means; partial sums by (key, place) before the shuffle."""
    parts = vectors.select(key, F.posexplode(vector).alias("place", "x")).groupBy(key, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("xs"))
    return rows.select(key, F.transform("xs", lambda s: s["x"]).alias("centroid"))
