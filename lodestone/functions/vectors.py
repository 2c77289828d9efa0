"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if either vector is zero or null."""
    size = norm(a) * norm(b)
    return F.when(size > 0, 1 - dot(a, b) / size)


def unit_distance(a: Column, b: Column) -> Column:
    """1 - dot product of unit vectors, within [0, 2], as float: the form that media ranking uses."""
    return F.least(F.greatest(1 - dot(a, b), F.lit(0.0)), F.lit(2.0)).cast("float")


def normalised(v: Column) -> Column:
    """v over its length, or v if that is 0."""
    return F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(F.transform(v, lambda x: x.cast("double"))))[0]


def centroid(vectors: DataFrame, by: list[str], column: str = "embedding", dim: int | None = None) -> DataFrame:
    """Element-wise mean of each group's vectors of the right length, as `centroid`."""
    if dim:
        # One row of sums a task and group is exchanged, not a row for each component.
        return vectors.filter(F.size(column) == dim).groupBy(*by).agg(F.array(*[F.avg(F.get(column, F.lit(i)).cast("double")) for i in range(dim)]).alias("centroid"))
    rows = vectors
    means = rows.select(*by, F.posexplode(column).alias("__i", "__x")).groupBy(*by, "__i").agg(F.avg(F.col("__x").cast("double")).alias("__m"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"]).alias("centroid"))
