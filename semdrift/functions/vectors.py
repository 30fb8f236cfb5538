"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def usable(a: Column, dim: int | None = None) -> Column:
    """Whether a vector can be compared: not NULL, no NULL or NaN in it, and of ``dim`` numbers where that is given."""
    whole = a.isNotNull() & ~F.exists(a, lambda x: x.isNull() | F.isnan(x.cast("double")))
    if dim is not None:
        whole &= F.size(a) == dim
    return F.coalesce(whole, F.lit(False))


def split_vectors(points: DataFrame, vec_col: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(points with a usable vector, rejects)."""
    good = usable(F.col(vec_col), dim)
    return points.filter(good), points.filter(~good)


def unit(a: Column, floor: float = 1e-12) -> Column:
    """The length stands beside the elements: inside the function of each element it would be computed once for each of them."""
    size = F.greatest(norm(a), F.lit(floor))
    return F.zip_with(a, F.array_repeat(size, F.size(a)), lambda x, s: x / s)
