"""Vector expressions; sums run in double and in the order of the elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where one is all zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def usable(v: Column, dim: int = DIM) -> Column:
    """Whether a vector has dim finite elements that aren't all zero; false for null."""
    ok = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


def mean_vector(v: Column, dim: int = DIM) -> Column:
    """Aggregate: the mean of vectors, element by element."""
    return F.array(*(F.avg(F.get(v, F.lit(i)).cast("double")) for i in range(dim)))


def maxsim(query: Column, patches: Column) -> Column:
    """Sum over the query's vectors of the best dot product with a patch."""
    best = F.transform(query, lambda q: F.array_max(F.transform(patches, lambda p: dot(q, p))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)
