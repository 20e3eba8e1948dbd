"""Vector expressions over array<double> columns. Dimension is whatever the data has."""
from pyspark.sql import Column, functions as F

from . import fixed


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def unit(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(1e-9))
    return F.transform(a, lambda x: x / n)


def blend(q: Column, hint: Column, w: float = fixed.NICHE_WEIGHT) -> Column:
    """Pull a query toward a style direction; unknown styles leave it unchanged."""
    return F.when(hint.isNull(), q).otherwise(unit(F.zip_with(q, hint, lambda x, h: x + F.lit(w) * h)))


def softmax(scores: Column, temp: float = 100.0) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp((x - top) * F.lit(temp)))
    total = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    return F.transform(e, lambda x: x / total)
