"""Vector arithmetic on array<double> columns, inside the JVM.

Vectors of null or of different lengths give null. Float arrays are computed in double.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metrics where a larger value is closer, and where a smaller one is.
SIMILARITIES, DISTANCES = ("cosine", "dot"), ("euclidean",)


def doubles(v: Column) -> Column:
    """The vector in double."""
    return v.cast("array<double>")


def total(v: Column) -> Column:
    """Sum of the elements; 0 for an empty vector."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Dot product."""
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 if either vector has no length. Known lengths can be passed in, so that a
    pair costs one dot product."""
    na, nb = (norm(a) if norm_a is None else norm_a), (norm(b) if norm_b is None else norm_b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def normalize(v: Column) -> Column:
    """The vector at length 1; a vector without length stays."""
    n = norm(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n))


def score(metric: str, a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """The metric of two vectors."""
    if metric == "cosine":
        return cosine(a, b, norm_a, norm_b)
    if metric == "dot":
        return dot(a, b)
    if metric == "euclidean":
        return euclidean(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def closer_first(metric: str, c: Column) -> Column:
    """Sort order that puts the closest first, and what has no score last."""
    return c.asc_nulls_last() if metric in DISTANCES else c.desc()


def within(metric: str, c: Column, threshold: float) -> Column:
    """Whether a score reaches the threshold: at least for similarities, at most for distances."""
    return c <= threshold if metric in DISTANCES else c >= threshold


def pool(tokens: Column, mask: Column, how: str) -> Column:
    """One vector from token vectors (array<array<double>>) and their 0/1 mask.

    mean: sum of masked vectors over their number, which counts 1e-9 at least; cls: the first vector;
    max: element-wise, where masked-out vectors count -1e9.
    """
    if how == "cls":
        return F.get(tokens, F.lit(0))
    if how == "mean":
        masked = F.zip_with(tokens, mask, lambda v, m: F.transform(v, lambda x: x * m))
        zero = F.transform(F.get(tokens, F.lit(0)), lambda x: x * 0.0)
        sums = F.aggregate(masked, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
        n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, x: a + x), F.lit(1e-9))
        return F.transform(sums, lambda x: x / n)
    if how == "max":
        masked = F.zip_with(tokens, mask, lambda v, m: F.when(m > 0, v).otherwise(F.transform(v, lambda x: x * 0.0 - 1e9)))
        first = F.get(masked, F.lit(0))
        return F.aggregate(masked, first, lambda a, v: F.zip_with(a, v, lambda x, y: F.greatest(x, y)))
    raise ValueError(f"unknown pooling {how!r}")


def element_aggregates(v: Column, size: int, how: str) -> list[Column]:
    """One aggregate per element of a vector of known size: a single pass with map-side combining."""
    f = {"mean": F.avg, "sum": F.sum}[how]
    return [f(F.get(doubles(v), F.lit(k))) for k in range(size)]


def all_of(conditions: list[Column]) -> Column:
    """Conjunction; true for none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
