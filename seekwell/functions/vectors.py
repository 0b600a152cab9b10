"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from seekwell.scale import let


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _d(col) -> Column:
    return _c(col).cast("array<double>")


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def vec_dot(a, b) -> Column:
    return _sum(F.zip_with(_d(a), _d(b), lambda x, y: x * y))


def vec_norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_d(a), lambda x: x * x)))


def vec_l2(a, b) -> Column:
    """Euclidean distance."""
    return F.sqrt(_sum(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y))))


def vec_cos(a, b) -> Column:
    return F.try_divide(vec_dot(a, b), vec_norm(a) * vec_norm(b))


def l2_normalize(a) -> Column:
    return F.transform(F.arrays_zip(_d(a).alias("x"), F.array_repeat(vec_norm(a), F.size(_c(a))).alias("n")), lambda s: F.when(s["n"] > 0, s["x"] / s["n"]).otherwise(F.lit(0.0)))


def min_max(a) -> Column:
    """Scale one row to 0..1; a constant row becomes zeros."""
    low, high = F.array_min(_d(a)), F.array_max(_d(a))
    bounds = F.array_repeat(F.struct(low.alias("lo"), high.alias("hi")), F.size(_c(a)))
    return F.zip_with(_d(a), bounds, lambda x, b: F.when(b["hi"] > b["lo"], (x - b["lo"]) / (b["hi"] - b["lo"])).otherwise(F.lit(0.0)))


def mix(a, b, ratio: float) -> Column:
    """``ratio * a + (1 - ratio) * b``."""
    return F.zip_with(_d(a), _d(b), lambda x, y: x * F.lit(float(ratio)) + y * F.lit(1.0 - float(ratio)))


def sigmoid(col) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(col)))


def colbert_score(query, passage) -> Column:
    """Mean over query token vectors of the best dot product with a passage token vector. Both sides are cast once, before
    the loop over their pairs."""
    dot = lambda a, b: _sum(F.zip_with(a, b, lambda x, y: x * y))
    vectors = lambda c: _c(c).cast("array<array<double>>")

    def score(s):
        best = F.transform(s["q"], lambda q: F.array_max(F.transform(s["p"], lambda p: dot(q, p))))
        return _sum(best) / F.size(s["q"])

    return let(F.struct(vectors(query).alias("q"), vectors(passage).alias("p")), score)


def sparse_dot(a, b) -> Column:
    """Sum over shared tokens of two token-to-weight maps."""
    shared = F.array_intersect(F.map_keys(_c(a)), F.map_keys(_c(b)))
    return _sum(F.transform(shared, lambda t: F.element_at(_c(a), t).cast("double") * F.element_at(_c(b), t).cast("double")))
