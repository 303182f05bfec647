"""Vector arithmetic on array columns, as built-in Spark expressions (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_EPS = 1e-8


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_doubles(col: Column | str) -> Column:
    return _c(col).cast("array<double>")


def vec_sum(col: Column | str) -> Column:
    return F.aggregate(_c(col), F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    return vec_sum(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y))


def l2_norm(col: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_doubles(col), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(col: Column | str, eps: float = NORM_EPS) -> Column:
    """Divide by (norm + eps). The norm is bound once per row through a one-element transform."""
    vec = as_doubles(col)
    bound = F.transform(F.array(l2_norm(vec)), lambda n: F.transform(vec, lambda x: x / (n + F.lit(eps))))
    return F.element_at(bound, 1)


def cosine(a: Column | str, b: Column | str, eps: float = 0.0) -> Column:
    denom = (l2_norm(a) + F.lit(eps)) * (l2_norm(b) + F.lit(eps))
    return dot(a, b) / F.nullif(denom, F.lit(0.0))


def sq_dist(a: Column | str, b: Column | str) -> Column:
    return vec_sum(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y)))


def vec_mean(col: Column | str) -> Column:
    return vec_sum(col) / F.size(_c(col))


def is_garbage(col: Column | str, floor: float = 1e-6) -> Column:
    """True for arrays with a NaN/null entry or with next to no energy."""
    bad = F.exists(_c(col), lambda x: x.isNull() | F.isnan(x))
    return _c(col).isNull() | bad | (vec_sum(F.transform(_c(col), F.abs)) < F.lit(floor))


def rescale_255(col: Column | str, limit: float = 1.5) -> Column:
    """Bring 8-bit pixel ranges to [0, 1]; arrays already in range stay as they are."""
    vec = as_doubles(col)
    return F.when(F.array_max(vec) > F.lit(limit), F.transform(vec, lambda x: x / F.lit(255.0))).otherwise(vec)


def standardize_expr(col: Column | str, ddof: int = 0, eps: float = 1e-6) -> Column:
    """Zero mean, unit deviation over one array; arrays flatter than eps are only centred."""
    vec = as_doubles(col)
    n = F.size(vec)
    centred = F.element_at(
        F.transform(F.array(vec_mean(vec)), lambda m: F.transform(vec, lambda x: x - m)), 1
    )
    std = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda acc, x: acc + x * x) / (n - F.lit(ddof)))
    return F.element_at(
        F.transform(
            F.array(F.struct(centred.alias("c"), std.alias("s"))),
            lambda p: F.when(p["s"] < F.lit(eps), p["c"]).otherwise(
                F.transform(p["c"], lambda x: x / p["s"])
            ),
        ),
        1,
    )
