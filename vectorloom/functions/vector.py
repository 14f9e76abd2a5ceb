"""Column expressions over ``array<float>`` / ``array<double>`` vectors.

All of these are built-in Spark SQL higher-order functions, so they run in
the JVM next to the scan. Sums are accumulated in double; callers cast the
result to ``array<float>`` where the reference keeps float32.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the denominator clamp used by the L2 normalisation the
# reference calls (a zero vector stays zero instead of dividing by zero).
NORM_EPS = 1e-12


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sum_sq(v) -> Column:
    return F.aggregate(_col(v), F.lit(0.0).cast("double"),
                       lambda acc, x: acc + x.cast("double") * x.cast("double"))


def l2_norm(v) -> Column:
    """Euclidean norm of one vector, in double."""
    return F.sqrt(sum_sq(v))


def vec_sum(v) -> Column:
    return F.aggregate(_col(v), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double"))


def vec_mean(v) -> Column:
    return F.try_divide(vec_sum(v), F.size(_col(v)).cast("double"))


def vec_std_pop(v) -> Column:
    """Population standard deviation of the elements of one vector."""
    mean = vec_mean(v)
    var = F.try_divide(sum_sq(v), F.size(_col(v)).cast("double")) - mean * mean
    return F.sqrt(F.greatest(var, F.lit(0.0)))


def truncate(v, dimension: int) -> Column:
    """Matryoshka truncation: keep the first ``dimension`` values.

    Past-the-end widths return the whole vector (the reference falls back to
    the native width). Widths below 1 are rejected (deviation: the reference
    would return an empty or tail-dropped vector).
    """
    if dimension is None:
        return _col(v)
    if int(dimension) < 1:
        raise ValueError(f"dimension must be >= 1, got {dimension}")
    return F.slice(_col(v), 1, int(dimension))


def _scale_by_norm(v, finish) -> Column:
    """One pass for the sum of squares, then ``finish(v, norm)`` once per row.

    The norm is bound as the accumulator of ``aggregate`` and handed to the
    finishing lambda, so it is computed once per vector. Writing
    ``transform(v, x -> x / l2_norm(v))`` instead re-evaluates the norm for
    every element: O(d^2) per row, and O(d^3) when such calls nest.
    """
    c = _col(v)
    return F.aggregate(c, F.lit(0.0).cast("double"),
                       lambda acc, x: acc + x.cast("double") * x.cast("double"),
                       lambda acc: finish(c, F.sqrt(acc)))


def normalize(v, eps: float = NORM_EPS) -> Column:
    """Divide by the (clamped) L2 norm; result is ``array<float>``."""
    def finish(c, norm):
        denom = F.greatest(norm, F.lit(eps))
        return F.transform(c, lambda x: (x.cast("double") / denom).cast("float"))
    return _scale_by_norm(v, finish)


def renormalize(v) -> Column:
    """Divide by the L2 norm with no zero guard: a zero vector gives null.

    This is the already-unit-vector path of the second backend, which divides
    by a zero norm; a null is returned instead of NaN (deviation).
    """
    def finish(c, norm):
        return F.when(norm > 0, F.transform(c, lambda x: (x.cast("double") / norm).cast("float")))
    return _scale_by_norm(v, finish)


def preview_head(v, n: int) -> Column:
    """First ``n`` values; ``n = 0`` gives an empty array."""
    if n < 0:
        raise ValueError("n must be >= 0")
    if n == 0:
        return F.filter(_col(v), lambda x: F.lit(False))
    return F.slice(_col(v), 1, n)


def preview_tail(v, n: int) -> Column:
    """Last ``n`` values, right for n = 0, n > size and the empty array.

    ``slice(v, -n, n)`` is avoided: it raises on start 0 and returns [] when
    the start falls before the array.
    """
    if n < 0:
        raise ValueError("n must be >= 0")
    if n == 0:
        return F.filter(_col(v), lambda x: F.lit(False))
    c = _col(v)
    return F.slice(c, F.greatest(F.size(c) - F.lit(n), F.lit(0)) + F.lit(1), F.lit(n))


def to_double_rounded(v, digits: int = 6) -> Column:
    """Round every element in double: the stable form compared with the oracle."""
    return F.transform(_col(v), lambda x: F.round(x.cast("double"), digits))


def max_abs_diff(a, b) -> Column:
    """Largest absolute element difference between two equal-width vectors."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))),
                       F.lit(0.0).cast("double"), lambda acc, x: F.greatest(acc, x))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)
