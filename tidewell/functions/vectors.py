"""Column expressions on dense vectors (ARRAY<FLOAT> or ARRAY<DOUBLE>), and the scalar formulas of the estimator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def widen(vec: Column | str) -> Column:
    """The vector in doubles."""
    return _col(vec).cast("array<double>")


def squared_l2(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance; NULL if a vector is."""
    return F.aggregate(F.zip_with(widen(a), widen(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda m, v: m + v)


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(squared_l2(a, b))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(widen(a), widen(b), lambda x, y: x * y), F.lit(0.0), lambda m, v: m + v)


def is_finite(vec: Column | str) -> Column:
    """Whether no component is NaN or infinite."""
    return F.forall(widen(vec), lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def has_dim(vec: Column | str, dim: int) -> Column:
    return F.size(_col(vec)) == dim


def require_dim(vec: Column | str, dim: int) -> Column:
    """The vector; one of another dimension fails the query."""
    wrong = F.raise_error(F.concat(F.lit("a vector of dimension "), F.size(_col(vec)).cast("string"), F.lit(f" among those of {dim}")))
    return F.when(has_dim(vec, dim) | _col(vec).isNull(), _col(vec)).otherwise(wrong.cast("array<double>"))


def narrow(vec: Column | str) -> Column:
    """The vector in floats, as it is stored."""
    return _col(vec).cast("array<float>")


def compute_k(n_max: Column | str) -> Column:
    """Projections for at most ``n_max`` points a side: max(1, ceil(4 ln(8 n^2)))."""
    n = _col(n_max).cast("double")
    return F.greatest(F.lit(1), F.ceil(4 * F.log(8 * n * n))).cast("int")


def default_t(n: Column | str) -> Column:
    """The default sample budget: max(1, floor(15 log2 n)); 1 for no points."""
    x = _col(n).cast("double")
    return F.when(x <= 0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(15 * F.log2(x)))).cast("int")


def floor_half(x: Column | str) -> Column:
    """Floor of x / 2, for negative numbers too."""
    return F.shiftright(_col(x), 1)


def unit_draw(seed: int, stream: str, *parts: Column | str) -> Column:
    """A number in [0, 1) that depends on seed, stream and parts alone, never on partitions or order."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(stream), *(_col(p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
