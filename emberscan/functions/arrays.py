"""Row-local linear algebra on array columns; no explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def energy(x: Column) -> Column:
    """Sum of squares over the finite entries."""
    return F.aggregate(
        doubles(x), F.lit(0.0),
        lambda acc, v: acc + F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(v * v))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(x: Column) -> Column:
    return F.sqrt(energy(x))


def unit_norm(x: Column) -> Column:
    length = norm(x)
    return F.transform(doubles(x), lambda v: v / F.when(length == 0, F.lit(1.0)).otherwise(length))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def correlation(a: Column, b: Column) -> Column:
    """`2<a,b> / (<a,a> + <b,b>)`: one only for equal shape and equal size."""
    coherent = F.greatest(dot(a, b), F.lit(0.0))
    present = F.greatest(energy(a) + energy(b), F.lit(1e-12))
    return F.least(F.greatest(2.0 * coherent / present, F.lit(0.0)), F.lit(1.0))


def to_dense(index: Column, value: Column, n: Column) -> Column:
    """A zero-filled vector of length `n` with `value` at `index`."""
    at = F.map_from_arrays(index.cast("array<int>"), doubles(value))
    slots = F.sequence(F.lit(0), n.cast("int") - 1)
    return F.transform(slots, lambda k: F.coalesce(at[k], F.lit(0.0)))


def survivors(dense: Column, threshold: Column) -> Column:
    """Ascending `(k, c)` pairs of the entries reaching `threshold` in size."""
    pairs = F.transform(doubles(dense), lambda v, k: F.struct(k.alias("k"), v.alias("c")))
    return F.filter(pairs, lambda p: (F.abs(p["c"]) >= threshold) & (p["c"] != 0))


def circular_shift(x: Column, lag: Column) -> Column:
    """`out[i] = x[(i + lag) mod n]`."""
    n = F.size(x)
    return F.transform(x, lambda v, i: F.element_at(x, F.pmod(i + lag, n) + 1))


def overlap_at_lag(a: Column, b: Column, lag: Column) -> Column:
    return F.try_divide(dot(circular_shift(doubles(a), lag), b), norm(a) * norm(b))


def best_overlap(a: Column, b: Column, max_lag: int) -> Column:
    """`struct(overlap, lag, overlap_at_zero_lag)`: the best circular lag, zero winning ties,
    then the most negative."""
    lags = [0, *[lag for lag in range(-max_lag, max_lag + 1) if lag]]
    tried = F.transform(F.array(*[F.lit(v) for v in lags]),
                        lambda lag: F.struct(overlap_at_lag(a, b, lag).alias("o"), lag.alias("lag")))
    start = tried[0]
    best = F.aggregate(tried, start, lambda acc, t: F.when(t["o"] > acc["o"], t).otherwise(acc))
    return F.struct(best["o"].alias("overlap"), best["lag"].alias("lag"), start["o"].alias("overlap_at_zero_lag"))


def synthesis_weight(window: int, overlap: int) -> Column:
    """Raised-cosine ramps over the overlapped samples, one in between."""
    from math import pi
    if overlap <= 0:
        return F.array_repeat(F.lit(1.0), window)
    ramp = lambda k: 0.5 * (1.0 - F.cos(F.lit(pi) * k / (overlap + 1.0)))
    slot = F.sequence(F.lit(1), F.lit(window))
    return F.transform(slot, lambda i: F.when(i > window - overlap, ramp((window + 1 - i).cast("double")))
                       .when(i <= overlap, ramp(i.cast("double"))).otherwise(F.lit(1.0)))
