"""Geometry of a packed dyadic coefficient vector, as column expressions.

Index 0 is the scaling coefficient; octave level `j` holds the indices from
`2**j` to `2**(j+1) - 1`. Everything is derived from the index, so no lookup
table is joined and a window length may differ from row to row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log2_exact(n: Column) -> Column:
    """Floor of log2 of a positive integer, from its binary digits."""
    return F.length(F.bin(n.cast("long"))) - 1


def level(k: Column) -> Column:
    return F.when(k == 0, F.lit(-1)).otherwise(log2_exact(k))


def position(k: Column) -> Column:
    return F.when(k == 0, F.lit(0).cast("long")).otherwise(
        k.cast("long") - F.pow(F.lit(2.0), level(k)).cast("long")
    )


def _octaves_below_top(k: Column, n: Column) -> Column:
    return (log2_exact(n) - level(k)).cast("double")


def band_low(k: Column, n: Column, fs: Column) -> Column:
    return F.when(k == 0, F.lit(0.0)).otherwise(fs / F.pow(F.lit(2.0), _octaves_below_top(k, n) + 1))


def band_high(k: Column, n: Column, fs: Column) -> Column:
    # The scaling row (level -1) lands one octave below level 0 by the same rule.
    return fs / F.pow(F.lit(2.0), _octaves_below_top(k, n))


def _block_seconds(k: Column, n: Column, fs: Column) -> Column:
    return n / F.pow(F.lit(2.0), F.greatest(level(k), F.lit(0)).cast("double")) / fs


def time_low(k: Column, n: Column, fs: Column) -> Column:
    return position(k) * _block_seconds(k, n, fs)


def time_high(k: Column, n: Column, fs: Column) -> Column:
    return (position(k) + 1) * _block_seconds(k, n, fs)


def tile_frequency(low: Column, high: Column) -> Column:
    """Geometric centre of a band; half its top when it reaches down to zero."""
    return F.when(low <= 0, high / 2).otherwise(F.sqrt(low * high))


def universal_threshold(sigma: Column, n: Column) -> Column:
    return sigma * F.sqrt(F.lit(2.0) * F.log(n.cast("double")))


def usable_sigma(sigma: Column) -> Column:
    """The noise scale, or one where none was measured."""
    good = sigma.isNotNull() & ~F.isnan(sigma) & (sigma > 0)
    return F.when(good, sigma).otherwise(F.lit(1.0))
