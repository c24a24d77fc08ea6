"""Interval arithmetic used as join conditions and edge features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def nan_to_null(x: Column) -> Column:
    return F.when(finite(x), x)


def overlap_fraction(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared length over the shorter interval, zero when they are apart."""
    shared = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    return shared / F.greatest(F.least(a1 - a0, b1 - b0), F.lit(TINY))


def clipped_overlap(a0: Column, a1: Column, b0: Column, b1: Column, slack: Column | None = None) -> Column:
    """Overlap within [0, 1] once the second interval may shift by `slack`."""
    slack = F.lit(0.0) if slack is None else slack
    shorter = F.greatest(F.least(a1 - a0, b1 - b0), F.lit(TINY))
    shared = F.least(a1, b1 + slack) - F.greatest(a0, b0 - slack)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(shared, shorter) / shorter))


def intervals_touch(a0: Column, a1: Column, b0: Column, b1: Column, slack: Column) -> Column:
    return F.least(a1, b1 + slack) >= F.greatest(a0, b0 - slack)


def gap_between(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Distance between two intervals, negative where they overlap."""
    return F.greatest(b0 - a1, a0 - b1)
