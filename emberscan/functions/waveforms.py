"""Closed-form transients as array columns, one sample per element, from a row's own parameters."""

from __future__ import annotations

from math import pi, sin

from pyspark.sql import Column
from pyspark.sql import functions as F


def symmetric_times(half: Column, rate: float) -> Column:
    n = F.round(half * F.lit(float(rate))).cast("int")
    return F.transform(F.sequence(-n, n), lambda i: i / F.lit(float(rate)))


def _bell(t: Column, width: Column) -> Column:
    return F.exp(-0.5 * (t / width) * (t / width))


def gaussian(sigma_t: Column, rate: float = 2048.0, n_sigma: float = 6.0) -> Column:
    return F.transform(symmetric_times(sigma_t * n_sigma, rate), lambda t: _bell(t, sigma_t))


def sine_gaussian(f0: Column, q: Column, rate: float = 2048.0, n_tau: float = 4.0) -> Column:
    tau = q / (F.lit(2.0 * pi) * f0)
    return F.transform(symmetric_times(tau * n_tau, rate), lambda t: _bell(t, tau) * F.sin(F.lit(2.0 * pi) * f0 * t))


def blip(f0: Column, q: Column, asymmetry: float = 3.0, rate: float = 2048.0, n_tau: float = 6.0) -> Column:
    tau = q / (F.lit(2.0 * pi) * f0)
    width = lambda t: F.when(t < 0, tau).otherwise(tau * asymmetry)
    return F.transform(symmetric_times(tau * (n_tau * asymmetry), rate),
                       lambda t: _bell(t, width(t)) * F.sin(F.lit(2.0 * pi) * f0 * t))


def chirplike(f_start: Column, f_end: Column, duration: Column, rate: float = 2048.0) -> Column:
    sweep = (f_end - f_start) / duration
    phase = lambda t: F.lit(2.0 * pi) * (f_start * t + 0.5 * sweep * t * t)
    n = F.ceil(duration * F.lit(float(rate))).cast("int")
    times = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i / F.lit(float(rate)))
    return F.transform(times, lambda t: _bell(t - 0.5 * duration, 0.25 * duration) * F.sin(phase(t)))


def scattered_light(f_peak: Column, arch_period: float, n_arches: int, rate: float = 2048.0) -> Column:
    """Repeated arches. The phase is the running sum of the instantaneous frequency.

    The sum runs over the samples of one waveform, inside its row.
    """
    duration = arch_period * n_arches
    n = int(-(-duration * rate // 1))
    time = lambda i: i / F.lit(float(rate))
    # The running sum of |sin| is the same for every row but for the peak
    # frequency in front of it, so it is one short list of numbers.
    total, unit = 0.0, []
    for i in range(n):
        total += abs(sin(pi * i / rate / arch_period))
        unit.append(total)
    sums = F.array(*[F.lit(v) for v in unit])
    envelope = lambda t: F.sin(F.lit(pi) * t / duration) * F.sin(F.lit(pi) * t / duration)
    return F.transform(sums, lambda s, i: envelope(time(i)) * F.sin(F.lit(2.0 * pi / rate) * f_peak * s))
