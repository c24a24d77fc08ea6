"""Sampled series in chunks: halos, filters, noise models, the window search, reconstruction.

A series is a table `(ifo, chunk, samples)` of equally long consecutive chunks.
Every filter here has finite reach, so a chunk needs only the samples just
before and after it. Those travel between neighbouring chunks by key, and one
detector's years are filtered by as many tasks as there are chunks.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberscan.functions import dsp
from emberscan.functions.arrays import synthesis_weight
from emberscan.operators.scan import attach, exact_quantiles, lookup_join
from emberscan.session import cut_lineage, ship_package

# What a broadcast table may hold.
BROADCAST_BYTES = 64 << 20
SERIES = T.ArrayType(T.DoubleType())


def with_halo(chunks: DataFrame, length: int, before: int, after: int, keys: Sequence[str] = ("ifo",)) -> DataFrame:
    """`chunks` with `halo`: each chunk preceded by `before` and followed by `after` samples.

    Each chunk sends its edge to the chunks within reach. A chunk whose
    neighbours are missing -- the ends of the series, a gap -- gets a shorter
    halo, told by `n_before` and `n_after`. A chunk of fewer than `length`
    samples is where a series breaks off: it takes from those before it, gives
    to them, and nothing joins up across its end.
    """
    keys = list(keys)
    fits = F.assert_true(F.size("samples") <= length, "a chunk is longer than the stated length")
    chunks = chunks.withColumn("_ok", fits).where(F.col("_ok").isNull()).drop("_ok")
    back, ahead = ceil(before / length), ceil(after / length)
    ship_package(chunks.sparkSession)
    # Offset o: this chunk is o places before (negative: after) the receiver.
    offsets = F.explode(F.sequence(F.lit(-ahead), F.lit(back)))
    o = F.col("_o")
    # The sender o chunks back gives what lies within `before` of the receiver's start.
    from_past = F.slice("samples", F.greatest(F.lit(1), F.lit(1 - before) + o * length), length)
    reach_ahead = F.greatest(F.lit(0), F.least(F.lit(length), F.lit(after) - (-o - 1) * length))
    piece = F.when(o == 0, F.col("samples")).when(o > 0, from_past).otherwise(F.slice("samples", 1, reach_ahead))
    sent = chunks.withColumn("_o", offsets).select(*keys, (F.col("chunk") + o).alias("chunk"), o.alias("_o"), piece.alias("_x"), (F.size("samples") == length).alias("_whole"))
    # A receiver holds at most one piece per offset, a number fixed by the filter.
    got = sent.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct((-F.col("_o")).alias("at"), "_x", F.col("_whole").alias("whole")))).alias("_p"))
    here = F.filter("_p", lambda p: p["at"] == 0)
    # Pieces only count while they join up with the chunk itself.
    whole = F.transform(F.filter("_p", lambda p: p["whole"]), lambda p: p["at"])
    past = F.filter("_p", lambda p: (p["at"] < 0) & F.forall(F.sequence(p["at"], F.lit(-1)), lambda k: F.array_contains(whole, k)))
    next_ = F.filter("_p", lambda p: (p["at"] > 0) & F.forall(F.sequence(F.lit(0), p["at"] - 1), lambda k: F.array_contains(whole, k)))
    join = lambda ps: F.flatten(F.transform(ps, lambda p: p["_x"]))
    got = got.where(F.size(here) > 0)
    return got.select(
        *keys, "chunk", here[0]["_x"].alias("samples"), F.concat(join(past), here[0]["_x"], join(next_)).alias("halo"),
        F.size(join(past)).alias("n_before"), F.size(join(next_)).alias("n_after"))


@F.pandas_udf(SERIES)
def _convolve(halo: pd.Series, n_before: pd.Series, n_after: pd.Series, size: pd.Series, kernel: pd.Series,
              back: pd.Series, ahead: pd.Series) -> pd.Series:
    out = []
    for x, nb, na, n, k, b, a in zip(halo, n_before, n_after, size, kernel, back, ahead):
        padded = np.concatenate([np.zeros(b - nb), x, np.zeros(a - na)])
        out.append(dsp.convolve_valid(padded, np.asarray(k))[:n])
    return pd.Series(out)


def fir(chunks: DataFrame, length: int, kernel: Sequence[float], ahead: int, keys: Sequence[str] = ("ifo",)) -> DataFrame:
    """Each chunk filtered by one kernel, `ahead` of whose taps look into the future. Beyond the series it is zero."""
    return _shared_kernel(chunks, length, np.asarray(kernel, dtype=float), len(kernel) - 1 - ahead, ahead, keys)


def fir_by_key(chunks: DataFrame, kernels: DataFrame, length: int, back: int, ahead: int, keys: Sequence[str] = ("ifo",)) -> DataFrame:
    """`fir` with one kernel per key: `kernels` has `keys, kernel`, all of `back + ahead + 1` taps."""
    keys = list(keys)
    h = with_halo(chunks.select(*keys, "chunk", "samples"), length, back, ahead, keys)
    # A row per detector and segment; beyond what fits in memory it is joined like any table.
    h = attach(h, kernels.select(*keys, "kernel"), keys, max_rows=BROADCAST_BYTES // (8 * (back + ahead + 1)))
    y = _convolve("halo", "n_before", "n_after", F.size("samples"), "kernel", F.lit(back), F.lit(ahead))
    return h.select(*keys, "chunk", y.alias("samples"))


def band_pass(chunks: DataFrame, length: int, fs: float, low: float, high: float, factor: int = 1, order: int = 10,
              keys: Sequence[str] = ("ifo",)) -> DataFrame:
    """Zero-phase band-pass and decimation; what filtering the whole series at once would give."""
    if length % factor:
        raise ValueError(f"chunks of {length} samples do not divide by {factor}")
    kernel = dsp.band_pass_kernel(fs, low, high, order)
    reach = len(kernel) // 2
    y = _shared_kernel(chunks, length, kernel, reach, reach, keys)
    if factor == 1:
        return y
    return y.withColumn("samples", F.filter("samples", lambda v, i: i % factor == 0))


def _shared_kernel(chunks: DataFrame, length: int, kernel: np.ndarray, back: int, ahead: int, keys: Sequence[str]) -> DataFrame:
    """A long kernel shared by all rows rides in the function instead of in every row."""
    taps = np.asarray(kernel, dtype=float)

    @F.pandas_udf(SERIES)
    def run(halo: pd.Series, n_before: pd.Series, n_after: pd.Series, size: pd.Series) -> pd.Series:
        rows = zip(halo, n_before, n_after, size)
        return pd.Series([dsp.convolve_valid(np.concatenate([np.zeros(back - b), x, np.zeros(ahead - a)]), taps)[:n]
                          for x, b, a, n in rows])

    h = with_halo(chunks, length, back, ahead, keys)
    return h.select(*keys, "chunk", run("halo", "n_before", "n_after", F.size("samples")).alias("samples"))


def inject(series: DataFrame, waveforms: DataFrame, keys: Sequence[str] = ("ifo",)) -> DataFrame:
    """`(keys, n, value)` with waveforms `(keys, first_n, scale, samples)` added where they fall.

    Overlapping waveforms add up. One that runs past the series is refused.
    """
    keys = list(keys)
    added = waveforms.select(*keys, "first_n", "scale", F.posexplode("samples").alias("i", "v")).select(
        *keys, (F.col("first_n") + F.col("i")).alias("n"), (F.col("v") * F.col("scale")).alias("value"), F.lit(0).alias("_own"))
    both = series.select(*keys, "n", "value", F.lit(1).alias("_own")).unionByName(added)
    total = both.groupBy(*keys, "n").agg(F.sum("value").alias("value"), F.max("_own").alias("_own"))
    inside = F.assert_true(F.col("_own") == 1, "a waveform runs past the series it is added to")
    return total.withColumn("_ok", inside).where(F.col("_ok").isNull()).select(*keys, "n", "value")


def optimal_snr(waveforms: DataFrame, psd: DataFrame, fs: float, low: float, high: float | None = None,
                key: str = "id") -> DataFrame:
    """Matched-filter size of each waveform against a measured density: `(key, snr)`.

    `psd` is one row per frequency bin of one detector (`frequency, density`),
    read off at the waveform's own frequencies by linear interpolation.
    """
    # The bins of one spectrum: half a segment's length of numbers.
    table = psd.agg(F.array_sort(F.collect_list(F.struct("frequency", "density"))).alias("_psd"))
    top = fs / 2 if high is None else high

    @F.pandas_udf(T.DoubleType())
    def size(samples: pd.Series, spectrum: pd.Series) -> pd.Series:
        out = []
        for x, s in zip(samples, spectrum):
            grid = np.array([(v["frequency"], v["density"]) for v in s])
            f = np.fft.rfftfreq(len(x), 1.0 / fs)
            use = (f >= low) & (f <= top) & (f > 0)
            power = np.abs(np.fft.rfft(x)[use] / fs) ** 2 / np.interp(f[use], grid[:, 0], grid[:, 1])
            out.append(float(np.sqrt(4.0 * power.sum() * fs / len(x))))
        return pd.Series(out, dtype="float64")

    return waveforms.crossJoin(F.broadcast(table)).select(key, size("samples", "_psd").alias("snr"))


# --- noise models ------------------------------------------------------------


def autocorrelation(chunks: DataFrame, length: int, order: int, keys: Sequence[str] = ("ifo",)) -> DataFrame:
    """Sums of lagged products per key: `(keys, lag, r)`, over a series of any length.

    Each chunk adds its own products, its future samples coming from the halo;
    the sums are combined before they are shuffled.
    """
    h = with_halo(chunks, length, 0, order, keys)

    @F.pandas_udf(SERIES)
    def lagged(halo: pd.Series, size: pd.Series) -> pd.Series:
        out = []
        for x, n in zip(halo, size):
            x = np.concatenate([x, np.zeros(max(0, n + order - len(x)))])
            out.append([float(x[:n] @ x[k:k + n]) for k in range(order + 1)])
        return pd.Series(out)

    per = h.select(*keys, F.posexplode(lagged("halo", F.size("samples"))).alias("lag", "v"))
    return per.groupBy(*keys, "lag").agg(F.sum("v").alias("r"))


def fit_ar(chunks: DataFrame, length: int, order: int, keys: Sequence[str] = ("ifo",)) -> DataFrame:
    """An autoregressive model per key: `(keys, sigma, poly, reflection)`, `poly[0] = 1`.

    Only `order + 1` numbers per key reach the recursion.
    """
    keys = list(keys)
    lags = autocorrelation(chunks, length, order, keys)
    count = chunks.groupBy(*keys).agg(F.sum(F.size("samples")).alias("n"))
    rows = lags.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lag", "r"))).alias("_r")).join(count, on=keys)
    rows = rows.withColumn("_r", F.transform("_r", lambda x: x["r"] / F.col("n")))

    @F.pandas_udf("struct<sigma:double,poly:array<double>,reflection:array<double>>")
    def solve(r: pd.Series) -> pd.DataFrame:
        if r.empty:
            return pd.DataFrame({"sigma": [], "poly": [], "reflection": []})
        poly, error, reflection = dsp.levinson(np.stack(r.to_list()), order)
        return pd.DataFrame({"sigma": np.sqrt(np.maximum(error, 0.0)), "poly": list(poly), "reflection": list(reflection)})

    return rows.withColumn("_m", solve("_r")).select(*keys, "_m.sigma", "_m.poly", "_m.reflection")


def _kernel_from_model(model: DataFrame, make) -> DataFrame:
    build = F.pandas_udf(lambda p: pd.Series([make(np.asarray(v)) for v in p]), "array<double>")
    return model.withColumn("kernel", build("poly"))


def whiten(chunks: DataFrame, length: int, model: DataFrame, mode: str = "zero_phase", sqrt_order: int = 64,
           keys: Sequence[str] = ("ifo",)) -> DataFrame:
    """Whiten each series with its own model.

    `forward` applies the prediction filter, `double` applies it both ways, and
    `zero_phase` applies its square root both ways, which whitens at zero phase
    with a look-ahead of `sqrt_order` samples.
    """
    keys = list(keys)
    if mode == "forward":
        kernels = model.withColumn("kernel", F.col("poly"))
    elif mode == "double":
        kernels = _kernel_from_model(model, dsp.both_ways)
    elif mode == "zero_phase":
        kernels = _kernel_from_model(model, lambda p: dsp.both_ways(dsp.half_power_polynomial(p, sqrt_order)[0]))
    else:
        raise ValueError(f"unknown whitening {mode!r}")
    kernels = cut_lineage(kernels.select(*keys, "kernel"))
    taps = kernels.select(F.max(F.size("kernel"))).first()[0]
    back, ahead = (taps - 1, 0) if mode == "forward" else (taps // 2, taps // 2)
    return fir_by_key(chunks, kernels, length, back, ahead, keys)


def colour(chunks: DataFrame, length: int, model: DataFrame, taps: int, keys: Sequence[str] = ("ifo",)) -> DataFrame:
    """Undo `forward` whitening by the model's own response, which must have died away within `taps` samples."""
    def response(p: np.ndarray) -> np.ndarray:
        h = dsp.inverse_response(p)
        if h.size > taps:
            raise ValueError(f"the model's response takes {h.size} taps, more than the {taps} given")
        return np.concatenate([h, np.zeros(taps - h.size)])
    kernels = cut_lineage(_kernel_from_model(model, response).select(*keys, "kernel"))
    return fir_by_key(chunks, kernels, length, taps - 1, 0, keys)


def measured_psd(chunks: DataFrame, length: int, fs: float, segment: int, keys: Sequence[str] = ("ifo",)) -> DataFrame:
    """One-sided power density by Welch's average: `(keys, bin, frequency, density)`."""
    w = sliding_windows(chunks, length, segment, segment // 2, keys)
    # The periodic form of the taper, as is usual for spectra.
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)
    norm = fs * float(taper @ taper)

    @F.pandas_udf(SERIES)
    def power(x: pd.Series) -> pd.Series:
        m = np.vstack(x.to_numpy()) if len(x) else np.zeros((0, segment))
        m = m - m.mean(axis=1, keepdims=True)
        p = np.abs(np.fft.rfft(m * taper, axis=1)) ** 2 / norm
        p[:, 1:-1 if segment % 2 == 0 else None] *= 2.0
        return pd.Series(list(p))

    per = w.select(*keys, F.posexplode(power("window")).alias("bin", "p"))
    return per.groupBy(*keys, "bin").agg(F.avg("p").alias("density")).withColumn("frequency", F.col("bin") * F.lit(fs / segment))


# --- the window search -------------------------------------------------------


def sliding_windows(chunks: DataFrame, length: int, window: int, overlap: int, keys: Sequence[str] = ("ifo",)) -> DataFrame:
    """Every complete window of the search's grid: `(keys, first_sample, window)`.

    A window belongs to the chunk its first sample is in.
    """
    step = window - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the window")
    h = with_halo(chunks, length, 0, window - 1, keys)
    origin = F.col("chunk") * length
    first = F.ceil(origin / step) * step
    last = origin + F.size("samples") - 1
    start = F.explode(F.when(first <= last, F.sequence(first, last, F.lit(step).cast("long"))))
    out = h.withColumn("first_sample", start)
    out = out.withColumn("window", F.slice("halo", (F.col("first_sample") - origin + 1).cast("int"), window))
    return out.where(F.size("window") == window).select(*keys, "first_sample", "window")


def search_schema() -> str:
    return "wave string, sigma double, EnWDF double, wt_index array<int>, wt_value array<double>"


def basis_rows(x: pd.Series, names: Sequence[str], soft: bool) -> pd.DataFrame:
    """Each window's winning basis and surviving coefficients, `dsp.BLOCK` numbers at a time."""
    parts = []
    step = max(dsp.BLOCK // max(len(x.iloc[0]), 1), 1) if len(x) else 1
    for lo in range(0, len(x), step):
        best = dsp.best_basis(np.vstack(x.iloc[lo:lo + step].to_numpy()), names, soft)
        kept = [np.flatnonzero(c) for c in best["coeff"]]
        parts.append(pd.DataFrame({"wave": best["wave"], "sigma": best["sigma"], "EnWDF": best["EnWDF"],
                                   "wt_index": [k.astype("int32") for k in kept],
                                   "wt_value": [c[k] for c, k in zip(best["coeff"], kept)]}))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["wave", "sigma", "EnWDF", "wt_index", "wt_value"])


def search(windows: DataFrame, fs: float, threshold: float, bases: Sequence[str] = dsp.BASES, soft: bool = False,
           carry: Sequence[str] = ("ifo", "first_sample")) -> DataFrame:
    """Triggers: per window the winning basis and its surviving coefficients, where the statistic passes.

    One filter bank per basis over a bounded block of windows; rows stay where they are.
    """
    names = tuple(bases)
    ship_package(windows.sparkSession)

    @F.pandas_udf(f"struct<{', '.join(f.replace(' ', ':', 1) for f in search_schema().split(', '))}>")
    def transform(x: pd.Series) -> pd.DataFrame:
        return basis_rows(x, names, soft)

    n = F.size("window").cast("long")
    return windows.withColumn("_t", transform("window")).where(F.col("_t.EnWDF") > threshold).select(
        *carry, (F.col("first_sample") / F.lit(float(fs))).alias("gps"), n.alias("n_coeff"), F.lit(float(fs)).alias("fs"), "_t.*")


# --- reconstruction ----------------------------------------------------------


@F.pandas_udf(SERIES)
def inverse_window(index: pd.Series, value: pd.Series, n_coeff: pd.Series, wave: pd.Series) -> pd.Series:
    """The samples a window's surviving coefficients stand for, in its own basis."""
    out = []
    for i, v, n, name in zip(index, value, n_coeff, wave):
        dense = np.zeros(int(n))
        dense[np.asarray(i, dtype=int)] = np.asarray(v, dtype=float)
        out.append(dsp.inverse(dense, name)[0])
    return pd.Series(out)


def stitch(windows: DataFrame, keys: Sequence[str], fs: float, window: int, overlap: int, policy: str = "overlap_add",
           taper_edges: bool = False, samples: str = "samples") -> DataFrame:
    """Overlapping windows to one series per key: `(keys, n, value)`, `n` counted in samples.

    `overlap_add` averages the estimates of a sample by their taper;
    `central_window` takes each window's own step and the last one whole. Gaps
    have no rows, which is a value of zero.
    """
    keys = list(keys)
    step = window - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the window")
    if taper_edges and overlap > window // 2:
        raise ValueError("tapered edges need an overlap of at most half the window")
    placed = windows.withColumn("_first", F.round(F.col("gps") * F.lit(float(fs))).cast("long"))
    if policy == "central_window":
        final = placed.groupBy(*keys).agg(F.max("gps").alias("_last"))
        rows = lookup_join(placed, final, keys).select(*keys, "gps", "_first", "_last", F.posexplode(samples).alias("i", "x"))
        own = rows.where((F.col("i") < step) | (F.col("gps") == F.col("_last")))
        pick = F.max(F.struct("gps", F.col("x")))
        return own.groupBy(*keys, (F.col("_first") + F.col("i")).alias("n")).agg(pick.alias("_w")).select(
            *keys, "n", F.col("_w.x").alias("value"))
    if policy != "overlap_add":
        raise ValueError(f"unknown overlap policy {policy!r}; expected overlap_add or central_window")
    weighted = F.arrays_zip(F.col(samples).alias("x"), synthesis_weight(window, overlap).alias("w"))
    rows = placed.select(*keys, "_first", F.posexplode(weighted).alias("i", "s"))
    total = F.sum(F.col("s.x") * F.col("s.w"))
    value = total if taper_edges else total / F.sum("s.w")
    return rows.groupBy(*keys, (F.col("_first") + F.col("i")).alias("n")).agg(value.alias("value"))


def combined_statistic(windows: DataFrame, keys: Sequence[str], fs: float, window: int, overlap: int) -> DataFrame:
    """Norm of the stitched reconstruction over the median noise scale, with what it was built from."""
    keys = list(keys)
    series = stitch(windows, keys, fs, window, overlap)
    energy = series.groupBy(*keys).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_norm"))
    noise = exact_quantiles(windows, keys, "sigma", [0.5], "sigma").drop("q")
    span = F.max("gps") - F.min("gps") + F.lit(window / fs)
    facts = windows.groupBy(*keys).agg(F.max("EnWDF").alias("loudest_window"), span.alias("span_s"),
                                       F.count(F.lit(1)).alias("windows"), F.min("gps").alias("gps"))
    out = energy.join(noise, on=keys).join(facts, on=keys)
    return out.select(*keys, "gps", F.when(F.col("sigma") > 0, F.col("_norm") / F.col("sigma")).alias("EnWDF"),
                      "sigma", "loudest_window", "span_s", "windows")


def event_waveform(members: DataFrame, keys: Sequence[str], fs: float, strides: dict[int, int]) -> DataFrame:
    """Each event stitched from the window length that carries most of its energy."""
    keys = list(keys)
    energy = members.groupBy(*keys, "n_coeff").agg(F.sum(F.col("EnWDF") * F.col("EnWDF")).alias("e"))
    best = energy.groupBy(*keys).agg(F.max(F.struct("e", "n_coeff")).alias("_b")).select(*keys, F.col("_b.n_coeff").alias("_n"))
    own = lookup_join(members, best, keys).where(F.col("n_coeff") == F.col("_n"))
    own = own.withColumn("samples", inverse_window("wt_index", "wt_value", "n_coeff", "wave"))
    out = None
    for n, stride in sorted(strides.items()):
        part = stitch(own.where(F.col("n_coeff") == n), keys, fs, n, n - stride)
        out = part if out is None else out.unionByName(part)
    return out


@F.pandas_udf(T.DoubleType())
def spectral_centroid(samples: pd.Series, fs: pd.Series) -> pd.Series:
    """Power-weighted frequency of a series, its mean left out."""
    out = []
    for x, rate in zip(samples, fs):
        p = np.abs(np.fft.rfft(x)) ** 2
        p[0] = 0.0
        f = np.fft.rfftfreq(len(x), 1.0 / rate)
        out.append(float(p @ f / p.sum()) if p.sum() > 0 else None)
    return pd.Series(out, dtype="float64")


def phase_residual(a: Column, b: Column, amplitude_floor: float = 0.1) -> Column:
    """Median absolute phase difference where the second series has an envelope to speak of."""

    @F.pandas_udf("double")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right):
            u, v = dsp.analytic_signal(np.asarray(x)), dsp.analytic_signal(np.asarray(y))
            size = np.abs(v)
            use = np.flatnonzero(size >= amplitude_floor * size.max()) if size.size and size.max() > 0 else []
            if not len(use):
                out.append(None)
                continue
            turn = np.unwrap(np.angle(u[use]) - np.angle(v[use]))
            out.append(float(np.median(np.abs(turn - np.median(turn)))))
        return pd.Series(out, dtype="float64")

    return run(a, b)
