"""Time-frequency tiles: exploding triggers, moments, quantiles, ridges, maps."""

from __future__ import annotations

from collections.abc import Sequence
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberscan.functions import wavelet as wv
from emberscan.functions.arrays import energy as energy_of
from emberscan.functions.arrays import survivors
from emberscan.operators.scan import SLAB, lookup_join, range_slabs, scan_slabs

TRIGGER_KEYS = ("trigger_id", "ifo")


def sparsify(windows: DataFrame, dense: str, threshold: Column | str | None = None) -> DataFrame:
    """Dense coefficient rows to `wt_index` / `wt_value`, keeping what reaches the threshold."""
    if threshold is None:
        threshold = wv.universal_threshold(F.col("sigma"), F.col("n_coeff"))
    kept = survivors(F.col(dense), threshold if isinstance(threshold, Column) else F.col(threshold))
    return (
        windows.withColumn("_kept", kept)
        .withColumn("wt_index", F.col("_kept.k"))
        .withColumn("wt_value", F.col("_kept.c"))
        .drop("_kept")
    )


def explode_tiles(triggers: DataFrame, carry: Sequence[str] = ("trigger_id", "ifo")) -> DataFrame:
    """One row per surviving coefficient, as a box in absolute time and frequency.

    The box depends on the row's own `n_coeff` and `fs`, so window lengths mix
    freely; `scale` names the length. A narrow map, nothing is shuffled.
    """
    k, n, fs = F.col("k"), F.col("n_coeff"), F.col("fs")
    carried = list(carry)
    rows = triggers.select(
        *carried, "gps", "n_coeff", "fs", "sigma",
        F.explode(F.arrays_zip(F.col("wt_index").alias("i"), F.col("wt_value").alias("v"))).alias("_t"),
    )
    rows = rows.withColumn("k", F.col("_t").getField("i").cast("long")).withColumn(
        "c", F.col("_t").getField("v").cast("double"))
    return rows.select(
        *carried, "k", "c", "sigma", "fs", F.col("n_coeff").alias("scale"),
        wv.level(k).alias("level"),
        (F.col("gps") + wv.time_low(k, n, fs)).alias("t_lo"),
        (F.col("gps") + wv.time_high(k, n, fs)).alias("t_hi"),
        wv.band_low(k, n, fs).alias("f_lo"),
        wv.band_high(k, n, fs).alias("f_hi"),
        (F.col("c") * F.col("c")).alias("energy"),
    )


def normalised_energy(energy: Column, sigma: Column) -> Column:
    good = sigma.isNotNull() & ~F.isnan(sigma) & (sigma > 0)
    return F.when(good, energy / (sigma * sigma))


def energy_diagnostics(triggers: DataFrame, sigma: str = "sigma") -> DataFrame:
    """Norm, energy and count of the stored coefficients, and how far the statistic is from theirs."""
    t = triggers.withColumn("wavelet_energy", energy_of(F.col("wt_value")))
    t = t.withColumn("wavelet_l2", F.sqrt("wavelet_energy")).withColumn(
        "nActiveCoeff", F.size(F.filter("wt_value", lambda v: v != 0)))
    t = t.withColumn("EnWDF_from_coeff", F.when(F.col(sigma) > 0, F.col("wavelet_l2") / F.col(sigma)))
    return t.withColumn("EnWDF_residual", F.col("EnWDF") - F.col("EnWDF_from_coeff"))


def _fold(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, t: acc + f(t))


def window_moments(triggers: DataFrame) -> DataFrame:
    """The moments of each trigger's own tiles, computed inside the row.

    The coefficients already sit in one row, so the sums run over the array in
    place: no explode and no shuffle, whatever the number of triggers.
    """
    n, fs = F.col("n_coeff"), F.col("fs")
    pair = F.arrays_zip(F.col("wt_index").alias("i"), F.col("wt_value").alias("v"))

    def tile(p: Column) -> Column:
        k, c = p["i"].cast("long"), p["v"].cast("double")
        lo, hi = wv.time_low(k, n, fs), wv.time_high(k, n, fs)
        f0, f1 = wv.band_low(k, n, fs), wv.band_high(k, n, fs)
        return F.struct(F.abs(c).alias("mag"), (c * c).alias("e"), lo.alias("lo"), hi.alias("hi"),
                        ((lo + hi) / 2).alias("mid"), f0.alias("f0"), f1.alias("f1"),
                        F.log(wv.tile_frequency(f0, f1)).alias("lf"))

    t = triggers.withColumn("_tiles", F.transform(pair, tile))
    t = t.withColumn("_e", _fold(F.col("_tiles"), lambda x: x["e"]))
    t = t.withColumn("_c", F.try_divide(_fold(F.col("_tiles"), lambda x: x["e"] * x["mid"]), F.col("_e")))
    centred = _fold(F.col("_tiles"), lambda x: x["e"] * (
        (x["mid"] - F.col("_c")) * (x["mid"] - F.col("_c")) + (x["hi"] - x["lo"]) * (x["hi"] - x["lo"]) / 12.0))
    # The first tile of the largest size: later ones replace it only if larger.
    loudest = F.aggregate(
        F.col("_tiles"), F.struct(F.lit(-1.0).alias("mag"), F.lit(0.0).alias("mid")),
        lambda acc, x: F.when(x["mag"] > acc["mag"], F.struct(x["mag"].alias("mag"), x["mid"].alias("mid"))).otherwise(acc))
    some = F.col("_e") > 0
    start = F.array_min(F.transform("_tiles", lambda x: x["lo"]))
    out = {
        "gpsStart": F.col("gps") + start,
        "gpsCentroid": F.col("gps") + F.col("_c"),
        "tSpread": F.sqrt(F.greatest(F.try_divide(centred, F.col("_e")), F.lit(0.0))),
        "gpsPeak": F.col("gps") + loudest["mid"],
        "duration": F.array_max(F.transform("_tiles", lambda x: x["hi"])) - start,
        "snrPeak": F.when(F.col("sigma") > 0, loudest["mag"] / F.col("sigma")),
        "EnWDF": F.when(F.col("sigma") > 0, F.sqrt(F.col("_e")) / F.col("sigma")),
        "freqMin": F.array_min(F.transform("_tiles", lambda x: x["f0"])),
        "freqMean": F.exp(F.try_divide(_fold(F.col("_tiles"), lambda x: x["e"] * x["lf"]), F.col("_e"))),
        "freqMax": F.array_max(F.transform("_tiles", lambda x: x["f1"])),
    }
    keep = [c for c in triggers.columns if c not in out]
    return t.select(*keep, *[F.when(some, e).alias(name) for name, e in out.items()])


def energy_quantiles(tiles: DataFrame, keys: Sequence[str], low: Column, high: Column, energy: Column,
                     quantiles: Sequence[float], output: str = "quantile_value") -> DataFrame:
    """Quantiles of energy spread evenly over each tile's extent, per key.

    A sweep over the edges of all tiles: each adds its density at its start and
    removes it at its end, the running density times the distance to the next
    edge is the energy in between, and the running energy is inverted. An
    interval of no width gives its energy to the stretch that starts there. An
    event of any size is swept across as many slabs as it fills.
    """
    keys = list(keys)
    boxes = tiles.select(*keys, low.alias("_lo"), high.alias("_hi"), energy.alias("_e"))
    height = F.col("_e") / (F.col("_hi") - F.col("_lo"))
    wide = boxes.where(F.col("_hi") > F.col("_lo"))
    zero = F.lit(0.0)
    edges = (
        wide.select(*keys, F.col("_lo").alias("_t"), height.alias("_dh"), zero.alias("_point"))
        .unionByName(wide.select(*keys, F.col("_hi").alias("_t"), (-height).alias("_dh"), zero.alias("_point")))
        .unionByName(boxes.where(F.col("_hi") <= F.col("_lo"))
                     .select(*keys, F.col("_lo").alias("_t"), zero.alias("_dh"), F.col("_e").alias("_point")))
        .groupBy(*keys, "_t").agg(F.sum("_dh").alias("_dh"), F.sum("_point").alias("_point"))
    )
    order = ["_t"]
    slabs = range_slabs(edges, keys, order)
    first = scan_slabs(slabs, keys, order, sums={"_h": "_dh", "_p": "_point"}, running_max={"_t0": "_t"})
    # What lies between the previous edge and this one.
    stretch = first.withColumn(
        "_mass", F.coalesce((F.col("_h") - F.col("_dh")) * (F.col("_t") - F.col("_t0")), F.lit(0.0)))
    swept = scan_slabs(stretch, keys, order, sums={"_m": "_mass"})
    swept = swept.withColumn("_upto", F.col("_m") + F.col("_p") - F.col("_point")).withColumn(
        "_here", F.col("_mass")).drop(SLAB)
    total = swept.groupBy(*keys).agg(F.max("_upto").alias("_total"), F.max("_t").alias("_last"),
                                     F.min("_t").alias("_start"))
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in quantiles]))
    # Edges strictly above the target energy, the first of which closes the stretch holding it.
    at = (
        lookup_join(swept, total, keys)
        .select("*", wanted.alias("q"))
        .withColumn("_want", F.col("q") * F.col("_total"))
    )
    above = at.where(F.col("_upto") > F.col("_want")).groupBy(*keys, "q", "_want").agg(
        F.min(F.struct("_t", "_upto")).alias("_b"))
    below = at.where(F.col("_upto") <= F.col("_want")).groupBy(*keys, "q").agg(
        F.max(F.struct("_t", "_upto")).alias("_a"))
    both = below.join(above, on=[*keys, "q"], how="left")
    a, b = F.col("_a"), F.col("_b")
    share = F.try_divide(F.col("_want") - a["_upto"], b["_upto"] - a["_upto"])
    value = F.when(b.isNull(), a["_t"]).otherwise(a["_t"] + share * (b["_t"] - a["_t"]))
    return both.select(*keys, "q", value.alias(output))


def ridge(tiles: DataFrame, keys: Sequence[str], n_bins: int = 32) -> DataFrame:
    """The loudest tile of each time bin of each event: `(keys, bin, time, log_f, energy)`.

    Bins split the event's own extent evenly. Among equally loud tiles the one
    met last in `(t_lo, f_lo)` order stands. Bins no tile falls in have no row.
    """
    keys = list(keys)
    span = tiles.groupBy(*keys).agg(F.min("t_lo").alias("_s"), F.max("t_hi").alias("_e"))
    floor_f = lambda c: F.log(F.greatest(F.col(c), F.lit(1e-12)))
    t = lookup_join(tiles, span.where(F.col("_e") > F.col("_s")), keys)
    centre = 0.5 * (F.col("t_lo") + F.col("t_hi"))
    width = (F.col("_e") - F.col("_s")) / n_bins
    t = t.withColumn("bin", F.least(F.floor((centre - F.col("_s")) / width), F.lit(n_bins - 1)).cast("int"))
    pick = F.max(F.struct("energy", "t_lo", "f_lo", centre.alias("time"),
                          (0.5 * (floor_f("f_lo") + floor_f("f_hi"))).alias("log_f")))
    return t.groupBy(*keys, "bin").agg(pick.alias("_w")).select(
        *keys, "bin", F.col("_w.time").alias("time"), F.col("_w.log_f").alias("log_f"), F.col("_w.energy").alias("energy"))


def ridge_descriptors(track: DataFrame, keys: Sequence[str], n_bins: int = 32) -> DataFrame:
    """How much of a track a ridge is. A track has at most `n_bins` rows per event."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("bin")
    octave = F.col("log_f") / log(2.0)
    t = track.withColumn("octave", octave).withColumn("step", octave - F.lag(octave).over(w))
    # n_bins bounds the list, so the line fit runs inside the row.
    got = t.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.median(F.abs("step")).alias("ridge_continuity"),
        F.sum(F.when(F.col("step") > 0, 1).otherwise(0)).alias("up"),
        F.sum(F.when(F.col("step") < 0, 1).otherwise(0)).alias("down"),
        F.array_sort(F.collect_list(F.struct("bin", "time", "octave", "energy"))).alias("r"),
    )
    fold = lambda f: F.aggregate("r", F.lit(0.0), lambda acc, x: acc + f(x))
    got = got.withColumn("_w", fold(lambda x: F.greatest(x["energy"], F.lit(0.0))))
    weight = lambda x: F.when(F.col("_w") > 0, F.greatest(x["energy"], F.lit(0.0))).otherwise(F.lit(1.0))
    got = got.withColumn("_w", F.when(F.col("_w") > 0, F.col("_w")).otherwise(F.col("n").cast("double")))
    got = got.withColumn("_ct", fold(lambda x: weight(x) * x["time"]) / F.col("_w"))
    got = got.withColumn("_cf", fold(lambda x: weight(x) * x["octave"]) / F.col("_w"))
    dt, df = (lambda x: x["time"] - F.col("_ct")), (lambda x: x["octave"] - F.col("_cf"))
    got = got.withColumn("_v", fold(lambda x: weight(x) * dt(x) * dt(x)) / F.col("_w"))
    got = got.withColumn("_slope", F.try_divide(fold(lambda x: weight(x) * dt(x) * df(x)) / F.col("_w"), F.col("_v")))
    rest = lambda x: df(x) - F.col("_slope") * dt(x)
    got = got.withColumn("_scatter", F.sqrt(fold(lambda x: weight(x) * rest(x) * rest(x)) / F.col("_w")))
    fitted = (F.col("n") >= 3) & (F.col("_v") > 0)
    moved = F.col("up") + F.col("down")
    return got.select(
        *keys, (F.col("n") / float(n_bins)).alias("ridge_occupancy"),
        F.when(fitted, F.col("_slope")).alias("ridge_slope"),
        F.when(fitted, F.col("_scatter")).alias("ridge_scatter"),
        (F.try_divide(F.greatest("up", "down"), moved) * 2.0 - 1.0).alias("ridge_monotonicity"),
        "ridge_continuity",
    )


def band_rows(tiles: DataFrame) -> DataFrame:
    """The ladder of distinct bands, numbered from the lowest: `(f_lo, f_hi, row)`.

    A dyadic ladder of one sampling rate has one row per octave over all window
    lengths, a few dozen at most, so the numbering runs over a handful of rows.
    """
    ladder = tiles.select(F.round("f_lo", 9).alias("f_lo"), F.round("f_hi", 9).alias("f_hi")).distinct()
    return ladder.withColumn("row", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("f_lo", "f_hi")) - 1))


def on_band_rows(tiles: DataFrame, ladder: DataFrame) -> DataFrame:
    keyed = tiles.withColumn("f_lo", F.round("f_lo", 9)).withColumn("f_hi", F.round("f_hi", 9))
    return keyed.join(F.broadcast(ladder), on=["f_lo", "f_hi"])


def band_mask(tiles: DataFrame, ladder: DataFrame, keys: Sequence[str] = TRIGGER_KEYS) -> DataFrame:
    """One bit per occupied band row; a ladder of more than 64 bands does not fit and is refused."""
    bit = F.expr("shiftleft(1L, cast(row as int))")
    fits = F.assert_true(F.col("row") < 64, "the ladder has more than 64 bands")
    return on_band_rows(tiles, ladder).withColumn("_ok", fits).where(F.col("_ok").isNull()).drop("_ok").groupBy(*keys).agg(F.bit_or(bit).alias("band_mask"))


def bands_touch(left: Column, right: Column, adjacency: int = 1) -> Column:
    spread = right
    for shift in range(1, adjacency + 1):
        spread = spread.bitwiseOR(F.shiftleft(right, shift)).bitwiseOR(F.shiftrightunsigned(right, shift))
    return left.bitwiseAND(spread) != F.lit(0)


def trigger_map(triggers: DataFrame, ladder: DataFrame, time_bins: int = 64, combine: str = "sum") -> DataFrame:
    """Each trigger's size-over-noise on a band by time grid scaled to its own window.

    Long form `(trigger_id, ifo, row, col, value)`; empty cells have no row.
    """
    with_origin = triggers.withColumn("w_gps", F.col("gps")).withColumn("w_n", F.col("n_coeff"))
    tiles = explode_tiles(with_origin, ["trigger_id", "ifo", "w_gps", "w_n"])
    mid = 0.5 * (F.col("t_lo") + F.col("t_hi")) - F.col("w_gps")
    span = F.col("w_n") / F.col("fs")
    col = F.least(F.floor(mid / span * time_bins), F.lit(time_bins - 1)).cast("int")
    size = F.abs("c") / wv.usable_sigma(F.col("sigma"))
    how = {"sum": F.sum, "max": F.max}[combine]
    return on_band_rows(tiles.withColumn("col", col).withColumn("_v", size), ladder).groupBy(
        "trigger_id", "ifo", "row", "col").agg(how("_v").alias("value"))


def cell_array(cells: DataFrame, keys: Sequence[str], n_rows: int, n_cols: int) -> DataFrame:
    """Long cells to one `array<double>` of `n_rows * n_cols` per key, for scoring."""
    at = F.map_from_entries(F.collect_list(F.struct((F.col("row") * n_cols + F.col("col")).cast("int"), "value")))
    grid = cells.groupBy(*keys).agg(at.alias("_m"))
    slots = F.sequence(F.lit(0), F.lit(n_rows * n_cols - 1))
    return grid.select(*keys, F.transform(slots, lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0))).alias("grid"))


def window_ridge(triggers: DataFrame, n_time_bins: int) -> DataFrame:
    """Per trigger and time bin the tile of the largest size, empty bins included.

    The lowest index wins a tie. Runs inside the row.
    """
    n, fs = F.col("n_coeff"), F.col("fs")
    pair = F.arrays_zip(F.col("wt_index").alias("i"), F.col("wt_value").alias("v"))
    span = n / fs

    def tile(p: Column) -> Column:
        k = p["i"].cast("long")
        mid = 0.5 * (wv.time_low(k, n, fs) + wv.time_high(k, n, fs))
        bin_ = F.least(F.floor(mid / span * n_time_bins), F.lit(n_time_bins - 1)).cast("int")
        return F.struct(bin_.alias("bin"), F.abs(p["v"].cast("double")).alias("mag"), (-k).alias("neg_k"),
                        wv.tile_frequency(wv.band_low(k, n, fs), wv.band_high(k, n, fs)).alias("freq"))

    t = triggers.withColumn("_tiles", F.transform(pair, tile))
    t = t.select(*[c for c in triggers.columns], "_tiles", F.explode(F.sequence(F.lit(0), F.lit(n_time_bins - 1))).alias("bin"))
    best = F.array_max(F.transform(F.filter("_tiles", lambda x: x["bin"] == F.col("bin")),
                                   lambda x: F.struct(x["mag"].alias("mag"), x["neg_k"].alias("neg_k"), x["freq"].alias("freq"))))
    return t.withColumn("_b", best).select(
        "trigger_id", "bin", ((F.col("bin") + 0.5) / n_time_bins * span).alias("time"),
        F.col("_b.freq").alias("freq"), F.col("_b.mag").alias("mag"),
        F.when(F.col("sigma") > 0, F.col("_b.mag") / F.col("sigma")).alias("snr"))
