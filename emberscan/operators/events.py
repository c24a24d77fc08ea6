"""Per-detector events: aggregates over the groups a clustering produced.

Every event table is a partial-then-final aggregation keyed by the cluster, so a
cluster of any size is combined before it is shuffled. Members stay rows of the
labelled table and are never gathered into one value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscan.functions import wavelet as wv
from emberscan.functions.intervals import TINY, finite
from emberscan.operators.scan import exact_quantiles, lookup_join
from emberscan.operators.tiles import energy_quantiles, on_band_rows, ridge, ridge_descriptors


def first_of_largest(value: Column, row_id: Column, *fields: Column) -> Column:
    """`struct` of the row with the largest value, the lowest id winning a tie."""
    return F.max(F.struct(value.alias("_v"), (-row_id).alias("_neg_id"), *fields))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def clustered_events(labelled: DataFrame, row_id: str = "id", statistic: str = "EnWDF", time: str = "gpsPeak",
                     keys: Sequence[str] = ("ifo",)) -> DataFrame:
    """One row per cluster; a noise row (`cluster_id` -1) is an event of its own."""
    noise = F.col("cluster_id") == -1
    own = labelled.withColumn("_own", F.when(noise, F.col(row_id)))
    peak = first_of_largest(F.col(statistic), F.col(row_id), F.col(time).alias("t"), F.col("freqMax").alias("f"),
                            F.col("duration").alias("d"))
    g = own.groupBy(*keys, "cluster_id", "_own").agg(
        peak.alias("_p"), F.min("gps").alias("gpsStart"), F.avg("freqMean").alias("freqMean"),
        F.min("freqMin").alias("freqMin"), F.count(F.lit(1)).alias("n_triggers"),
        (F.max(time) - F.min(time)).alias("gps_span_s"))
    return g.select(
        *keys, "cluster_id", F.col("_own").isNotNull().alias("is_noise"),
        F.coalesce("_own", F.lit(-1)).alias("trigger_index"), "gpsStart", F.col("_p.t").alias("gpsPeak"),
        F.col("_p._v").alias("EnWDF"), "freqMean", F.col("_p.f").alias("freqMax"), "freqMin",
        F.when(F.col("n_triggers") > 1, F.col("gps_span_s")).otherwise(F.col("_p.d")).alias("duration"),
        "n_triggers", "gps_span_s")


def pixel_events(tiles: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per percolated cluster of tiles."""
    keys = [*keys, "cluster_id"]
    peak = first_of_largest(F.col("energy"), F.col("tile_id"), (0.5 * (F.col("t_lo") + F.col("t_hi"))).alias("t"))
    log_f = F.log(F.greatest(wv.tile_frequency(F.col("f_lo"), F.col("f_hi")), F.lit(TINY)))
    # Distinct triggers and detectors are counted in two levels, which combines before the shuffle.
    per = tiles.groupBy(*keys).agg(
        F.min("t_lo").alias("gpsStart"), F.max("t_hi").alias("gpsEnd"), peak.alias("_p"),
        F.min("f_lo").alias("freqMin"), F.max("f_hi").alias("freqMax"),
        F.exp(weighted_mean(log_f, F.col("energy"))).alias("freqMean"),
        F.sum("energy").alias("total_energy"), F.count(F.lit(1)).alias("n_pixels"))
    members = tiles.select(*keys, "trigger_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_triggers"))
    # A set of detector names, of which there are a handful.
    names = tiles.groupBy(*keys).agg(F.array_sort(F.collect_set("ifo")).alias("ifos"))
    sigma = exact_quantiles(tiles.where(finite(F.col("sigma"))), keys, "sigma", [0.5], "sigma").drop("q")
    out = per.join(members, on=keys).join(names, on=keys).join(sigma, on=keys, how="left")
    return out.select(
        *keys, "ifos", "gpsStart", "gpsEnd", F.col("_p.t").alias("gpsPeak"), (F.col("gpsEnd") - F.col("gpsStart")).alias("duration"),
        "freqMin", "freqMean", "freqMax", F.when(F.col("sigma") > 0, F.sqrt("total_energy") / F.col("sigma")).alias("EnWDF"),
        "sigma", "total_energy", "n_pixels", "n_triggers")


def stitched_statistic(members: DataFrame, keys: Sequence[str], stride: str = "stride") -> DataFrame:
    """The statistic over an event's whole extent, each sample counted once per window length.

    A window adds the part of its square its own step region holds; lengths are
    not added to each other, the best one stands, and no event is quieter than
    its loudest window.
    """
    keys = list(keys)
    share = F.least(F.greatest(F.col(stride) * F.col("fs") / F.col("n_coeff"), F.lit(0.0)), F.lit(1.0))
    per_length = members.groupBy(*keys, "n_coeff").agg(
        F.sqrt(F.sum(share * F.col("EnWDF") * F.col("EnWDF"))).alias("_stitched"), F.max("EnWDF").alias("_best"))
    return per_length.groupBy(*keys).agg(F.greatest(F.max("_stitched"), F.max("_best")).alias("EnWDF"))


def _spread(rows: DataFrame, keys: Sequence[str], centre: Column, own: Column, weight: Column) -> DataFrame:
    """Weighted centroid and the spread about it, members' own spreads included."""
    first = rows.groupBy(*keys).agg(weighted_mean(centre, weight).alias("_centroid"))
    about = lookup_join(rows, first, keys)
    off = centre - F.col("_centroid")
    return about.groupBy(*keys).agg(
        F.first("_centroid").alias("gpsCentroid"),
        F.sqrt(F.greatest(weighted_mean(own * own + off * off, weight), F.lit(0.0))).alias("tSpread"))


def event_catalogue(labelled: DataFrame, keys: Sequence[str] = ("ifo", "cluster_id"), row_id: str = "id",
                    energy: str = "energy") -> DataFrame:
    """The wide catalogue of window chains. Members are the rows of `labelled`."""
    keys = list(keys)
    w = F.greatest(F.col(energy), F.lit(TINY))
    start = F.coalesce(F.col("gpsStart"), F.col("gps"))
    low, high = F.least("freqMin", "freqMax"), F.greatest("freqMin", "freqMax")
    good_sigma = F.when(finite(F.col("sigma")) & (F.col("sigma") > 0), F.col("sigma"))
    peak = first_of_largest(F.col("EnWDF"), F.col(row_id), F.col("gpsPeak").alias("t"))
    base = labelled.groupBy(*keys).agg(
        F.min(start).alias("gpsStart"), F.max("gpsEnd").alias("gpsEnd"), peak.alias("_p"),
        F.min(low).alias("freqMin"), weighted_mean(F.col("freqMean"), w).alias("freqMean"), F.max(high).alias("freqMax"),
        F.max("EnWDF").alias("EnWDF"), F.sqrt(F.sum(F.col("EnWDF") * F.col("EnWDF"))).alias("cluster_sum_enwdf"),
        F.try_divide(F.sum(good_sigma * w), F.sum(F.when(good_sigma.isNotNull(), w))).alias("sigmaWin"),
        F.sum(w).alias("coefficient_energy"), F.count(F.lit(1)).alias("n_triggers"))
    centre = F.coalesce(F.col("gpsCentroid"), F.col("gpsPeak"))
    spread = _spread(labelled, keys, centre, F.coalesce(F.col("tSpread"), F.lit(0.0)), w)
    span = F.greatest(F.lit(0.0), F.col("gpsEnd") - F.col("gpsStart"))
    return base.join(spread, on=keys).select(
        *keys, "gpsStart", "gpsEnd", F.col("_p.t").alias("gpsPeak"), "gpsCentroid", "tSpread", span.alias("duration"),
        "freqMin", "freqMean", "freqMax", "EnWDF", "cluster_sum_enwdf", "sigmaWin", "coefficient_energy", "n_triggers",
        (F.col("n_triggers") == 1).alias("singleton"))


def detector_events(nodes: DataFrame, tiles: DataFrame | None = None, keys: Sequence[str] = ("ifo", "cluster_id"),
                    row_id: str = "trigger_id") -> DataFrame:
    """Events of a detector graph. `nodes` are labelled triggers carrying `significance` and `stride`.

    An event of several members is measured again on its own tiles when they are
    given (`tiles` carries the same keys): energy quantiles, geometric mean
    frequency and ridge. An event of one member keeps its own.
    """
    keys = list(keys)
    on = F.when(finite(F.col("gpsStart")), F.col("gpsStart")).otherwise(F.col("gps"))
    ext = F.when(finite(F.col("duration")), F.col("duration")).otherwise(F.col("n_coeff") / F.col("fs"))
    n = nodes.withColumn("_on", on).withColumn("_off", on + ext)
    w = F.greatest(F.col("EnWDF") * F.col("EnWDF"), F.lit(TINY))
    sigma = F.when(finite(F.col("sigma")) & (F.col("sigma") > 0), F.col("sigma"))
    kept = [c for c in ("duration90", "freqQ05", "freqQ95") if c in nodes.columns]
    peak = first_of_largest(F.col("significance"), F.col(row_id), F.col("gpsPeak").alias("t"), F.col("EnWDF").alias("e"),
                            F.col("n_coeff").alias("n"), F.col("fs").alias("fs"), *[F.col(c) for c in kept])
    base = n.groupBy(*keys).agg(
        F.min("gps").alias("gps"), F.min("_on").alias("gpsStart"), (F.max("_off") - F.min("_on")).alias("duration"),
        F.min("freqMin").alias("freqMin"), weighted_mean(F.col("freqMean"), w).alias("freqMean"), F.max("freqMax").alias("freqMax"),
        F.avg(sigma).alias("sigma"), F.max("snrPeak").alias("snrPeak"), peak.alias("_p"), F.count(F.lit(1)).alias("n_triggers"))
    centre = F.when(finite(F.col("gpsCentroid")), F.col("gpsCentroid")).otherwise(F.col("gps"))
    spread = _spread(n, keys, centre, F.coalesce(F.col("tSpread"), F.lit(0.0)), w)
    scales = n.select(*keys, "n_coeff").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_scales"))
    out = base.join(spread, on=keys).join(scales, on=keys).join(stitched_statistic(nodes, keys), on=keys).select(
        *keys, "gps", "gpsStart", "gpsCentroid", "tSpread", F.col("_p.t").alias("gpsPeak"), "duration",
        "freqMin", "freqMean", "freqMax", "EnWDF", F.col("_p.e").alias("EnWDF_window"), "sigma", "snrPeak",
        F.col("_p._v").alias("significance"), "n_triggers", "n_scales", F.col("_p.n").alias("scale_best"),
        F.col("_p.fs").alias("fs"), *[F.col(f"_p.{c}").alias(c) for c in kept])
    return out if tiles is None else _measured_on_tiles(out, tiles, keys, kept)


def _measured_on_tiles(events: DataFrame, tiles: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    several = events.where(F.col("n_triggers") > 1).select(*keys)
    noise = wv.usable_sigma(F.col("sigma"))
    t = tiles.withColumn("energy", F.col("c") * F.col("c") / (noise * noise))
    t = lookup_join(t, several, keys)
    lo_f, hi_f = (F.log(F.greatest(F.col(c), F.lit(TINY))) for c in ("f_lo", "f_hi"))
    wide = lambda q, name: q.groupBy(*keys).agg(
        F.max(F.when(F.col("q") == 0.05, F.col("quantile_value"))).alias(name + "05"),
        F.max(F.when(F.col("q") == 0.95, F.col("quantile_value"))).alias(name + "95"))
    times = wide(energy_quantiles(t, keys, F.col("t_lo"), F.col("t_hi"), F.col("energy"), (0.05, 0.95)), "_t")
    bands = wide(energy_quantiles(t, keys, lo_f, hi_f, F.col("energy"), (0.05, 0.95)), "_f")
    geometric = t.groupBy(*keys).agg(F.exp(weighted_mean(0.5 * (lo_f + hi_f), F.col("energy"))).alias("_fm"))
    track = ridge_descriptors(ridge(t, keys), keys)
    m = times.join(bands, on=keys).join(geometric, on=keys).join(track, on=keys, how="left")
    out = events.join(m, on=keys, how="left")
    new = {"duration90": F.col("_t95") - F.col("_t05"), "freqQ05": F.exp("_f05"), "freqQ95": F.exp("_f95"), "freqMean": F.col("_fm")}
    for name, value in new.items():
        out = out.withColumn(name, F.coalesce(value, F.col(name)) if name in [*kept, "freqMean"] else value)
    return out.drop("_t05", "_t95", "_f05", "_f95", "_fm")


def event_map(nodes: DataFrame, tiles: DataFrame, ladder: DataFrame, bin_seconds: float, time_bins: int = 64,
              keys: Sequence[str] = ("ifo", "cluster_id"), row_id: str = "trigger_id") -> DataFrame:
    """Each event's size-over-noise on a common time base: `(keys, row, col, value)`.

    A column is `bin_seconds` wide wherever it is drawn, and the map is centred
    on the loudest member's peak, an instant two detectors share.
    """
    keys = list(keys)
    loud = first_of_largest(F.greatest(F.col("EnWDF") * F.col("EnWDF"), F.lit(TINY)), F.col(row_id), F.col("gpsPeak").alias("t"))
    anchor = nodes.groupBy(*keys).agg(loud.alias("_l")).select(
        *keys, (F.col("_l.t") - F.lit(0.5 * time_bins * bin_seconds)).alias("_first"))
    placed = lookup_join(on_band_rows(tiles, ladder), anchor, keys)
    mid = 0.5 * (F.col("t_lo") + F.col("t_hi"))
    placed = placed.withColumn("col", F.floor((mid - F.col("_first")) / F.lit(bin_seconds)).cast("int"))
    inside = placed.where((F.col("col") >= 0) & (F.col("col") < time_bins))
    return inside.groupBy(*keys, "row", "col").agg(
        F.sum(F.abs("c") / wv.usable_sigma(F.col("sigma"))).alias("value"), F.first("_first").alias("gps_first"))


def tile_cluster_events(tiles: DataFrame, keys: Sequence[str] = ("cluster_id",), row_id: str = "tile_id") -> DataFrame:
    """Events of the tile graph: energy and timing from the most significant window length only."""
    keys = list(keys)
    loud = first_of_largest(F.col("significance"), F.col(row_id), F.col("scale").alias("s"), F.col("ifo").alias("ifo"),
                            (0.5 * (F.col("t_lo") + F.col("t_hi"))).alias("t"), F.col("energy").alias("e"), F.col("fs").alias("fs"))
    whole = tiles.groupBy(*keys).agg(
        loud.alias("_l"), F.min("t_lo").alias("gpsStart"), (F.max("t_hi") - F.min("t_lo")).alias("duration"),
        F.min("f_lo").alias("freqMin"), F.max("f_hi").alias("freqMax"), F.count(F.lit(1)).alias("n_pixels"))
    scales = tiles.select(*keys, "scale").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_scales"))
    best = lookup_join(tiles, whole.select(*keys, F.col("_l.s").alias("_s")), keys).where(F.col("scale") == F.col("_s"))
    centre = 0.5 * (F.col("t_lo") + F.col("t_hi"))
    band = F.sqrt(F.greatest(F.col("f_lo"), F.lit(TINY)) * F.col("f_hi"))
    sigma = F.when(finite(F.col("sigma")) & (F.col("sigma") > 0), F.col("sigma"))
    measured = best.groupBy(*keys).agg(
        F.sum("energy").alias("energy"), F.avg(sigma).alias("sigma"),
        (F.sum(band * F.col("energy")) / F.greatest(F.sum("energy"), F.lit(TINY))).alias("freqMean"))
    spread = _spread(best, keys, centre, F.lit(0.0), F.col("energy"))
    return whole.join(scales, on=keys).join(measured, on=keys).join(spread, on=keys).select(
        *keys, F.col("_l.ifo").alias("ifo"), "gpsStart", "gpsCentroid", "tSpread", F.col("_l.t").alias("gpsPeak"), "duration",
        "freqMin", "freqMean", "freqMax", (F.sqrt("energy") / F.col("sigma")).alias("EnWDF"), "sigma",
        (F.sqrt(F.col("_l.e")) / F.col("sigma")).alias("snrPeak"), F.col("_l._v").alias("significance"),
        "energy", "n_pixels", "n_scales", F.col("_l.s").alias("scale_best"), F.col("_l.fs").alias("fs"))


def cluster_extent(members: DataFrame, keys: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """Size, span and noise scale of each cluster's window matrix."""
    keys = list(keys)
    base = members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_triggers"), F.max("n_coeff").alias("n_coeff"), F.min("gps").alias("gps_start"),
        F.max(F.col("gps") + F.col("n_coeff") / F.col("fs")).alias("gps_end"))
    noise = exact_quantiles(members.where(finite(F.col("sigma")) & (F.col("sigma") > 0)), keys, "sigma", [0.5], "noise_scale")
    return base.join(noise.drop("q"), on=keys, how="left").withColumn("duration", F.col("gps_end") - F.col("gps_start"))


def cluster_map(members: DataFrame, tiles: DataFrame, time_bins: int = 64, keys: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """Each cluster on an octave by time grid over its own extent, the largest value of a cell standing."""
    keys = list(keys)
    extent = cluster_extent(members, keys).select(
        *keys, F.col("gps_start").alias("_s"), F.greatest(F.col("duration"), F.lit(1e-9)).alias("_d"),
        wv.usable_sigma(F.col("noise_scale")).alias("_noise"))
    t = lookup_join(tiles, extent, keys)
    mid = 0.5 * (F.col("t_lo") + F.col("t_hi"))
    col = F.least(F.greatest(F.floor((mid - F.col("_s")) / F.col("_d") * time_bins), F.lit(0)), F.lit(time_bins - 1)).cast("int")
    return t.groupBy(*keys, (F.col("level") + 1).cast("int").alias("row"), col.alias("col")).agg(
        F.max(F.abs("c") / F.col("_noise")).alias("value"))


def score_by_reconstruction(events: DataFrame, stitched: DataFrame, keys: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """Replace the statistic by the reconstruction's, keeping the window's own where there is none."""
    s = stitched.select(*keys, F.col("EnWDF").alias("_rec"), F.col("windows").alias("n_windows"))
    joined = events.join(s, on=list(keys), how="left")
    return joined.withColumn("EnWDF_window", F.col("EnWDF")).withColumn("EnWDF", F.coalesce("_rec", "EnWDF")).drop("_rec")
