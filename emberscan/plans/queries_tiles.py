"""Catalogue: the wavelet plane, tiles, moments, quantiles and ridges."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberscan.functions import arrays as ar
from emberscan.functions import wavelet as wv
from emberscan.operators import tiles as tl
from emberscan.plans.registry import query
from emberscan.plans.views import WIN, LOW_CUT, sparse_windows, tile_sql, windows, with_views

R6 = lambda c: F.round(c, 6)


def every_index(spark, folder):
    """One row per stored coefficient, whatever its size."""
    return windows(spark, folder).select("trigger_id", "ifo", "gps", "sigma", F.posexplode("dense").alias("k", "c"))


@query("coeff_levels", with_views(WIN) + """
SELECT CASE WHEN k = 0 THEN -1 ELSE floor(log2(k))::INT END AS level,
       count(*)::BIGINT AS n, min(CASE WHEN k = 0 THEN 0 ELSE k - pow(2, floor(log2(k)))::BIGINT END)::BIGINT AS first_pos,
       max(CASE WHEN k = 0 THEN 0 ELSE k - pow(2, floor(log2(k)))::BIGINT END)::BIGINT AS last_pos
FROM (SELECT unnest(generate_series(0, 63)) AS k FROM win) GROUP BY 1""")
def coeff_levels(spark, folder):
    k = every_index(spark, folder)
    return k.groupBy(wv.level(F.col("k")).alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.min(wv.position(F.col("k"))).alias("first_pos"), F.max(wv.position(F.col("k"))).alias("last_pos"))


@query("coeff_bands", with_views(WIN, tile_sql()) + """
SELECT level, f_lo, f_hi, count(*)::BIGINT AS n FROM tile GROUP BY 1, 2, 3""")
def coeff_bands(spark, folder):
    t = tl.explode_tiles(sparse_windows(spark, folder))
    return t.groupBy("level", "f_lo", "f_hi").agg(F.count(F.lit(1)).alias("n"))


@query("tiles_explode", with_views(WIN, tile_sql()) + """
SELECT trigger_id, ifo, k, level, round(t_lo, 9) AS t_lo, round(t_hi, 9) AS t_hi, f_lo, f_hi, round(energy, 9) AS energy FROM tile""")
def tiles_explode(spark, folder):
    t = tl.explode_tiles(sparse_windows(spark, folder))
    return t.select("trigger_id", "ifo", "k", "level", F.round("t_lo", 9).alias("t_lo"), F.round("t_hi", 9).alias("t_hi"),
                    "f_lo", "f_hi", F.round("energy", 9).alias("energy"))


@query("energy_diagnostics", with_views(WIN, tile_sql()) + """,
e AS (SELECT trigger_id, sigma, sum(c * c) AS en, count(*) AS nz FROM coef GROUP BY 1, 2)
SELECT trigger_id, round(sqrt(en), 6) AS wavelet_l2, round(en, 6) AS wavelet_energy, nz::INT AS n_active, round(sqrt(en) / sigma, 6) AS from_coeff,
       round(trigger_id % 10 - sqrt(en) / sigma, 6) AS residual FROM e""")
def energy_diagnostics(spark, folder):
    s = sparse_windows(spark, folder).where(F.size("wt_index") > 0).withColumn("EnWDF", (F.col("trigger_id") % 10).cast("double"))
    d = tl.energy_diagnostics(s)
    return d.select("trigger_id", R6("wavelet_l2").alias("wavelet_l2"), R6("wavelet_energy").alias("wavelet_energy"),
                    F.col("nActiveCoeff").alias("n_active"), R6("EnWDF_from_coeff").alias("from_coeff"), R6("EnWDF_residual").alias("residual"))


@query("dj_threshold_survivors", with_views(WIN, tile_sql(None)) + """
SELECT trigger_id, k, round(c, 9) AS c FROM coef""")
def dj_threshold_survivors(spark, folder):
    s = sparse_windows(spark, folder, cut=None)
    t = tl.explode_tiles(s)
    return t.select("trigger_id", "k", F.round("c", 9).alias("c"))


@query("sparse_roundtrip", with_views(WIN, tile_sql()) + """
SELECT w.trigger_id, len(w.dense)::INT AS n, round(coalesce(sum(c.c * c.c), 0.0), 9) AS energy, round(coalesce(sum(c.c * c.k), 0.0), 9) AS moment
FROM win w LEFT JOIN coef c USING (trigger_id) GROUP BY 1, 2""")
def sparse_roundtrip(spark, folder):
    back = ar.to_dense(F.col("wt_index"), F.col("wt_value"), F.col("n_coeff"))
    dense = sparse_windows(spark, folder).withColumn("dense", back)
    place = F.sequence(F.lit(0), F.lit(63))
    return dense.select("trigger_id", F.size("dense").alias("n"), F.round(ar.energy(F.col("dense")), 9).alias("energy"),
                        F.round(ar.dot(F.col("dense"), place), 9).alias("moment"))


@query("window_moments", with_views(WIN, tile_sql()) + """,
m AS (SELECT trigger_id, w_gps, sigma, sum(energy) AS e, sum(energy * ((t_lo + t_hi) / 2 - w_gps)) / sum(energy) AS c,
             min(t_lo) AS t0, max(t_hi) AS t1, min(f_lo) AS f0, max(f_hi) AS f1, max(abs(c)) AS mag,
             exp(sum(energy * ln(CASE WHEN f_lo <= 0 THEN f_hi / 2 ELSE sqrt(f_lo * f_hi) END)) / sum(energy)) AS fm
      FROM tile GROUP BY 1, 2, 3),
s AS (SELECT trigger_id, sqrt(sum(energy * (pow((t_lo + t_hi) / 2 - w_gps - m.c, 2) + pow(t_hi - t_lo, 2) / 12)) / sum(energy)) AS sp
      FROM tile JOIN (SELECT trigger_id, c FROM m) m USING (trigger_id) GROUP BY 1),
p AS (SELECT trigger_id, (t_lo + t_hi) / 2 AS peak FROM (
        SELECT *, row_number() OVER (PARTITION BY trigger_id ORDER BY abs(c) DESC, k) AS rn FROM tile) WHERE rn = 1)
SELECT trigger_id, round(t0, 6) AS "gpsStart", round(w_gps + m.c, 6) AS "gpsCentroid", round(sp, 6) AS "tSpread",
       round(peak, 6) AS "gpsPeak", round(t1 - t0, 6) AS duration, round(mag / sigma, 6) AS "snrPeak",
       round(sqrt(e) / sigma, 6) AS "EnWDF", f0 AS "freqMin", round(fm, 5) AS "freqMean", f1 AS "freqMax"
FROM m JOIN s USING (trigger_id) JOIN p USING (trigger_id)""")
def window_moments(spark, folder):
    m = tl.window_moments(sparse_windows(spark, folder)).where(F.col("EnWDF").isNotNull())
    six = ("gpsStart", "gpsCentroid", "tSpread", "gpsPeak", "duration", "snrPeak", "EnWDF")
    return m.select("trigger_id", *[R6(c).alias(c) for c in six], "freqMin", F.round("freqMean", 5).alias("freqMean"), "freqMax")


def quantile_sql(lo: str, hi: str) -> str:
    """The same sweep over interval edges, in SQL."""
    return with_views(WIN, tile_sql(), f"""b AS (SELECT trigger_id, {lo} AS lo, {hi} AS hi, energy AS e FROM tile),
ed AS (SELECT trigger_id, t, sum(dh) AS dh FROM (
         SELECT trigger_id, lo AS t, e / (hi - lo) AS dh FROM b UNION ALL SELECT trigger_id, hi, -e / (hi - lo) FROM b) GROUP BY 1, 2),
h AS (SELECT *, sum(dh) OVER p - dh AS before, lag(t) OVER p AS t0 FROM ed WINDOW p AS (PARTITION BY trigger_id ORDER BY t)),
c AS (SELECT *, sum(coalesce(before * (t - t0), 0)) OVER (PARTITION BY trigger_id ORDER BY t) AS upto FROM h),
w AS (SELECT trigger_id, q, q * max(upto) AS want FROM c, (SELECT unnest([0.05, 0.95]::DOUBLE[]) AS q) GROUP BY trigger_id, q),
seg AS (SELECT trigger_id, t, upto, lag(t) OVER p AS ta, lag(upto) OVER p AS ua FROM c WINDOW p AS (PARTITION BY trigger_id ORDER BY t))""") + """
SELECT s.trigger_id, q, round(ta + (want - ua) / (upto - ua) * (t - ta), 6) AS quantile_value
FROM seg s JOIN w ON w.trigger_id = s.trigger_id AND ua <= want AND want < upto"""


@query("energy_quantiles_time", quantile_sql("t_lo - w_gps", "t_hi - w_gps"))
def energy_quantiles_time(spark, folder):
    s = sparse_windows(spark, folder).withColumn("gps", F.lit(0.0))
    q = tl.energy_quantiles(tl.explode_tiles(s), ["trigger_id"], F.col("t_lo"), F.col("t_hi"), F.col("energy"), (0.05, 0.95))
    return q.select("trigger_id", "q", R6("quantile_value").alias("quantile_value"))


@query("energy_quantiles_band", quantile_sql("ln(greatest(f_lo, 1e-6::DOUBLE))", "ln(f_hi)"))
def energy_quantiles_band(spark, folder):
    t = tl.explode_tiles(sparse_windows(spark, folder))
    low, high = F.log(F.greatest(F.col("f_lo"), F.lit(1e-6))), F.log("f_hi")
    q = tl.energy_quantiles(t, ["trigger_id"], low, high, F.col("energy"), (0.05, 0.95))
    return q.select("trigger_id", "q", R6("quantile_value").alias("quantile_value"))


@query("window_ridge", with_views(WIN, tile_sql()) + """,
bins AS (SELECT trigger_id, sigma, n_coeff / fs AS span, b FROM win, (SELECT unnest(generate_series(0, 31)) AS b)),
best AS (SELECT trigger_id, b, CASE WHEN f_lo <= 0 THEN f_hi / 2 ELSE sqrt(f_lo * f_hi) END AS freq, abs(c) AS mag FROM (
  SELECT *, row_number() OVER (PARTITION BY trigger_id, b ORDER BY abs(c) DESC, k) AS rn
  FROM (SELECT *, least(floor(((t_lo - w_gps) + (t_hi - w_gps)) / 2 / (64 / fs) * 32), 31)::INT AS b FROM tile)) WHERE rn = 1)
SELECT bins.trigger_id, bins.b::INT AS bin, round((bins.b + 0.5::DOUBLE) / 32 * span, 9) AS time, round(freq, 6) AS freq, round(mag / sigma, 6) AS snr
FROM bins LEFT JOIN best ON best.trigger_id = bins.trigger_id AND best.b = bins.b""")
def window_ridge(spark, folder):
    r = tl.window_ridge(sparse_windows(spark, folder), 32)
    return r.select("trigger_id", "bin", F.round("time", 9).alias("time"), R6("freq").alias("freq"), R6("snr").alias("snr"))


RIDGE_SQL = """,
sp AS (SELECT label, ifo, min(t_lo) AS s, max(t_hi) AS e FROM tile GROUP BY 1, 2),
bn AS (SELECT tile.label, tile.ifo, energy, t_lo, f_lo, (t_lo + t_hi) * 0.5::DOUBLE AS ctr,
              0.5::DOUBLE * (ln(greatest(f_lo, 1e-12::DOUBLE)) + ln(greatest(f_hi, 1e-12::DOUBLE))) AS lf,
              least(floor((0.5::DOUBLE * (t_lo + t_hi) - s) / ((e - s) / 32)), 31)::INT AS bin
       FROM tile JOIN sp ON sp.label = tile.label AND sp.ifo = tile.ifo),
tr AS (SELECT label, ifo, bin, ctr AS time, lf AS log_f, energy FROM (
  SELECT *, row_number() OVER (PARTITION BY label, ifo, bin ORDER BY energy DESC, t_lo DESC, f_lo DESC) AS rn FROM bn) WHERE rn = 1)"""


def ridge_track(spark, folder):
    s = sparse_windows(spark, folder)
    t = tl.explode_tiles(s, ["trigger_id", "ifo", "label"])
    return tl.ridge(t, ["label", "ifo"])


@query("event_ridge", with_views(WIN, tile_sql()) + RIDGE_SQL + """
SELECT label, ifo, bin, round(time, 6) AS time, round(log_f, 6) AS log_f, round(energy, 9) AS energy FROM tr""")
def event_ridge(spark, folder):
    return ridge_track(spark, folder).select("label", "ifo", "bin", R6("time").alias("time"), R6("log_f").alias("log_f"),
                                             F.round("energy", 9).alias("energy"))


@query("ridge_descriptors", with_views(WIN, tile_sql()) + RIDGE_SQL + """,
st AS (SELECT *, log_f / ln(2.0::DOUBLE) AS oct, log_f / ln(2.0::DOUBLE) - lag(log_f / ln(2.0::DOUBLE)) OVER (PARTITION BY label, ifo ORDER BY bin) AS step FROM tr),
c AS (SELECT label, ifo, sum(energy) AS w, sum(energy * time) / sum(energy) AS ct, sum(energy * oct) / sum(energy) AS cf, count(*) AS n,
             median(abs(step)) AS cont, count(*) FILTER (WHERE step > 0) AS up, count(*) FILTER (WHERE step < 0) AS down FROM st GROUP BY 1, 2),
v AS (SELECT st.label, st.ifo, sum(energy * pow(time - ct, 2)) / max(w) AS var, sum(energy * (time - ct) * (oct - cf)) / max(w) AS cov
      FROM st JOIN c ON c.label = st.label AND c.ifo = st.ifo GROUP BY 1, 2),
r AS (SELECT st.label, st.ifo, sqrt(sum(energy * pow(oct - cf - cov / var * (time - ct), 2)) / max(w)) AS scatter
      FROM st JOIN c ON c.label = st.label AND c.ifo = st.ifo JOIN v ON v.label = st.label AND v.ifo = st.ifo GROUP BY 1, 2)
SELECT c.label, c.ifo, round(n / 32.0::DOUBLE, 6) AS ridge_occupancy, round(cov / var, 6) AS ridge_slope, round(scatter, 6) AS ridge_scatter,
       round(greatest(up, down)::DOUBLE / (up + down) * 2 - 1, 6) AS ridge_monotonicity, round(cont, 6) AS ridge_continuity
FROM c JOIN v ON v.label = c.label AND v.ifo = c.ifo JOIN r ON r.label = c.label AND r.ifo = c.ifo""")
def ridge_descriptors(spark, folder):
    d = tl.ridge_descriptors(ridge_track(spark, folder), ["label", "ifo"])
    return d.select("label", "ifo", *[R6(c).alias(c) for c in d.columns if c.startswith("ridge_")])


LADDER_SQL = """,
ladder AS (SELECT f_lo, f_hi, row_number() OVER (ORDER BY f_lo, f_hi) - 1 AS r FROM (SELECT DISTINCT round(f_lo, 9) AS f_lo, round(f_hi, 9) AS f_hi FROM tile)),
rowed AS (SELECT tile.*, r FROM tile JOIN ladder ON round(tile.f_lo, 9) = ladder.f_lo AND round(tile.f_hi, 9) = ladder.f_hi)"""


@query("band_mask", with_views(WIN, tile_sql()) + LADDER_SQL + """
SELECT trigger_id, ifo, bit_or(1::BIGINT << r::INT)::BIGINT AS band_mask FROM rowed GROUP BY 1, 2""")
def band_mask(spark, folder):
    t = tl.explode_tiles(sparse_windows(spark, folder))
    return tl.band_mask(t, tl.band_rows(t))


@query("wavegram_grid", with_views(WIN, tile_sql()) + LADDER_SQL + """
SELECT trigger_id, ifo, r::INT AS row, least(floor(((t_lo - w_gps) + (t_hi - w_gps)) / 2 / (scale / fs) * 16), 15)::INT AS col,
       round(sum(abs(c) / sigma), 6) AS value FROM rowed GROUP BY 1, 2, 3, 4""")
def wavegram_grid(spark, folder):
    s = sparse_windows(spark, folder)
    cells = tl.trigger_map(s, tl.band_rows(tl.explode_tiles(s)), 16)
    return cells.select("trigger_id", "ifo", "row", "col", R6("value").alias("value"))


@query("wavegram_grid_max", with_views(WIN, tile_sql()) + LADDER_SQL + """
SELECT trigger_id, ifo, r::INT AS row, least(floor(((t_lo - w_gps) + (t_hi - w_gps)) / 2 / (scale / fs) * 4), 3)::INT AS col,
       round(max(abs(c) / sigma), 6) AS value FROM rowed GROUP BY 1, 2, 3, 4""")
def wavegram_grid_max(spark, folder):
    s = sparse_windows(spark, folder)
    cells = tl.trigger_map(s, tl.band_rows(tl.explode_tiles(s)), 4, combine="max")
    return cells.select("trigger_id", "ifo", "row", "col", R6("value").alias("value"))
