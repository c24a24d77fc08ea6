"""Catalogue: clustering triggers and tiles, and the events they become."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberscan.operators import cluster as cl
from emberscan.operators import events as ev
from emberscan.operators import tiles as tl
from emberscan.operators.components import label_rows
from emberscan.operators.scan import exact_quantiles, islands
from emberscan.operators.signal import combined_statistic
from emberscan.plans.registry import query
from emberscan.plans.queries_tiles import LADDER_SQL
from emberscan.plans.views import TRIG, WIN, sparse_windows, tile_sql, triggers, windows, with_views
from emberscan.session import cut_lineage

R6 = lambda c: F.round(c, 6)


@query("islands_1d", with_views(TRIG) + """,
r AS (SELECT id, ifo, "gpsStart" AS s, "gpsEnd" AS e, max("gpsEnd") OVER (PARTITION BY ifo ORDER BY "gpsStart", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM trig),
o AS (SELECT *, CASE WHEN reach IS NULL OR s - reach > 30.0 THEN 1 ELSE 0 END AS opens FROM r)
SELECT id, ifo, (sum(opens) OVER (PARTITION BY ifo ORDER BY s, id) - 1)::BIGINT AS island FROM o""")
def islands_1d(spark, folder):
    t = triggers(spark, folder).select("id", "ifo", "gpsStart", "gpsEnd")
    return islands(t, ["ifo"], "gpsStart", "gpsEnd", "id", gap=30.0).select("id", "ifo", "island")


# Tiles with one number each, from the trigger and the index in it.
TILED = """,
tiles AS (SELECT *, trigger_id * 64 + k AS tile_id, energy / (sigma * sigma) AS norm_energy FROM tile)"""


def numbered_tiles(spark, folder, *carry):
    t = tl.explode_tiles(sparse_windows(spark, folder), ["trigger_id", "ifo", *carry])
    return t.withColumn("tile_id", F.col("trigger_id") * 64 + F.col("k")).withColumn(
        "norm_energy", tl.normalised_energy(F.col("energy"), F.col("sigma")))


# Least label reachable over an edge table, by a recursive query that keeps one row per vertex.
def recursive_labels(nodes: str, edges: str, name: str = "cc") -> str:
    return f""",
{name}_e AS ({edges}),
{name}(id, comp) USING KEY (id) AS (
  SELECT id, id AS comp FROM ({nodes})
  UNION
  SELECT e.d, min({name}.comp) FROM {name} JOIN {name}_e e ON e.s = {name}.id JOIN recurring.{name} r ON r.id = e.d
  WHERE {name}.comp < r.comp GROUP BY e.d)"""


PERCOLATED = TILED + recursive_labels("SELECT tile_id AS id FROM tiles", """
  SELECT a.tile_id AS s, b.tile_id AS d FROM tiles a JOIN tiles b ON a.ifo = b.ifo AND a.tile_id <> b.tile_id
  AND a.t_lo <= b.t_hi + 0.002 AND b.t_lo <= a.t_hi + 0.002 AND a.f_lo <= b.f_hi AND b.f_lo <= a.f_hi""") + """,
pix AS (SELECT t.*, cc.comp AS cluster_id FROM tiles t JOIN cc ON cc.id = t.tile_id)"""

RWITH = "WITH RECURSIVE "


def percolated(spark, folder, *carry):
    return cut_lineage(cl.percolate(numbered_tiles(spark, folder, *carry), 0.002, "tile_id", ["ifo"]))


@query("percolation_tiles", RWITH + WIN + "," + tile_sql() + PERCOLATED + """
SELECT tile_id, cluster_id FROM pix""")
def percolation_tiles(spark, folder):
    return percolated(spark, folder).select("tile_id", "cluster_id")


@query("trigger_to_cluster", RWITH + WIN + "," + tile_sql() + PERCOLATED + """
SELECT trigger_id, cluster_id FROM (SELECT trigger_id, cluster_id, row_number() OVER (PARTITION BY trigger_id ORDER BY round(sum(energy), 9) DESC, cluster_id) AS rn
  FROM pix GROUP BY 1, 2) WHERE rn = 1""")
def trigger_to_cluster(spark, folder):
    p = percolated(spark, folder)
    return cl.trigger_labels(p)


@query("pixel_events", RWITH + WIN + "," + tile_sql() + PERCOLATED + """,
pk AS (SELECT cluster_id, (t_lo + t_hi) / 2 AS peak FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY energy DESC, tile_id) AS rn FROM pix) WHERE rn = 1)
SELECT cluster_id, string_agg(DISTINCT ifo, ',' ORDER BY ifo) AS ifos, round(min(t_lo), 6) AS "gpsStart", round(max(t_hi), 6) AS "gpsEnd", round(max(peak), 6) AS "gpsPeak",
       round(max(t_hi) - min(t_lo), 6) AS duration, min(f_lo) AS "freqMin", round(exp(sum(energy * ln(CASE WHEN f_lo <= 0 THEN f_hi / 2 ELSE sqrt(f_lo * f_hi) END)) / sum(energy)), 5) AS "freqMean",
       max(f_hi) AS "freqMax", round(sqrt(sum(energy)) / median(sigma), 6) AS "EnWDF", round(sum(energy), 6) AS total_energy, count(*)::BIGINT AS n_pixels,
       count(DISTINCT trigger_id)::BIGINT AS n_triggers
FROM pix JOIN pk USING (cluster_id) GROUP BY cluster_id""")
def pixel_events(spark, folder):
    e = ev.pixel_events(percolated(spark, folder))
    six = ("gpsStart", "gpsEnd", "gpsPeak", "duration", "EnWDF", "total_energy")
    return e.select("cluster_id", F.array_join("ifos", ",").alias("ifos"), *[R6(c).alias(c) for c in six], "freqMin",
                    F.round("freqMean", 5).alias("freqMean"), "freqMax", "n_pixels", "n_triggers")


CHAIN = """,
chain_src AS (SELECT *, "EnWDF" * "EnWDF" AS energy FROM trig)""" + recursive_labels("SELECT id FROM chain_src", """
  SELECT p.s, p.d FROM (
    SELECT a.id AS s, b.id AS d, a.energy AS ea, b.energy AS eb, a."freqMin" AS a0, a."freqMax" AS a1, b."freqMin" AS b0, b."freqMax" AS b1
    FROM chain_src a JOIN chain_src b ON a.ifo = b.ifo AND a.id <> b.id AND b.gps >= a.gps - 250.0 AND b.gps <= a.gps + 250.0) p
  WHERE abs(ln(greatest(ea, 1e-12)) - ln(greatest(eb, 1e-12))) <= 3.0
    AND greatest(0.0, least(a1, b1) - greatest(a0, b0)) / greatest(least(a1 - a0, b1 - b0), 1e-12) >= 0.25""") + """,
lab AS (SELECT t.*, cc.comp AS cluster_id FROM chain_src t JOIN cc ON cc.id = t.id)"""
CHAIN_CONFIG = cl.ChainConfig(max_missing_windows=1, minimum_frequency_overlap=0.25)


def chains(spark, folder):
    t = triggers(spark, folder).withColumn("energy", F.col("EnWDF") * F.col("EnWDF"))
    return cl.window_chains(t, 100.0, CHAIN_CONFIG)


@query("window_chain_clusters", RWITH + TRIG + CHAIN + """
SELECT id, cluster_id FROM lab""")
def window_chain_clusters(spark, folder):
    return chains(spark, folder).select("id", "cluster_id")


@query("event_catalogue", RWITH + TRIG + CHAIN + """,
c AS (SELECT ifo, cluster_id, sum("gpsCentroid" * energy) / sum(energy) AS cen FROM lab GROUP BY 1, 2),
s AS (SELECT lab.ifo, lab.cluster_id, sqrt(sum(energy * (pow("tSpread", 2) + pow("gpsCentroid" - cen, 2))) / sum(energy)) AS spread
      FROM lab JOIN c ON c.ifo = lab.ifo AND c.cluster_id = lab.cluster_id GROUP BY 1, 2),
p AS (SELECT cluster_id, gps AS peak FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY "EnWDF" DESC, id) AS rn FROM lab) WHERE rn = 1)
SELECT lab.ifo, lab.cluster_id, round(min("gpsStart"), 6) AS "gpsStart", round(max("gpsEnd"), 6) AS "gpsEnd", round(max(peak), 6) AS "gpsPeak",
       round(max(cen), 6) AS "gpsCentroid", round(max(spread), 6) AS "tSpread", round(min("freqMin"), 6) AS "freqMin", round(sum("freqMean" * energy) / sum(energy), 6) AS "freqMean",
       round(max("freqMax"), 6) AS "freqMax", max("EnWDF") AS "EnWDF", round(sqrt(sum("EnWDF" * "EnWDF")), 6) AS cluster_sum_enwdf,
       round(sum(sigma * energy) / sum(energy), 6) AS "sigmaWin", count(*)::BIGINT AS n_triggers, count(*) = 1 AS singleton
FROM lab JOIN c ON c.ifo = lab.ifo AND c.cluster_id = lab.cluster_id JOIN s ON s.cluster_id = lab.cluster_id JOIN p ON p.cluster_id = lab.cluster_id GROUP BY 1, 2""")
def event_catalogue(spark, folder):
    e = ev.event_catalogue(chains(spark, folder))
    six = ("gpsStart", "gpsEnd", "gpsPeak", "gpsCentroid", "tSpread", "freqMin", "freqMean", "freqMax", "cluster_sum_enwdf", "sigmaWin")
    return e.select("ifo", "cluster_id", *[R6(c).alias(c) for c in six],
                    "EnWDF", "n_triggers", "singleton")


@query("clustered_events", RWITH + TRIG + CHAIN + """,
size AS (SELECT cluster_id AS c, count(*) AS n FROM lab GROUP BY 1),
l2 AS (SELECT lab.*, CASE WHEN n >= 2 THEN cluster_id ELSE -1 END AS cl, CASE WHEN n >= 2 THEN -1 ELSE id END AS own FROM lab JOIN size ON c = cluster_id),
p AS (SELECT cl, own, gps AS peak, "EnWDF" AS e, "freqMax" AS fmax, duration AS d FROM (SELECT *, row_number() OVER (PARTITION BY cl, own ORDER BY "EnWDF" DESC, id) AS rn FROM l2) WHERE rn = 1)
SELECT ifo, l2.cl AS cluster_id, l2.own AS trigger_index, l2.own >= 0 AS is_noise, round(min(gps), 6) AS "gpsStart", round(max(peak), 6) AS "gpsPeak", max(e) AS "EnWDF",
       round(avg("freqMean"), 6) AS "freqMean", round(max(fmax), 6) AS "freqMax", round(min("freqMin"), 6) AS "freqMin",
       round(CASE WHEN count(*) > 1 THEN max(gps) - min(gps) ELSE max(d) END, 6) AS duration, count(*)::BIGINT AS n_triggers
FROM l2 JOIN p ON p.cl = l2.cl AND p.own = l2.own GROUP BY 1, 2, 3, 4""")
def clustered_events(spark, folder):
    lab = chains(spark, folder)
    sizes = lab.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n"))
    lab = lab.join(sizes, "cluster_id").withColumn("cluster_id", F.when(F.col("_n") >= 2, F.col("cluster_id")).otherwise(F.lit(-1)))
    e = ev.clustered_events(lab)
    six = ("gpsStart", "gpsPeak", "freqMean", "freqMax", "freqMin", "duration")
    return e.select("ifo", "cluster_id", "trigger_index", "is_noise", *[R6(c).alias(c) for c in six], "EnWDF", "n_triggers")


@query("stitched_statistic", RWITH + TRIG + CHAIN + """,
per AS (SELECT cluster_id, n_coeff, sqrt(sum(least(greatest(0.75, 0.0), 1.0) * "EnWDF" * "EnWDF")) AS st, max("EnWDF") AS b FROM lab GROUP BY 1, 2)
SELECT cluster_id, round(greatest(max(st), max(b)), 6) AS "EnWDF" FROM per GROUP BY 1""")
def stitched_statistic(spark, folder):
    lab = chains(spark, folder).withColumn("fs", F.lit(2048.0)).withColumn("stride", F.lit(0.75) * F.col("n_coeff") / F.lit(2048.0))
    return ev.stitched_statistic(lab, ["cluster_id"]).select("cluster_id", R6("EnWDF").alias("EnWDF"))


# --- the two graphs ----------------------------------------------------------


def graph_nodes(spark, folder):
    """Sparse windows with their moments, band mask and significance: the nodes of a detector graph."""
    s = tl.window_moments(sparse_windows(spark, folder)).where(F.col("EnWDF").isNotNull())
    t = tl.explode_tiles(s)
    mask = tl.band_mask(t, tl.band_rows(t))
    nodes = s.join(mask, on=["trigger_id", "ifo"]).withColumn("significance", F.log1p("EnWDF"))
    # Read by the edges twice over and by the events again: written once instead.
    return cut_lineage(nodes)


GRAPH = LADDER_SQL + """,
mask AS (SELECT trigger_id, bit_or(1::BIGINT << r::INT)::BIGINT AS m FROM rowed GROUP BY 1),
node AS (SELECT trigger_id, ifo, w_gps AS gps, min(t_lo) AS t0, max(t_hi) AS t1, min(f_lo) AS f0, max(f_hi) AS f1, sqrt(sum(energy)) / max(sigma) AS e, max(m) AS m
         FROM tile JOIN mask USING (trigger_id) GROUP BY 1, 2, 3),
gedge AS (SELECT a.ifo, a.trigger_id AS s, b.trigger_id AS d, a.t0 - b.t0 AS onset_gap,
   greatest(0.0, least(1.0, (least(a.t1, b.t1) - greatest(a.t0, b.t0)) / greatest(least(a.t1 - a.t0, b.t1 - b.t0), 1e-12))) AS time_overlap,
   greatest(0.0, least(1.0, (least(a.f1, b.f1) - greatest(a.f0, b.f0)) / greatest(least(a.f1 - a.f0, b.f1 - b.f0), 1e-12))) AS frequency_overlap,
   ln(a.e * a.e / (b.e * b.e)) AS log_energy_ratio, ln(1 + least(a.e, b.e)) AS significance_min, ln(1 + greatest(a.e, b.e)) AS significance_max
 FROM node a JOIN node b ON a.ifo = b.ifo AND a.gps < b.gps
 WHERE greatest(b.t0 - a.t1, a.t0 - b.t1) <= 0.03125 AND (a.m & (b.m | (b.m << 1) | (b.m >> 1))) <> 0 AND abs(ln(a.e * a.e) - ln(b.e * b.e)) <= 3.0)"""


@query("detector_edges", with_views(WIN, tile_sql()) + GRAPH + """
SELECT ifo, s AS src, d AS dst, round(onset_gap, 6) AS onset_gap, round(time_overlap, 6) AS time_overlap, round(frequency_overlap, 6) AS frequency_overlap,
       round(log_energy_ratio, 6) AS log_energy_ratio, round(significance_min, 6) AS significance_min, round(significance_max, 6) AS significance_max, 0.0::DOUBLE AS cross_scale FROM gedge""")
def detector_edges(spark, folder):
    e = cl.detector_edges(graph_nodes(spark, folder))
    six = ("onset_gap", "time_overlap", "frequency_overlap", "log_energy_ratio", "significance_min", "significance_max")
    return e.select("ifo", "src", "dst", *[R6(c).alias(c) for c in six], "cross_scale")


def labelled_nodes(spark, folder):
    n = graph_nodes(spark, folder)
    lab = label_rows(n, cl.detector_edges(n), "trigger_id", output="cluster_id")
    return cut_lineage(lab.withColumn("stride", F.lit(48 / 2048.0)))


LABELLED = GRAPH + recursive_labels("SELECT trigger_id AS id FROM node", "SELECT s, d FROM gedge UNION ALL SELECT d, s FROM gedge") + """,
nl AS (SELECT t.*, cc.comp AS cluster_id FROM tile t JOIN cc ON cc.id = t.trigger_id)"""


@query("detector_components", RWITH + WIN + "," + tile_sql() + LABELLED + """
SELECT id AS trigger_id, comp AS cluster_id FROM cc""")
def detector_components(spark, folder):
    return labelled_nodes(spark, folder).select("trigger_id", "cluster_id")


@query("detector_events", RWITH + WIN + "," + tile_sql() + LABELLED + """,
trg AS (SELECT trigger_id, ifo, cluster_id, w_gps AS gps, sqrt(sum(energy)) / max(sigma) AS e, min(t_lo) AS t0, max(t_hi) AS t1, min(f_lo) AS f0, max(f_hi) AS f1,
               sum(energy * (t_lo + t_hi) / 2) / sum(energy) AS cen, max(abs(c)) / max(sigma) AS snr FROM nl GROUP BY 1, 2, 3, 4)
SELECT ifo, cluster_id, round(min(gps), 6) AS gps, round(min(t0), 6) AS "gpsStart", round(sum(cen * e * e) / sum(e * e), 6) AS "gpsCentroid",
       round(max(t1) - min(t0), 6) AS duration, min(f0) AS "freqMin", max(f1) AS "freqMax", round(greatest(max(e), sqrt(0.75 * sum(e * e))), 6) AS "EnWDF",
       round(max(e), 6) AS "EnWDF_window", round(max(snr), 6) AS "snrPeak", count(*)::BIGINT AS n_triggers, 1::BIGINT AS n_scales
FROM trg GROUP BY 1, 2""")
def detector_events(spark, folder):
    e = ev.detector_events(labelled_nodes(spark, folder))
    six = ("gps", "gpsStart", "gpsCentroid", "duration", "EnWDF", "EnWDF_window", "snrPeak")
    return e.select("ifo", "cluster_id", *[R6(c).alias(c) for c in six], "freqMin", "freqMax", "n_triggers", "n_scales")


@query("detector_events_on_tiles")
def detector_events_on_tiles(spark, folder):
    """The same events with quantiles, geometric frequency and ridge measured on their own tiles."""
    nodes = labelled_nodes(spark, folder)
    return ev.detector_events(nodes, tl.explode_tiles(nodes, ["trigger_id", "ifo", "cluster_id"]))


@query("event_map", RWITH + WIN + "," + tile_sql() + LABELLED + """,
pk AS (SELECT trigger_id, (t_lo + t_hi) / 2 AS peak FROM (SELECT *, row_number() OVER (PARTITION BY trigger_id ORDER BY abs(c) DESC, k) AS rn FROM tile) WHERE rn = 1),
trg AS (SELECT trigger_id, cluster_id, sum(energy) / max(sigma * sigma) AS w FROM nl GROUP BY 1, 2),
anchor AS (SELECT cluster_id, peak - 0.09375 AS first FROM (SELECT t.cluster_id, peak, row_number() OVER (PARTITION BY t.cluster_id ORDER BY w DESC, t.trigger_id) AS rn FROM trg t JOIN pk USING (trigger_id)) WHERE rn = 1),
cells AS (SELECT nl.ifo, nl.cluster_id, ladder.r::INT AS row, floor(((t_lo + t_hi) / 2 - first) / 0.0234375)::INT AS col, abs(c) / sigma AS v
          FROM nl JOIN anchor USING (cluster_id) JOIN ladder ON round(nl.f_lo, 9) = ladder.f_lo AND round(nl.f_hi, 9) = ladder.f_hi)
SELECT ifo, cluster_id, row, col, round(sum(v), 6) AS value FROM cells WHERE col >= 0 AND col < 8 GROUP BY 1, 2, 3, 4""")
def event_map(spark, folder):
    nodes = labelled_nodes(spark, folder)
    t = tl.explode_tiles(nodes, ["trigger_id", "ifo", "cluster_id"])
    m = ev.event_map(nodes, t, tl.band_rows(t), 48 / 2048.0, 8)
    return m.select("ifo", "cluster_id", "row", "col", R6("value").alias("value"))


TILE_GRAPH = TILED + """,
tedge AS (SELECT a.ifo, a.tile_id AS s, b.tile_id AS d, greatest(b.t_lo - a.t_hi, a.t_lo - b.t_hi) AS gap,
    greatest(0.0, least(1.0, (least(a.f_hi, b.f_hi) - greatest(a.f_lo, b.f_lo)) / greatest(least(a.f_hi - a.f_lo, b.f_hi - b.f_lo), 1e-12))) AS fo,
    ln(1 + least(a.norm_energy, b.norm_energy)) AS smin, ln(1 + greatest(a.norm_energy, b.norm_energy)) AS smax
  FROM tiles a JOIN tiles b ON a.ifo = b.ifo AND (a.t_lo < b.t_lo OR (a.t_lo = b.t_lo AND a.tile_id < b.tile_id))
  WHERE greatest(b.t_lo - a.t_hi, a.t_lo - b.t_hi) <= 0.25 * ((a.t_hi - a.t_lo) + (b.t_hi - b.t_lo)) AND a.f_lo <= b.f_hi AND b.f_lo <= a.f_hi)"""


def significant_tiles(spark, folder):
    return numbered_tiles(spark, folder).withColumn("significance", F.log1p("norm_energy"))


@query("tile_edges", with_views(WIN, tile_sql()) + TILE_GRAPH + """
SELECT ifo, s AS src, d AS dst, round(gap, 6) AS time_gap, round(fo, 6) AS frequency_overlap, round(smin, 6) AS significance_min, round(smax, 6) AS significance_max FROM tedge""")
def tile_edges(spark, folder):
    e = cl.tile_edges(significant_tiles(spark, folder), time_tolerance=0.5)
    six = ("time_gap", "frequency_overlap", "significance_min", "significance_max")
    return e.select("ifo", "src", "dst", *[R6(c).alias(c) for c in six])


@query("tile_cluster_events", RWITH + WIN + "," + tile_sql() + TILE_GRAPH + recursive_labels(
    "SELECT tile_id AS id FROM tiles", "SELECT s, d FROM tedge UNION ALL SELECT d, s FROM tedge") + """,
g AS (SELECT t.*, cc.comp AS cluster_id FROM tiles t JOIN cc ON cc.id = t.tile_id),
ce AS (SELECT cluster_id, sum(energy * (t_lo + t_hi) / 2) / sum(energy) AS cen FROM g GROUP BY 1),
pk AS (SELECT cluster_id, (t_lo + t_hi) / 2 AS peak, energy AS pe FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY norm_energy DESC, tile_id) AS rn FROM g) WHERE rn = 1)
SELECT g.cluster_id, round(min(t_lo), 6) AS "gpsStart", round(max(cen), 6) AS "gpsCentroid", round(sqrt(sum(energy * pow((t_lo + t_hi) / 2 - cen, 2)) / sum(energy)), 6) AS "tSpread",
       round(max(peak), 6) AS "gpsPeak", round(max(t_hi) - min(t_lo), 6) AS duration, min(f_lo) AS "freqMin", round(sum(sqrt(greatest(f_lo, 1e-12) * f_hi) * energy) / sum(energy), 5) AS "freqMean",
       max(f_hi) AS "freqMax", round(sqrt(sum(energy)) / avg(sigma), 6) AS "EnWDF", round(sqrt(max(pe)) / avg(sigma), 6) AS "snrPeak", count(*)::BIGINT AS n_pixels, 1::BIGINT AS n_scales
FROM g JOIN ce ON ce.cluster_id = g.cluster_id JOIN pk ON pk.cluster_id = g.cluster_id GROUP BY 1""")
def tile_cluster_events(spark, folder):
    t = significant_tiles(spark, folder)
    lab = label_rows(t, cl.tile_edges(t, time_tolerance=0.5), "tile_id", output="cluster_id")
    e = ev.tile_cluster_events(lab)
    six = ("gpsStart", "gpsCentroid", "tSpread", "gpsPeak", "duration", "EnWDF", "snrPeak")
    return e.select("cluster_id", *[R6(c).alias(c) for c in six], "freqMin", F.round("freqMean", 5).alias("freqMean"), "freqMax", "n_pixels", "n_scales")


# --- density and order dependent clustering ----------------------------------


@query("dbscan_core_flags", with_views(TRIG) + """,
p AS (SELECT id, ifo, gps / 300.0 AS x, "freqMean" / 20.0 AS y FROM trig),
n AS (SELECT a.id, count(*) AS n FROM p a JOIN p b ON a.ifo = b.ifo AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1.0 GROUP BY 1)
SELECT id, n >= 3 AS is_core FROM n""")
def dbscan_core_flags(spark, folder):
    return dbscan(spark, folder).select("id", "is_core")


def dbscan(spark, folder):
    t = triggers(spark, folder).select("id", "ifo", "gps", "freqMean")
    return cl.dbscan(t, [F.col("gps") / 300.0, F.col("freqMean") / 20.0], "id", min_samples=3)


@query("dbscan_labels", RWITH + TRIG + """,
p AS (SELECT id, ifo, gps / 300.0 AS x, "freqMean" / 20.0 AS y FROM trig),
nb AS (SELECT a.id AS s, b.id AS d FROM p a JOIN p b ON a.ifo = b.ifo AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1.0),
core AS (SELECT s AS id FROM nb GROUP BY 1 HAVING count(*) >= 3)""" + recursive_labels(
    "SELECT id FROM core", "SELECT s, d FROM nb WHERE s <> d AND s IN (SELECT id FROM core) AND d IN (SELECT id FROM core)") + """
SELECT p.id, coalesce(c.comp, (SELECT min(cc.comp) FROM nb JOIN cc ON cc.id = nb.d WHERE nb.s = p.id), -1) AS cluster_id
FROM p LEFT JOIN cc c ON c.id = p.id""")
def dbscan_labels(spark, folder):
    return dbscan(spark, folder).select("id", "cluster_id")


@query("dbscan_with_loudness", RWITH + TRIG + """,
p AS (SELECT id, ifo, gps / 300.0 AS x, "freqMean" / 20.0 AS y, 2.0::DOUBLE * log10(greatest("EnWDF", 1e-12)) AS z FROM trig),
nb AS (SELECT a.id AS s, b.id AS d FROM p a JOIN p b ON a.ifo = b.ifo AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 1.0),
core AS (SELECT s AS id FROM nb GROUP BY 1 HAVING count(*) >= 3)""" + recursive_labels(
    "SELECT id FROM core", "SELECT s, d FROM nb WHERE s <> d AND s IN (SELECT id FROM core) AND d IN (SELECT id FROM core)") + """
SELECT p.id, coalesce(c.comp, (SELECT min(cc.comp) FROM nb JOIN cc ON cc.id = nb.d WHERE nb.s = p.id), -1) AS cluster_id
FROM p LEFT JOIN cc c ON c.id = p.id""")
def dbscan_with_loudness(spark, folder):
    c = cl.cluster_triggers(triggers(spark, folder), "dbscan", 300.0, 20.0, min_samples=3, stat_weight=2.0)
    return c.select("id", "cluster_id")


@query("greedy_labels")
def greedy_labels(spark, folder):
    t = triggers(spark, folder).select("id", "ifo", "gps", "freqMean")
    return cl.greedy(t, "gps", "freqMean", "id", 600.0, 20.0)


# --- cluster coefficients ----------------------------------------------------

BY_LABEL = """
ext AS (SELECT label, count(*)::BIGINT AS n, min(gps) AS s, max(gps + n_coeff / fs) AS e FROM win GROUP BY 1)"""


def members(spark, folder):
    """Windows grouped by their label, as the clusters of the coefficient operators."""
    return sparse_windows(spark, folder).withColumn("cluster_id", F.col("label"))


@query("cluster_extent", with_views(WIN, BY_LABEL) + """
SELECT label AS cluster_id, n AS n_triggers, 64::BIGINT AS n_coeff, round(s, 6) AS gps_start, round(e, 6) AS gps_end, 0.125::DOUBLE AS noise_scale, round(e - s, 6) AS duration FROM ext""")
def cluster_extent(spark, folder):
    e = ev.cluster_extent(members(spark, folder))
    return e.select("cluster_id", "n_triggers", "n_coeff", R6("gps_start").alias("gps_start"), R6("gps_end").alias("gps_end"),
                    "noise_scale", R6("duration").alias("duration"))


@query("cluster_map", with_views(WIN, tile_sql(), BY_LABEL) + """
SELECT tile.label AS cluster_id, (level + 1)::INT AS row, least(greatest(floor(((t_lo + t_hi) * 0.5::DOUBLE - s) / (e - s) * 16), 0), 15)::INT AS col, round(max(abs(c) / 0.125), 6) AS value
FROM tile JOIN ext ON ext.label = tile.label GROUP BY 1, 2, 3""")
def cluster_map(spark, folder):
    m = members(spark, folder)
    c = ev.cluster_map(m, tl.explode_tiles(m, ["trigger_id", "ifo", "cluster_id"]), 16)
    return c.select("cluster_id", "row", "col", R6("value").alias("value"))


@query("scored_by_reconstruction", with_views(WIN) + """,
tp AS (SELECT i, CASE WHEN i < 16 THEN 0.5 * (1 - cos(pi() * (i + 1) / 17.0)) WHEN i >= 48 THEN 0.5 * (1 - cos(pi() * (64 - i) / 17.0)) ELSE 1.0 END AS w FROM (SELECT unnest(generate_series(0, 63)) AS i)),
st AS (SELECT label, round(gps * 2048)::BIGINT + i AS n, sum(dense[i + 1] * w) / sum(w) AS v FROM win, tp WHERE label < 5 GROUP BY 1, 2),
rec AS (SELECT label, sqrt(sum(v * v)) / 0.125 AS e FROM st GROUP BY 1),
own AS (SELECT label, max(sqrt(list_sum(list_transform(dense, lambda x: x * x))) / 0.125) AS w, count(*)::BIGINT AS n FROM win GROUP BY 1)
SELECT own.label AS cluster_id, round(coalesce(e, w), 6) AS "EnWDF", round(w, 6) AS "EnWDF_window", CASE WHEN e IS NOT NULL THEN n END AS n_windows FROM own LEFT JOIN rec USING (label)""")
def scored_by_reconstruction(spark, folder):
    """Half the clusters have a reconstruction; the rest fall back to their loudest window."""
    w = windows(spark, folder).withColumnsRenamed({"dense": "samples", "label": "cluster_id"})
    w = w.withColumn("EnWDF", F.sqrt(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v * v)) / F.col("sigma"))
    stitched = combined_statistic(w.where("cluster_id < 5"), ["cluster_id"], 2048.0, 64, 16)
    events = w.groupBy("cluster_id").agg(F.max("EnWDF").alias("EnWDF"))
    s = ev.score_by_reconstruction(events, stitched)
    return s.select("cluster_id", R6("EnWDF").alias("EnWDF"), R6("EnWDF_window").alias("EnWDF_window"), "n_windows")


@query("loudest_tiles", with_views(WIN, tile_sql()) + """,
cut AS (SELECT trigger_id, quantile_cont(abs(c), 0.9::DOUBLE) AS q FROM tile GROUP BY 1)
SELECT tile.trigger_id, k, round(abs(c), 6) AS size FROM tile JOIN cut ON cut.trigger_id = tile.trigger_id WHERE abs(c) >= q""")
def loudest_tiles(spark, folder):
    """The tenth of each trigger's surviving tiles that are largest, as drawn in a report."""
    t = numbered_tiles(spark, folder).withColumn("size", F.abs("c"))
    cut = exact_quantiles(t, ["trigger_id"], "size", [0.9], "_cut").drop("q")
    return t.join(cut, "trigger_id").where(F.col("size") >= F.col("_cut")).select("trigger_id", "k", R6("size").alias("size"))
