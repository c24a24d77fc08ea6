"""Catalogue: calibration, injections, efficiency, modes, ROC and submissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberscan.operators import coincidence as co
from emberscan.operators import evaluate as ee
from emberscan.operators import rank as rk
from emberscan.operators import tiles as tl
from emberscan.operators.rangejoin import cross_pairs
from emberscan.operators.scale import scale_maximum
from emberscan.plans.registry import query
from emberscan.plans.queries_coincidence import IFOS
from emberscan.plans.queries_events import numbered_tiles
from emberscan.plans.views import INJ, SCORES, TRIG, WIN, injections, labelled_scores, tile_sql, triggers, windows, with_views
from emberscan.session import cut_lineage
from emberscan.sources import submission as sub

R6 = lambda c: F.round(c, 6)

# Background and foreground of the calibration: two detectors, sized by their group number.
EV = """
fgc AS (SELECT id, "EnWDF", k // 8 + 1 AS size FROM trig WHERE ifo = 'click'),
bgc AS (SELECT id, "EnWDF", k // 8 + 1 AS size FROM trig WHERE ifo = 'view')"""


def calibration_tables(spark, folder):
    t = triggers(spark, folder).select("id", "ifo", "EnWDF", (F.floor(F.col("k") / 8) + 1).alias("size"))
    return t.where("ifo = 'click'").drop("ifo"), t.where("ifo = 'view'").drop("ifo")


BINS = """
cnt AS (SELECT size AS s, count(*) AS n, row_number() OVER (ORDER BY size) AS i FROM bgc GROUP BY size),
fold(i, s, run, edge, opened) AS (
  SELECT 0::BIGINT, min(s), 0::BIGINT, min(s), TRUE FROM cnt
  UNION ALL
  SELECT c.i, c.s, CASE WHEN f.run + c.n >= 200 AND c.s <> (SELECT max(s) FROM cnt) THEN 0 ELSE f.run + c.n END,
         c.s + 1, f.run + c.n >= 200 AND c.s <> (SELECT max(s) FROM cnt) FROM fold f JOIN cnt c ON c.i = f.i + 1),
alle AS (SELECT edge, row_number() OVER (ORDER BY edge) AS nth FROM fold WHERE opened),
fin AS (SELECT run AS left_over FROM fold ORDER BY i DESC LIMIT 1),
edges AS (SELECT edge, nth - 1 AS bin FROM alle, fin WHERE NOT (nth = (SELECT count(*) FROM alle) AND nth > 1 AND left_over < 200))"""


@query("size_bins", "WITH RECURSIVE " + ",\n".join([TRIG, EV, BINS]) + """
SELECT bin::INT AS bin, edge::BIGINT AS edge_lo, lead(edge) OVER (ORDER BY edge)::BIGINT AS edge_hi FROM edges""")
def size_bins(spark, folder):
    return rk.size_bins(calibration_tables(spark, folder)[1], "size", 200)


@query("event_significance", "WITH RECURSIVE " + ",\n".join([TRIG, EV, BINS]) + """,
fb AS (SELECT fgc.*, greatest((SELECT max(bin) FROM edges WHERE edge <= size), 0) AS bin FROM fgc),
bb AS (SELECT bgc.*, greatest((SELECT max(bin) FROM edges WHERE edge <= size), 0) AS bin FROM bgc),
sz AS (SELECT bin, count(*) AS n, max("EnWDF") AS top, least(greatest(ceil(0.1 * count(*)), 10), count(*)) AS kk FROM bb GROUP BY 1),
rk AS (SELECT bb.bin, "EnWDF", row_number() OVER (PARTITION BY bb.bin ORDER BY "EnWDF" DESC) AS r, kk FROM bb JOIN sz USING (bin)),
tl AS (SELECT bin, min("EnWDF") AS anchor, avg("EnWDF") - min("EnWDF") AS scale FROM rk WHERE r <= kk GROUP BY 1),
ab AS (SELECT fb.*, (SELECT count(*) FROM bb WHERE bb.bin = fb.bin AND bb."EnWDF" >= fb."EnWDF") AS above FROM fb)
SELECT id, bin::INT AS bin, round(CASE WHEN "EnWDF" > top THEN -ln(2.0 / (n + 1.0)) + ("EnWDF" - top) / scale ELSE -ln((above + 1.0) / (n + 1.0)) END, 6) AS significance
FROM ab JOIN sz USING (bin) JOIN tl USING (bin)""")
def event_significance(spark, folder):
    fg, bg = calibration_tables(spark, folder)
    return rk.event_significance(fg, bg, "EnWDF", "size", "id").select("id", "bin", R6("significance").alias("significance"))


CALIB = """,
tiles AS (SELECT *, trigger_id * 64 + k AS tile_id, energy / (sigma * sigma) AS norm_energy FROM tile),
bgt AS (SELECT * FROM tiles WHERE ifo = 'L1'), fgt AS (SELECT * FROM tiles WHERE ifo = 'H1')"""


@query("scale_significance", with_views(WIN, tile_sql()) + CALIB + """,
sz AS (SELECT scale, f_lo, count(*) AS n FROM bgt GROUP BY 1, 2)
SELECT tile_id, round(-ln(((SELECT count(*) FROM bgt WHERE bgt.scale = f.scale AND bgt.f_lo = f.f_lo AND bgt.norm_energy >= f.norm_energy) + 1.0) / (n + 1.0)), 6) AS significance
FROM fgt f LEFT JOIN sz ON sz.scale = f.scale AND sz.f_lo = f.f_lo""")
def scale_significance(spark, folder):
    t = numbered_tiles(spark, folder)
    s = rk.scale_significance(t.where("ifo = 'H1'"), t.where("ifo = 'L1'"), "tile_id")
    return s.select("tile_id", R6("significance").alias("significance"))


# Two window lengths over one axis: the 64s as they are, and the vectors of odd
# number once more as half-rate windows of the same 64 coefficients.
TWO = """
two AS (SELECT trigger_id, ifo, gps, 64::BIGINT AS scale, 2048.0::DOUBLE AS rate, dense FROM win UNION ALL
        SELECT trigger_id + 10000000, ifo, gps, 128::BIGINT, 2048.0::DOUBLE, list_concat(dense, dense) FROM win WHERE trigger_id % 2 = 1),
raw AS (SELECT *, i - 1 AS k, dense[i] AS c FROM (SELECT *, unnest(generate_series(1, scale)) AS i FROM two) WHERE abs(dense[i]) >= 0.3),
px AS (SELECT trigger_id * 1024 + k AS tile_id, ifo, scale, c * c / 0.015625 AS e,
         gps + pos * (scale / pow(2.0, greatest(lev, 0)) / rate) AS t_lo, gps + (pos + 1) * (scale / pow(2.0, greatest(lev, 0)) / rate) AS t_hi,
         CASE WHEN k = 0 THEN 0.0 ELSE rate / pow(2.0, log2(scale)::INT - lev + 1) END AS f_lo
       FROM (SELECT *, CASE WHEN k = 0 THEN -1 ELSE floor(log2(k))::INT END AS lev, CASE WHEN k = 0 THEN 0 ELSE k - pow(2.0, floor(log2(k)))::BIGINT END AS pos FROM raw)),
sg AS (SELECT *, ln(1 + e) AS s FROM px)"""


def two_scales(spark, folder):
    w = windows(spark, folder)
    long_ = w.where(F.col("trigger_id") % 2 == 1).withColumn("trigger_id", F.col("trigger_id") + 10000000).withColumn(
        "n_coeff", F.lit(128).cast("long")).withColumn("dense", F.concat("dense", "dense"))
    s = tl.sparsify(w.unionByName(long_), "dense", F.lit(0.3)).drop("dense")
    t = tl.explode_tiles(s).withColumn("tile_id", F.col("trigger_id") * 1024 + F.col("k"))
    return t.withColumn("significance", F.log1p(tl.normalised_energy(F.col("energy"), F.col("sigma"))))


@query("scale_maximum", with_views(WIN, TWO) + """,
hit AS (SELECT a.tile_id, b.scale AS other, coalesce(b.s, 0) AS s, row_number() OVER (PARTITION BY a.tile_id, b.scale ORDER BY b.t_lo DESC, b.tile_id DESC) AS rn
        FROM sg a JOIN sg b ON a.ifo = b.ifo AND a.f_lo = b.f_lo AND (a.t_lo + a.t_hi) / 2 >= b.t_lo AND (a.t_lo + a.t_hi) / 2 < b.t_hi)
SELECT tile_id, round(max(s), 6) AS s_max, count(*)::BIGINT AS n_scales, round(CASE WHEN max(s) > 0 THEN min(s) / max(s) ELSE 0 END, 6) AS s_ratio FROM hit WHERE rn = 1 GROUP BY 1""")
def scale_maximum_query(spark, folder):
    m = scale_maximum(two_scales(spark, folder), "tile_id", ["ifo"])
    return m.select("tile_id", R6("s_max").alias("s_max"), "n_scales", R6("s_ratio").alias("s_ratio"))


CAND = """
cand AS (SELECT * FROM trig WHERE ifo = 'purchase')"""


def candidates(spark, folder):
    return triggers(spark, folder).where(F.col("ifo") == "purchase")


MATCH = """
hitm AS (SELECT i.injection_id, c.id, c."EnWDF" AS e, c.gps - i.inj_gps AS dt, row_number() OVER (PARTITION BY i.injection_id ORDER BY c."EnWDF" DESC, c."gpsStart", c.id) AS rn
        FROM inj i JOIN cand c ON i.inj_gps >= c."gpsStart" - 120.0 AND i.inj_gps <= c."gpsEnd" + 120.0),
matched AS (SELECT i.*, h.id IS NOT NULL AS found, coalesce(h.id, -1) AS candidate_index, h.dt AS dt_s, h.e AS recovered_snr
            FROM inj i LEFT JOIN (SELECT * FROM hitm WHERE rn = 1) h USING (injection_id))"""


def matched(spark, folder):
    return ee.match_injections(candidates(spark, folder), injections(spark, folder), 120.0)


@query("match_injections", with_views(TRIG, INJ, CAND, MATCH) + """
SELECT injection_id, found, candidate_index::BIGINT AS candidate_index, round(dt_s, 6) AS dt_s, recovered_snr FROM matched""")
def match_injections(spark, folder):
    return matched(spark, folder).select("injection_id", "found", "candidate_index", R6("dt_s").alias("dt_s"), "recovered_snr")


@query("false_alarms", with_views(TRIG, INJ, CAND) + """
SELECT id, "EnWDF" FROM cand c WHERE NOT EXISTS (SELECT 1 FROM inj i WHERE i.inj_gps >= c."gpsStart" - 120.0 AND i.inj_gps <= c."gpsEnd" + 120.0)""")
def false_alarms(spark, folder):
    return ee.false_alarms(candidates(spark, folder), injections(spark, folder), 120.0).select("id", "EnWDF")


@query("unclaimed_topk", with_views(TRIG, INJ, CAND) + """
SELECT id, "EnWDF" FROM cand c WHERE NOT EXISTS (SELECT 1 FROM inj i WHERE i.inj_gps >= c."gpsStart" - 120.0 AND i.inj_gps <= c."gpsEnd" + 120.0)
ORDER BY "EnWDF" DESC, id LIMIT 25""")
def unclaimed_topk(spark, folder):
    return ee.unclaimed(candidates(spark, folder), injections(spark, folder), 120.0, statistic="EnWDF", limit=25).select("id", "EnWDF")


EDGE_LIST = [60.0 + 20.0 * i for i in range(11)]


@query("efficiency_bins", with_views(TRIG, INJ, CAND, MATCH) + """,
b AS (SELECT 60.0 + 20.0 * i AS lo, 80.0 + 20.0 * i AS hi FROM (SELECT unnest(generate_series(0, 9)) AS i)),
g AS (SELECT DISTINCT user_id % 2 AS grp FROM matched)
SELECT grp::BIGINT AS grp, lo::DOUBLE AS snr_low, hi::DOUBLE AS snr_high, ((lo + hi) / 2)::DOUBLE AS snr_mid, count(m.injection_id)::BIGINT AS n,
       coalesce(sum(found::INT), 0)::BIGINT AS n_found, round(avg(found::INT), 6) AS efficiency
FROM g CROSS JOIN b LEFT JOIN matched m ON m.network_snr >= lo AND m.network_snr < hi AND m.user_id % 2 = grp GROUP BY grp, lo, hi""")
def efficiency_bins(spark, folder):
    m = matched(spark, folder).withColumn("grp", F.col("user_id") % 2)
    return ee.efficiency(m, EDGE_LIST, group="grp").withColumn("efficiency", R6("efficiency"))


POP = """
bgp AS (SELECT score FROM scores WHERE NOT positive), fgp AS (SELECT score FROM scores WHERE positive)"""


def populations(spark, folder):
    s = labelled_scores(spark, folder)
    return s.where("positive"), s.where("NOT positive")


@query("threshold_at_far", with_views(SCORES, POP) + """,
t AS (SELECT unnest([0.05, 0.5, 1.0, 10.0]::DOUBLE[]) AS far_per_day), n AS (SELECT count(*) AS n FROM bgp),
r AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS k FROM bgp)
SELECT far_per_day, CASE WHEN far_per_day * 10.0 >= n THEN 'all' WHEN far_per_day * 10.0 < 1.0 THEN 'none' ELSE 'kth' END AS kind, r.score AS threshold
FROM t CROSS JOIN n LEFT JOIN r ON r.k = floor(far_per_day * 10.0) AND far_per_day * 10.0 >= 1.0 AND far_per_day * 10.0 < n""")
def threshold_at_far(spark, folder):
    bg = populations(spark, folder)[1]
    t = rk.threshold_at_far(bg, "score", 10.0, (0.05, 0.5, 1.0, 10.0))
    all_ = F.col("threshold") == float("-inf")
    kind = F.when(~F.col("measurable"), "none").when(all_, "all").otherwise("kth")
    return t.select("far_per_day", kind.alias("kind"), F.when(~all_, F.col("threshold")).alias("threshold"))


@query("efficiency_at_far", with_views(SCORES, POP) + """,
r AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS k FROM bgp),
c AS (SELECT CASE WHEN n <= 20 THEN '-infinity'::DOUBLE ELSE (SELECT score FROM r WHERE k = 20) END AS cut FROM (SELECT count(*) AS n FROM bgp))
SELECT 2.0::DOUBLE AS far_per_day, cut AS threshold, TRUE AS measurable, count(*)::BIGINT AS n_found, round(count(*) / 500.0::DOUBLE, 6) AS efficiency
FROM fgp, c WHERE score >= cut GROUP BY cut""")
def efficiency_at_far(spark, folder):
    fg, bg = populations(spark, folder)
    return ee.efficiency_at_far(fg, bg, "score", 500, 10.0, 2.0).withColumn("efficiency", R6("efficiency"))


STATS = """
st AS (SELECT positive, 'score' AS statistic, score FROM scores UNION ALL SELECT positive, 'inverse', 1e6::DOUBLE / (1.0 + score) FROM scores),
t AS (SELECT unnest([0.5, 1.0, 3.0]::DOUBLE[]) AS far_per_day),
r AS (SELECT statistic, score, row_number() OVER (PARTITION BY statistic ORDER BY score DESC) AS k FROM st WHERE NOT positive),
size AS (SELECT statistic, count(*) AS n FROM r GROUP BY 1),
cut AS (SELECT s.statistic, far_per_day, CASE WHEN far_per_day * 10.0 >= n THEN '-infinity'::DOUBLE ELSE r.score END AS threshold
        FROM t CROSS JOIN size s LEFT JOIN r ON r.statistic = s.statistic AND r.k = floor(far_per_day * 10.0))"""


@query("compare_statistics", with_views(SCORES, STATS) + """
SELECT c.statistic, far_per_day, round(threshold, 6) AS threshold, TRUE AS measurable, count(f.score)::BIGINT AS n_found, round(count(f.score) / 400.0::DOUBLE, 6) AS efficiency
FROM cut c LEFT JOIN st f ON f.positive AND f.statistic = c.statistic AND f.score >= threshold GROUP BY 1, 2, 3""")
def compare_statistics(spark, folder):
    fg, bg = (p.withColumn("inverse", F.lit(1e6) / (F.lit(1.0) + F.col("score"))) for p in populations(spark, folder))
    c = ee.compare_statistics(fg, bg, ["score", "inverse"], 400, 10.0, (0.5, 1.0, 3.0))
    return c.withColumn("efficiency", R6("efficiency")).withColumn("threshold", R6("threshold"))


def mode(spark, folder, name="length"):
    fg, bg = populations(spark, folder)
    return ee.DetectionMode(name, fg, bg, "score", 400, 10.0)


@query("compare_modes", with_views(SCORES, """
mo AS (SELECT 'all' AS mode, positive, score FROM scores UNION ALL SELECT 'clean', positive, score FROM scores WHERE toxic = 0),
t AS (SELECT unnest([0.5, 1.0]::DOUBLE[]) AS far_per_day),
r AS (SELECT mode, score, row_number() OVER (PARTITION BY mode ORDER BY score DESC) AS k FROM mo WHERE NOT positive),
size AS (SELECT mode, count(*) AS n FROM r GROUP BY 1),
cut AS (SELECT s.mode, far_per_day, CASE WHEN far_per_day * 10.0 >= n THEN '-infinity'::DOUBLE ELSE r.score END AS threshold
        FROM t CROSS JOIN size s LEFT JOIN r ON r.mode = s.mode AND r.k = floor(far_per_day * 10.0))""") + """
SELECT c.mode, far_per_day, threshold, TRUE AS measurable, count(f.score)::BIGINT AS n_found, round(count(f.score) / 400.0::DOUBLE, 6) AS efficiency
FROM cut c LEFT JOIN mo f ON f.positive AND f.mode = c.mode AND f.score >= threshold GROUP BY 1, 2, 3""")
def compare_modes(spark, folder):
    fg, bg = populations(spark, folder)
    modes = [ee.DetectionMode("all", fg, bg, "score", 400, 10.0),
             ee.DetectionMode("clean", fg.where("toxic = 0"), bg.where("toxic = 0"), "score", 400, 10.0)]
    return ee.compare_modes(modes, (0.5, 1.0)).withColumn("efficiency", R6("efficiency"))


@query("mode_roc", with_views(SCORES, POP) + """,
n AS (SELECT count(*) AS n FROM bgp), g AS (SELECT DISTINCT least(floor(exp(ln(n::DOUBLE) * i / 59) + 1e-9::DOUBLE), n)::BIGINT AS rank FROM n, (SELECT unnest(generate_series(0, 59)) AS i)),
r AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS k FROM bgp)
SELECT round(rank / 10.0::DOUBLE, 6) AS far_per_day, score AS threshold, round((SELECT count(*) FROM fgp WHERE fgp.score >= r.score) / 400.0::DOUBLE, 6) AS efficiency FROM g JOIN r ON r.k = g.rank""")
def mode_roc(spark, folder):
    m = ee.mode_roc(mode(spark, folder))
    return m.select(R6("far_per_day").alias("far_per_day"), "threshold", R6("efficiency").alias("efficiency"))


ROC = """
e AS (SELECT min(score) AS lo, max(score) AS hi FROM scores),
g AS (SELECT j, CASE WHEN j = 199 THEN hi ELSE lo + j * ((hi - lo) / 199) END AS threshold FROM e, (SELECT unnest(generate_series(0, 199)) AS j)),
c AS (SELECT j, threshold, avg((score >= threshold)::INT) FILTER (WHERE positive) AS tpr, avg((score >= threshold)::INT) FILTER (WHERE NOT positive) AS fpr
      FROM g, scores GROUP BY 1, 2)"""


@query("roc_curve", with_views(SCORES, ROC) + """
SELECT j::INT AS j, round(threshold, 6) AS threshold, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr FROM c""")
def roc_curve(spark, folder):
    fg, bg = populations(spark, folder)
    return ee.roc_curve(fg, bg, "score").select("j", R6("threshold").alias("threshold"), F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


@query("roc_auc", with_views(SCORES, ROC) + """,
s AS (SELECT (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS a FROM c WINDOW w AS (ORDER BY j DESC))
SELECT round(sum(a), 9) AS auc FROM s""")
def roc_auc(spark, folder):
    fg, bg = populations(spark, folder)
    return ee.roc_auc(ee.roc_curve(fg, bg, "score")).select(F.round("auc", 9).alias("auc"))


@query("edge_labels", with_views(TRIG, INJ) + """,
ev AS (SELECT * FROM trig),
nx AS (SELECT ev.id, "gpsStart" AS s, "gpsEnd" AS e, (SELECT min(inj_gps) FROM inj WHERE inj_gps >= "gpsStart") AS a, (SELECT max(inj_gps) FROM inj WHERE inj_gps < "gpsStart") AS b FROM ev),
ow AS (SELECT id, coalesce(CASE WHEN a >= s - 300.0 AND a <= e + 300.0 THEN a END, CASE WHEN b >= s - 300.0 AND b <= e + 300.0 THEN b END) AS o FROM nx),
pr AS (SELECT x.id AS src, y.id AS dst FROM trig x JOIN trig y ON x.ifo < y.ifo AND y.gps >= x.gps - 300.0 AND y.gps <= x.gps + 300.0)
SELECT src, dst, coalesce(p.o = q.o, FALSE)::INT AS label FROM pr JOIN ow p ON p.id = src JOIN ow q ON q.id = dst""")
def edge_labels(spark, folder):
    return labelled_pairs(triggers(spark, folder), injections(spark, folder), 300.0).select("src", "dst", "label")


def labelled_pairs(t, truth, window_s):
    """Pairs of any two detectors' events, labelled. Owners travel with the events into the join, and no pair is shuffled."""
    owners = cut_lineage(ee.covered_injection(t, truth, window_s).select("ifo", "id", "gps", "owner"))
    ends = [F.col("id_l").alias("src"), F.col("id_r").alias("dst")]
    if not owners.where("id IS NOT NULL").groupBy("id").count().where("count > 1").isEmpty():
        # An id of several events has several owners, and an edge of it a row for each.
        sides = co.by_detector_pair(owners.drop("owner"), IFOS)
        return ee.edge_labels(cross_pairs(*sides, "gps", "gps", window_s, ["pair"]).select(*ends), owners)
    known = owners.withColumn("owner", F.when(F.col("id").isNotNull(), F.col("owner")))
    pairs = cross_pairs(*co.by_detector_pair(known, IFOS), "gps", "gps", window_s, ["pair"])
    return ee.edge_labels(pairs.select(*ends, F.col("owner_l").alias("src_owner"), F.col("owner_r").alias("dst_owner")))


@query("submission_rows", with_views(TRIG) + """,
bg AS (SELECT "EnWDF" AS s FROM trig WHERE ifo = 'view'), c AS (SELECT * FROM trig WHERE ifo = 'click'),
r AS (SELECT c.*, greatest((SELECT count(*) FROM bg WHERE bg.s >= c."EnWDF"), 1) / 2592000.0 AS far_hz FROM c)
SELECT round("gpsStart", 6) AS gps_start, round("gpsEnd", 6) AS gps_end, round(far_hz, 12) AS far_hz, round(gps, 6) AS gps_peak, round("freqMin", 6) AS frequency_start,
       round("freqMax", 6) AS frequency_end, round("freqMean", 6) AS frequency_peak, -999.0::DOUBLE AS right_ascension, -999.0::DOUBLE AS declination
FROM r WHERE far_hz <= 5e-5""")
def submission_rows(spark, folder):
    t = triggers(spark, folder)
    rows = sub.submission_triggers(
        t.where("ifo = 'click'"), t.where("ifo = 'view'"), 2592000.0, "EnWDF", 5e-5, "id",
        {"gps_start": "gpsStart", "gps_end": "gpsEnd", "gps_peak": "gpsPeak", "frequency_start": "freqMin",
         "frequency_end": "freqMax", "frequency_peak": "freqMean"})
    return rows.select(*[F.round(c, 12 if c == "far_hz" else 6).alias(c) for c in rows.columns])
