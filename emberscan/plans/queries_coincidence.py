"""Catalogue: range joins, coincidence between detectors, slides and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberscan.functions import arrays as ar
from emberscan.functions.geometry import travel_times
from emberscan.operators import coincidence as co
from emberscan.operators import netslides as ns
from emberscan.operators import rangejoin as rj
from emberscan.operators import rank as rk
from emberscan.operators import slides as sl
from emberscan.plans import flagship
from emberscan.plans.registry import query
from emberscan.plans.views import SPAN_S, TRIG, WIN, table, triggers, windows, with_views
from emberscan.session import cut_lineage

R6 = lambda c: F.round(c, 6)


# All detectors of the table; cross-detector queries join within every pair of them.
IFOS = ("click", "error", "purchase", "signup", "view")


def detector_pairs(spark, folder, *columns):
    return co.by_detector_pair(triggers(spark, folder).select("ifo", *columns), IFOS)


def detector(spark, folder, ifo):
    return triggers(spark, folder).where(F.col("ifo") == ifo)


@query("neighbour_pairs", with_views(TRIG) + """
SELECT a.ifo, a.id AS id_l, b.id AS id_r, round(b.gps - a.gps, 6) AS dt FROM trig a JOIN trig b
ON a.ifo = b.ifo AND b.gps >= a.gps AND b.gps <= a.gps + 120.0 AND (a.gps < b.gps OR a.id < b.id)""")
def neighbour_pairs(spark, folder):
    t = triggers(spark, folder).select("id", "ifo", "gps")
    return rj.neighbour_pairs(t, "gps", "id", 120.0, ["ifo"]).select(
        "ifo", "id_l", "id_r", R6(F.col("gps_r") - F.col("gps_l")).alias("dt"))


@query("cross_pairs", with_views(TRIG) + """
SELECT a.id AS id_l, b.id AS id_r FROM trig a JOIN trig b ON a.ifo < b.ifo
AND b.gps >= a.gps - 90.0 AND b.gps <= a.gps + 90.0""")
def cross_pairs(spark, folder):
    a, b = detector_pairs(spark, folder, "id", "gps")
    return rj.cross_pairs(a, b, "gps", "gps", 90.0, ["pair"]).select("id_l", "id_r")


@query("interval_pairs", with_views(TRIG) + """
SELECT a.id AS id_l, b.id AS id_r FROM trig a JOIN trig b ON a.ifo < b.ifo
AND b."gpsStart" BETWEEN a."gpsStart" - 20.0 AND a."gpsEnd" """)
def interval_pairs(spark, folder):
    a, b = detector_pairs(spark, folder, "id", "gpsStart", "gpsEnd")
    return rj.interval_pairs(a, b.drop("gpsEnd"), ("gpsStart", "gpsEnd"), "gpsStart", 20.0, ["pair"]).select("id_l", "id_r")


@query("overlapping_extents", with_views(TRIG) + """
SELECT a.id AS id_l, b.id AS id_r FROM trig a JOIN trig b ON a.ifo < b.ifo
AND a."gpsStart" <= b."gpsEnd" AND b."gpsStart" <= a."gpsEnd" """)
def overlapping_extents(spark, folder):
    a, b = detector_pairs(spark, folder, "id", "gpsStart", "gpsEnd")
    span = ("gpsStart", "gpsEnd")
    return rj.overlap_join(a, b, span, span, ["pair"]).select("id_l", "id_r")


@query("points_inside_extents", with_views(TRIG) + """
SELECT a.id, count(b.id)::BIGINT AS n_inside FROM (SELECT * FROM trig WHERE ifo = 'click') a
LEFT JOIN (SELECT * FROM trig WHERE ifo <> 'click') b ON b.gps BETWEEN a."gpsStart" AND a."gpsEnd" GROUP BY 1""")
def points_inside_extents(spark, folder):
    t = triggers(spark, folder)
    spans = t.where("ifo = 'click'").select("id", "gpsStart", "gpsEnd")
    return rj.count_inside(spans, t.where("ifo <> 'click'"), ("gpsStart", "gpsEnd"), "gps", "id")


@query("paired_dot", with_views(WIN) + """
SELECT a.trigger_id AS id_l, b.trigger_id AS id_r, round(list_dot_product(a.dense, b.dense), 6) AS dot
FROM win a JOIN win b ON a.ifo = b.ifo AND b.gps > a.gps AND b.gps <= a.gps + 0.1""")
def paired_dot(spark, folder):
    w = windows(spark, folder).select("trigger_id", "ifo", "gps", "dense")
    pairs = rj.neighbour_pairs(w, "gps", "trigger_id", 0.1, ["ifo"])
    return pairs.select(F.col("trigger_id_l").alias("id_l"), F.col("trigger_id_r").alias("id_r"),
                        R6(ar.dot(F.col("dense_l"), F.col("dense_r"))).alias("dot"))


NEAREST = """
near AS (SELECT a.ifo || ',' || b.ifo AS pair, a.id AS id_a, b.id AS id_b, a.gps AS ga, b.gps AS gb, a."EnWDF" AS ea, b."EnWDF" AS eb,
                count(*) OVER (PARTITION BY a.id, b.ifo)::BIGINT AS n,
                row_number() OVER (PARTITION BY a.id, b.ifo ORDER BY abs(a.gps - b.gps), b.gps, b.id) AS rn
         FROM trig a JOIN trig b ON a.ifo < b.ifo AND b.gps >= a.gps - {w} AND b.gps <= a.gps + {w})"""


@query("nearest_coincidence", with_views(TRIG, NEAREST.format(w="300.0")) + """
SELECT pair, id_a, id_b, round(ga - gb, 6) AS dt_s, round((ga * ea + gb * eb) / (ea + eb), 5) AS gps_candidate,
       round(sqrt(ea * ea + eb * eb), 6) AS network_enwdf, n AS n_candidate_matches FROM near WHERE rn = 1""")
def nearest_coincidence(spark, folder):
    c = co.nearest_coincidence(*co.by_detector_pair(triggers(spark, folder), IFOS), 300.0, ["pair"])
    return c.select("pair", "id_a", "id_b", R6("dt_s").alias("dt_s"), F.round("gps_candidate", 5).alias("gps_candidate"),
                    R6("network_enwdf").alias("network_enwdf"), "n_candidate_matches")


@query("travel_time_matrix", """
WITH s AS (SELECT * FROM (VALUES ('H1', -2161414.93::DOUBLE, -3834695.36::DOUBLE, 4600350.22::DOUBLE), ('L1', -74276.05, -5496283.72, 3224257.02),
  ('V1', 4546374.10, 842989.70, 4378576.96), ('K1', -3777336.02, 3484898.41, 3765313.68), ('G1', 3856309.94, 666598.96, 5019641.42)) v(ifo, x, y, z)),
d AS (SELECT DISTINCT CASE label % 5 WHEN 0 THEN 'H1' WHEN 1 THEN 'L1' WHEN 2 THEN 'V1' WHEN 3 THEN 'K1' ELSE 'G1' END AS ifo FROM embeddings)
SELECT a.ifo AS ifo_a, b.ifo AS ifo_b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) / 299792458.0, 9) AS travel_s
FROM s a JOIN s b ON a.ifo < b.ifo WHERE a.ifo IN (FROM d) AND b.ifo IN (FROM d)""")
def travel_time_matrix(spark, folder):
    names = F.element_at(F.array(*[F.lit(n) for n in ("H1", "L1", "V1", "K1", "G1")]), F.col("label") % 5 + 1)
    used = table(spark, folder, "embeddings").select(names.alias("ifo")).distinct()
    t = travel_times(spark)
    for side in ("ifo_a", "ifo_b"):
        t = t.join(used.withColumnRenamed("ifo", side), on=side, how="left_semi")
    return t.select("ifo_a", "ifo_b", F.round("travel_s", 9).alias("travel_s"))


CONFIG = co.CoincidenceConfig(light_travel_time_s=4.0, timing_jitter_s=0.5, timing_sigma=3.0)

EDGES = """
tol AS (SELECT a.ifo || ',' || b.ifo AS pair, a.id AS id_l, b.id AS id_r, a.gps AS ga, b.gps AS gb, a."EnWDF" AS ea, b."EnWDF" AS eb,
               a."gpsStart" AS a0, a."gpsStart" + a.duration AS a1, b."gpsStart" AS b0, b."gpsStart" + b.duration AS b1,
               a."freqMin" AS af0, a."freqMax" AS af1, b."freqMin" AS bf0, b."freqMax" AS bf1, a."freqMean" AS af, b."freqMean" AS bf,
               least(4.0 + 3.0 * sqrt(pow(greatest(a."tSpread", 0.5), 2) + pow(greatest(b."tSpread", 0.5), 2)), 10.0) AS tol
        FROM trig a JOIN trig b ON a.ifo < b.ifo
          AND a."gpsStart" - 10.0 <= b."gpsEnd" AND b."gpsStart" <= a."gpsEnd" + 10.0),
edge AS (SELECT *, ga - gb AS dt,
                greatest(0.0, least(af1, bf1) - greatest(af0, bf0)) / greatest(least(af1 - af0, bf1 - bf0), 1e-12) AS fo,
                greatest(0.0, least(1.0, least(least(a1, b1 + 4.0) - greatest(a0, b0 - 4.0), greatest(least(a1 - a0, b1 - b0), 1e-12))
                         / greatest(least(a1 - a0, b1 - b0), 1e-12))) AS tov,
                abs(ga - gb) / greatest(tol, 1e-12) + abs(af - bf) / greatest(af1 - af0, bf1 - bf0, 1.0) AS cost
         FROM tol WHERE least(a1, b1 + tol) >= greatest(a0, b0 - tol))"""


@query("interval_candidates", with_views(TRIG, EDGES) + """
SELECT pair, id_l, id_r, round(dt, 6) AS dt_s, round(tol, 6) AS tolerance_s, round(fo, 6) AS frequency_overlap, round(tov, 6) AS time_overlap, round(cost, 6) AS cost FROM edge""")
def interval_candidates(spark, folder):
    e = co.candidate_edges(*co.by_detector_pair(triggers(spark, folder), IFOS), CONFIG, (), ["pair"])
    six = ("dt_s", "tolerance_s", "frequency_overlap", "time_overlap", "cost")
    return e.select("pair", "id_l", "id_r", *[R6(c).alias(c) for c in six])


@query("assignment_1to1")
def assignment_1to1(spark, folder):
    return co.one_to_one_candidates(*co.by_detector_pair(triggers(spark, folder), IFOS), CONFIG, (), ["pair"])


@query("pairwise_network")
def pairwise_network(spark, folder):
    t = triggers(spark, folder)
    return co.pairwise_network(t, IFOS, CONFIG)


NETWORK = """
nodes AS (SELECT * FROM trig),
nedge AS (SELECT a.id AS s, b.id AS d FROM nodes a JOIN nodes b ON a.ifo <> b.ifo AND abs(a.gps - b.gps) <= 60.0),
cc(id, comp) USING KEY (id) AS (
  SELECT id, id AS comp FROM nodes
  UNION
  SELECT e.d, min(cc.comp) FROM cc JOIN nedge e ON e.s = cc.id JOIN recurring.cc r ON r.id = e.d WHERE cc.comp < r.comp GROUP BY e.d),
mem AS (SELECT n.*, cc.comp FROM nodes n JOIN cc ON cc.id = n.id)"""


@query("network_components", "WITH RECURSIVE " + TRIG + "," + NETWORK + """
SELECT comp AS component, round(sum(gps * "EnWDF") / sum("EnWDF"), 5) AS gps_candidate, string_agg(DISTINCT ifo, ',' ORDER BY ifo) AS ifos_involved,
       round(sqrt(sum("EnWDF" * "EnWDF")), 6) AS network_enwdf, count(DISTINCT ifo)::INT AS n_ifos, count(*)::BIGINT AS n_triggers_in_candidate,
       max("EnWDF") FILTER (WHERE ifo = 'click') AS enwdf_click, max("EnWDF") FILTER (WHERE ifo = 'error') AS enwdf_error,
       max("EnWDF") FILTER (WHERE ifo = 'purchase') AS enwdf_purchase, max("EnWDF") FILTER (WHERE ifo = 'signup') AS enwdf_signup,
       max("EnWDF") FILTER (WHERE ifo = 'view') AS enwdf_view
FROM mem GROUP BY comp HAVING count(DISTINCT ifo) >= 2""")
def network_components(spark, folder):
    t = triggers(spark, folder)
    pairs = {(a, b): 60.0 for a in IFOS for b in IFOS if a < b}
    c = co.network_candidates(t, IFOS, pairs)
    return c.select("component", F.round("gps_candidate", 5).alias("gps_candidate"), "ifos_involved",
                    R6("network_enwdf").alias("network_enwdf"), "n_ifos", "n_triggers_in_candidate",
                    *[f"enwdf_{i}" for i in IFOS])


# --- time slides and ranking -------------------------------------------------

SLIDE_LIST = ", ".join(f"({k}, {3600.0 * k + 17.0 if k else 0.0}::DOUBLE)" for k in range(21))
LEGACY = f"""
slides AS (SELECT * FROM (VALUES {SLIDE_LIST}) v(slide_index, shift)),
loud AS (SELECT * FROM trig WHERE "EnWDF" >= 1.0),
vs AS (SELECT slide_index, id, "EnWDF", gps + shift - {SPAN_S} * floor((gps + shift) / {SPAN_S}) AS gps FROM loud, slides WHERE ifo = 'view'),
near AS (SELECT v.slide_index, a.id AS id_a, v.id AS id_b, a.gps AS ga, v.gps AS gb, a."EnWDF" AS ea, v."EnWDF" AS eb,
                count(*) OVER p AS n, row_number() OVER (PARTITION BY v.slide_index, a.id ORDER BY abs(a.gps - v.gps), v.gps, v.id) AS rn
         FROM loud a JOIN vs v ON a.ifo = 'click' AND v.gps >= a.gps - {{w}} AND v.gps <= a.gps + {{w}}
         WINDOW p AS (PARTITION BY v.slide_index, a.id)),
cand AS (SELECT *, sqrt(ea * ea + eb * eb) AS net FROM near WHERE rn = 1),
bg AS (SELECT * FROM cand WHERE slide_index > 0),
ranked AS (SELECT c.*, (SELECT count(*) FROM bg WHERE bg.net >= c.net) AS n_ge, (SELECT count(*) FROM bg) AS n_bg FROM cand c WHERE slide_index = 0)"""


@query("slides_background", with_views(TRIG, LEGACY.format(w="60.0")) + """
SELECT slide_index::INT AS slide_index, id_a, id_b, round(ga - gb, 6) AS dt_s, round(net, 6) AS network_enwdf, n::BIGINT AS n_candidate_matches FROM bg""")
def slides_background(spark, folder):
    t = triggers(spark, folder).where("EnWDF >= 1.0")
    found = flagship.coincidences_with_slides(t, "click", "view", 60.0, flagship.SHIFTS, 0.0, SPAN_S)
    return found.where("slide_index > 0").select(
        "slide_index", "id_a", "id_b", R6("dt_s").alias("dt_s"), R6("network_enwdf").alias("network_enwdf"), "n_candidate_matches")


RANKED = """SELECT id_a, id_b, round((ga * ea + gb * eb) / (ea + eb), 6) AS gps_candidate, round(ga - gb, 6) AS dt_s, round(net, 6) AS network_enwdf,
       n::BIGINT AS n_candidate_matches, n_ge::BIGINT AS n_background_ge, n_bg::BIGINT AS n_background,
       round((1.0::DOUBLE + n_ge) / (1.0::DOUBLE + n_bg), 9) AS fap, round((1.0::DOUBLE + n_ge) / (1.0::DOUBLE + n_bg) / 30.0, 9) AS far_per_day
FROM ranked"""


@query("flagship_ranked_candidates", with_views(TRIG, LEGACY.format(w="60.0")) + RANKED + " ORDER BY fap, network_enwdf DESC, id_a LIMIT 50")
def flagship_ranked_candidates(spark, folder):
    return flagship.ranked_candidates(spark, folder)


@query("rank_fap", with_views(TRIG, LEGACY.format(w="60.0")) + RANKED)
def rank_fap(spark, folder):
    return flagship.ranked_candidates(spark, folder, top=None)


FIVE = [7200.0 * k + 31.0 for k in range(1, 6)]
FIVE_LIST = ", ".join(f"({k}, {s}::DOUBLE)" for k, s in enumerate(FIVE))
CANONICAL = f"""
slides AS (SELECT * FROM (VALUES {FIVE_LIST}) v(slide_index, shift)),
rep AS (SELECT slide_index, t.*, slides.shift AS slide_shift FROM trig t, slides),
mv AS (SELECT *, "gpsCentroid" + slide_shift - {SPAN_S} * floor(("gpsCentroid" + slide_shift) / {SPAN_S}) - "gpsCentroid" AS disp FROM rep),
slid AS (SELECT slide_index, ifo, id, "EnWDF", "tSpread", duration, "gpsPeak" + disp AS gps, "gpsStart" + disp AS "gpsStart" FROM mv),
edge AS (SELECT a.ifo || ',' || b.ifo AS pair, b.slide_index, a.id AS id_l, b.id AS id_r, a.gps AS ga, b.gps AS gb, a."EnWDF" AS ea, b."EnWDF" AS eb,
               a."gpsStart" AS a0, a."gpsStart" + a.duration AS a1, b."gpsStart" AS b0, b."gpsStart" + b.duration AS b1,
               least(4.0 + 3.0 * sqrt(pow(greatest(a."tSpread", 0.5), 2) + pow(greatest(b."tSpread", 0.5), 2)), 10.0) AS tol
        FROM trig a JOIN slid b ON a.ifo < b.ifo AND a."gpsStart" - 10.0 <= b."gpsStart" + b.duration AND b."gpsStart" <= a."gpsStart" + a.duration + 10.0)"""


@query("slides_canonical", with_views(TRIG, CANONICAL) + """
SELECT pair, slide_index::INT AS slide_index, id_l, id_r, round(ga - gb, 6) AS dt_s, round(least(ea, eb), 6) AS network_min_enwdf
FROM edge WHERE least(a1, b1 + tol) >= greatest(a0, b0 - tol)""")
def slides_canonical(spark, folder):
    e = canonical_background(spark, folder)
    return e.select("pair", "slide_index", "id_l", "id_r", R6("dt_s").alias("dt_s"), R6("network_min_enwdf").alias("network_min_enwdf"))


def canonical_sides(spark, folder):
    """Of every pair of detectors the first where it is, and the second moved, once per slide."""
    left, right = co.by_detector_pair(triggers(spark, folder), IFOS)
    moved = sl.slide_events(right, FIVE, 0.0, SPAN_S, "gpsCentroid", ["gpsPeak", "gpsCentroid", "gpsStart"])
    return sl.replicate(left, len(FIVE), written=False), moved.drop("slide_shift_s")


def canonical_background(spark, folder):
    """Every pair the canonical slides admit, before any assignment."""
    e = co.candidate_edges(*canonical_sides(spark, folder), CONFIG, keys=["pair", sl.SLIDE])
    return e.withColumn("network_min_enwdf", F.least("EnWDF_l", "EnWDF_r"))


@query("slides_one_to_one")
def slides_one_to_one(spark, folder):
    return co.one_to_one_candidates(*canonical_sides(spark, folder), CONFIG, keys=["pair", sl.SLIDE])


@query("rank_far", with_views(TRIG, EDGES.replace("edge AS", "zero AS"), CANONICAL) + f""",
bg AS (SELECT least(ea, eb) AS s FROM edge WHERE least(a1, b1 + tol) >= greatest(a0, b0 - tol)),
r AS (SELECT id_l, id_r, least(ea, eb) AS s, (SELECT count(*) FROM bg WHERE bg.s >= least(z.ea, z.eb)) AS n FROM zero z)
SELECT id_l, id_r, round(s, 6) AS network_min_enwdf, n::BIGINT AS n_background_ge, round((n + 1) / {5 * SPAN_S}, 12) AS far_hz,
       round((n + 1) / {5 * SPAN_S} * 86400.0, 9) AS far_per_day, round(1 - exp(-(n + 1) / {5 * SPAN_S} * {SPAN_S}), 9) AS fap FROM r""")
def rank_far(spark, folder):
    """A pair is as loud as its quieter event, so it is the loudness of events that is ranked, before any pair is formed."""
    t = triggers(spark, folder)
    bg = canonical_background(spark, folder)
    ranked = rk.rank_by_rate(t.select("EnWDF").distinct(), bg, "EnWDF", "EnWDF", 5 * SPAN_S, SPAN_S, "network_min_enwdf")
    ranked = cut_lineage(ranked.select(F.col("EnWDF").alias("_loud"), "n_background_ge"))
    t = t.join(ranked, F.col("EnWDF").eqNullSafe(F.col("_loud"))).drop("_loud")
    zero = co.candidate_edges(*co.by_detector_pair(t, IFOS), CONFIG, (), ["pair"], ["n_background_ge"])
    quieter = F.when(F.col("EnWDF_r").isNull() | (F.col("EnWDF_l") <= F.col("EnWDF_r")), F.col("n_background_ge_l")).otherwise(F.col("n_background_ge_r"))
    zero = zero.select("id_l", "id_r", F.least("EnWDF_l", "EnWDF_r").alias("network_min_enwdf"), quieter.alias("n_background_ge"))
    r = rk.with_rates(zero, 5 * SPAN_S, SPAN_S)
    return r.select("id_l", "id_r", R6("network_min_enwdf").alias("network_min_enwdf"), "n_background_ge",
                    F.round("far_hz", 12).alias("far_hz"), F.round("far_per_day", 9).alias("far_per_day"), F.round("fap", 9).alias("fap"))


#: All detectors but the first are moved, in the default number of slides; slide 0 is the zero lag.
NETWORK_SHIFTS = ns.network_shifts(IFOS, 100, SPAN_S, 3600.0)

NETWORK_EDGES = f"""
shift AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{i}', {s!r}::DOUBLE)" for k, slide in enumerate(NETWORK_SHIFTS) for i, s in slide.items())}) v(slide, ifo, s)),
placed AS (SELECT t.*, slide, gpsCentroid - 0.0 + s AS m FROM trig t JOIN shift USING (ifo)),
moved AS (SELECT *, CASE WHEN slide = 0 THEN 0.0 ELSE 0.0 + (m - {SPAN_S}::DOUBLE * floor(m / {SPAN_S}::DOUBLE)) - gpsCentroid END AS d FROM placed),
ev AS (SELECT slide, ifo, id, gpsPeak + d AS peak, gpsStart + d AS t0, gpsStart + d + duration AS t1, freqMin AS f0, freqMax AS f1, freqMean AS f, tSpread FROM moved),
a AS (SELECT *, unnest(range(floor((t0 - 10) / 128)::BIGINT, floor((t1 + 10) / 128)::BIGINT + 1)) AS cell FROM ev),
b AS (SELECT *, unnest(range(floor(t0 / 128)::BIGINT, floor(t1 / 128)::BIGINT + 1)) AS cell FROM ev),
met AS (SELECT a.ifo || ',' || b.ifo AS pair, a.slide AS slide_index, a.id AS id_l, b.id AS id_r, a.peak - b.peak AS dt, a.t0 AS a0, a.t1 AS a1, b.t0 AS b0, b.t1 AS b1,
               abs(a.f - b.f) / greatest(a.f1 - a.f0, b.f1 - b.f0, 1.0) AS apart,
               least(4.0 + 3.0 * sqrt(pow(greatest(a.tSpread, 0.5), 2) + pow(greatest(b.tSpread, 0.5), 2)), 10.0) AS tol
        FROM a JOIN b ON a.slide = b.slide AND a.cell = b.cell AND a.ifo < b.ifo
        WHERE a.cell = greatest(floor((a.t0 - 10) / 128), floor(b.t0 / 128))),
kept AS (SELECT *, abs(dt) / greatest(tol, 1e-12) + apart AS cost FROM met WHERE least(a1, b1 + tol) >= greatest(a0, b0 - tol))"""


@query("network_slides", with_views(TRIG, NETWORK_EDGES) + """
SELECT pair, slide_index::INT AS slide_index, id_l, id_r, round(dt, 6) AS dt_s, round(cost, 6) AS cost FROM kept""")
def network_slides(spark, folder):
    """Every admitted pair of events of all detectors, at zero lag and in a hundred slides."""
    e = ns.slid_edges(triggers(spark, folder), IFOS, CONFIG, NETWORK_SHIFTS, 0.0, SPAN_S)
    return e.select("pair", "slide_index", "id_l", "id_r", R6("dt_s").alias("dt_s"), R6("cost").alias("cost"))


@query("network_slides_by_pair", with_views(TRIG, NETWORK_EDGES) + """
SELECT pair, count(*)::BIGINT AS n_pairs, count(DISTINCT slide_index)::BIGINT AS n_slides, count(*) FILTER (slide_index = 0)::BIGINT AS n_zero_lag,
       round(min(cost), 6) AS least_cost FROM kept GROUP BY pair""")
def network_slides_by_pair(spark, folder):
    """How many accidental pairs each two detectors have over all slides, and how many at zero lag."""
    e = ns.slid_edges(triggers(spark, folder), IFOS, CONFIG, NETWORK_SHIFTS, 0.0, SPAN_S)
    return e.groupBy("pair").agg(F.count("*").alias("n_pairs"), F.count_distinct("slide_index").alias("n_slides"),
                                 F.count_if(F.col("slide_index") == 0).alias("n_zero_lag"), R6(F.min("cost")).alias("least_cost"))
