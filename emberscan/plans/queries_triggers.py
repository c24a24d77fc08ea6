"""Catalogue: scanning, cleaning and summarising triggers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from emberscan.operators import clean, summary
from emberscan.plans.registry import query
from emberscan.plans.views import TRIG, WIN, labelled_scores, table, tile_sql, triggers, windows, with_views, sparse_windows
from emberscan.operators.slides import pool_backgrounds
from emberscan.session import ensure_checkpoint_dir
from emberscan.sources import triggers as files

R6 = lambda c: F.round(c, 6)


@query("trigger_schema_scan", with_views(TRIG) + """
SELECT id, ifo, round(gps, 6) AS gps, "EnWDF", duration, round("freqMin", 6) AS "freqMin", round("freqMax", 6) AS "freqMax", n_coeff
FROM trig""")
def trigger_schema_scan(spark, folder):
    return triggers(spark, folder).select(
        "id", "ifo", R6("gps").alias("gps"), "EnWDF", "duration", R6("freqMin").alias("freqMin"),
        R6("freqMax").alias("freqMax"), "n_coeff")


@query("trigger_runs_read_back", with_views(WIN, tile_sql()) + """,
per AS (SELECT trigger_id, count(*)::BIGINT AS n, sum(c * c) AS e, max(abs(c)) AS peak, min(k)::BIGINT AS first_index FROM coef GROUP BY trigger_id)
SELECT CASE WHEN label < 5 THEN 'run1' ELSE 'run2' END AS run, ifo, round(gps, 6) AS gps, w.n_coeff, round((sqrt(e) / sigma)::FLOAT::DOUBLE, 3) AS "EnWDF", round(peak, 4) AS "snrPeak",
       n AS n_coefficients, round(e, 4) AS energy, first_index
FROM win w JOIN per USING (trigger_id)""")
def trigger_runs_read_back(spark, folder):
    """All windows with coefficients, written as two runs of a tree and read back from its top."""
    w = sparse_windows(spark, folder).where(F.size("wt_index") > 0)
    energy = F.aggregate("wt_value", F.lit(0.0), lambda a, v: a + v * v)
    span = F.col("n_coeff") / F.col("fs")
    measured = {c: F.lit(None).cast("double") for c in files.MEASURED} | {
        "EnWDF": F.sqrt(energy) / F.col("sigma"), "snrPeak": F.array_max(F.transform("wt_value", lambda v: F.abs(v))), "duration": span, "sigma": F.col("sigma")}
    rows = w.withColumns(measured | {c: F.col("gps") for c in files.TIMES}).withColumns({
        "wave": F.lit("Haar"), "wt_index": F.col("wt_index").cast("array<int>"), "wt_value": F.col("wt_value").cast("array<float>")})
    rows = rows.select("ifo", *files.TRIGGER.names, F.when(F.col("label") < 5, "run1").otherwise("run2").alias("run"))
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/runs-{uuid.uuid4().hex}"
    for run in ("run1", "run2"):
        files.write_triggers(rows.where(F.col("run") == run).drop("run"), f"{base}/o4/{run}")
    back = files.read_triggers(spark, base)
    energy = F.aggregate("wt_value", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return back.select(
        F.regexp_extract("_file", "/(run[12])/", 1).alias("run"), "ifo", R6("gps").alias("gps"), "n_coeff", F.round("EnWDF", 3).alias("EnWDF"),
        F.round("snrPeak", 4).alias("snrPeak"), F.size("wt_index").cast("long").alias("n_coefficients"), F.round(energy, 4).alias("energy"),
        F.array_min("wt_index").cast("long").alias("first_index"))


@query("trigger_union_tagged", with_views(TRIG) + """
SELECT segment_id, count(*)::BIGINT AS n, round(sum("EnWDF"), 4) AS total
FROM (SELECT 'day' AS segment_id, * FROM trig WHERE ifo = 'click' UNION ALL SELECT 'night', * FROM trig WHERE ifo = 'view')
GROUP BY segment_id""")
def trigger_union_tagged(spark, folder):
    t = triggers(spark, folder)
    pooled = pool_backgrounds({"day": t.where("ifo = 'click'"), "night": t.where("ifo = 'view'")})
    return pooled.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("EnWDF"), 4).alias("total"))


@query("clean_snr_edge", with_views(TRIG) + """,
quiet AS (SELECT * FROM trig WHERE "EnWDF" < 400.0),
edge AS (SELECT ifo, min(gps) + 3600.0::DOUBLE AS lo, max(gps) - 3600.0::DOUBLE AS hi FROM quiet GROUP BY ifo)
SELECT id, ifo, round(gps, 6) AS gps, "EnWDF" FROM quiet JOIN edge USING (ifo) WHERE gps > lo AND gps < hi""")
def clean_snr_edge(spark, folder):
    t = triggers(spark, folder).withColumn("snrPeak", F.col("EnWDF"))
    kept = clean.clean_triggers(t, snr_ceiling=400.0, edge_guard_s=3600.0, keys=["ifo"])
    return kept.select("id", "ifo", R6("gps").alias("gps"), "EnWDF")


@query("clean_robust_bounds", with_views(TRIG) + """
SELECT id AS trigger_index, ifo, "EnWDF", round(gps, 6) AS gps FROM trig
WHERE "EnWDF" >= 0 AND sigma > 0 AND "freqMax" >= "freqMin" AND "gpsEnd" >= "gpsStart"
  AND gps >= 86400.0 + 5.0 AND gps <= 2505600.0 - 5.0""")
def clean_robust_bounds(spark, folder):
    kept = clean.clean_triggers_robust(triggers(spark, folder), "id", (86400.0, 2505600.0), 5.0)
    return kept.select("trigger_index", "ifo", "EnWDF", R6("gps").alias("gps"))


@query("legacy_alias", with_views(TRIG) + """
SELECT id, "EnWDF", "EnWDF" AS snr_copy FROM trig""")
def legacy_alias(spark, folder):
    old = triggers(spark, folder).select("id", F.col("EnWDF").alias("mSNR"))
    out = clean.ensure_statistic(old)
    return out.select("id", "EnWDF", F.col("EnWDF").alias("snr_copy"))


@query("event_floor", with_views(TRIG) + """
SELECT id, "EnWDF" FROM trig WHERE "EnWDF" >= 100.0""")
def event_floor(spark, folder):
    return clean.select_for_coincidence(triggers(spark, folder), 100.0).select("id", "EnWDF")


@query("temporal_split_masks", with_views(TRIG) + """,
b AS (SELECT min(gps) + 0.4::DOUBLE * (max(gps) - min(gps)) AS cut FROM trig)
SELECT id, gps < cut AS train, NOT (gps < cut) AS test FROM trig, b""")
def temporal_split_masks(spark, folder):
    return clean.temporal_split(triggers(spark, folder), "gps", 0.4).select("id", "train", "test")


@query("trigger_summary", with_views(TRIG) + """,
q AS (SELECT ifo, unnest([0.5, 0.9, 0.99, 1.0]::DOUBLE[]) AS q,
             unnest(quantile_cont("EnWDF", [0.5, 0.9, 0.99, 1.0]::DOUBLE[])) AS v FROM trig GROUP BY ifo)
SELECT t.ifo, t.n, round(t.livetime_s, 6) AS livetime_s, round(t.n / t.livetime_s, 9) AS rate_hz, q.q AS q, round(q.v, 6) AS statistic_value
FROM (SELECT ifo, count(*)::BIGINT AS n, max(gps) - min(gps) AS livetime_s FROM trig GROUP BY ifo) t JOIN q USING (ifo)""")
def trigger_summary(spark, folder):
    t = triggers(spark, folder)
    span = summary.livetime(t, ["ifo"], "gps")
    q = summary.quantile_table(t, ["ifo"], "EnWDF", (0.5, 0.9, 0.99, 1.0))
    return span.join(q, "ifo").select(
        "ifo", "n", R6("livetime_s").alias("livetime_s"), F.round("rate_hz", 9).alias("rate_hz"), "q",
        R6("statistic_value").alias("statistic_value"))


@query("survivor_summary", with_views(WIN, tile_sql()) + """,
s AS (SELECT trigger_id, count(*)::BIGINT AS n FROM coef GROUP BY 1)
SELECT (SELECT count(*)::BIGINT FROM win) AS n_triggers, sum(n)::BIGINT AS n_coefficients,
       round(sum(n)::DOUBLE / (64 * (SELECT count(*) FROM win)), 9) AS density, max(n)::BIGINT AS most,
       1::BIGINT AS n_window_lengths FROM s""")
def survivor_summary(spark, folder):
    return summary.coefficient_density(sparse_windows(spark, folder)).select(
        "n_triggers", "n_coefficients", F.round("density", 9).alias("density"), "most", "n_window_lengths")


@query("winning_basis_counts", with_views(TRIG) + """
SELECT ifo AS wave, count(*)::BIGINT AS n FROM trig GROUP BY ifo""")
def winning_basis_counts(spark, folder):
    return summary.value_counts(triggers(spark, folder).withColumnRenamed("ifo", "wave"), "wave")


@query("rate_per_minute", """
SELECT time_bucket(interval '60 seconds', ts) AS minute_start, count(*)::BIGINT AS n, round(count(*) / 60.0::DOUBLE, 9) AS rate_hz
FROM events GROUP BY 1""")
def rate_per_minute(spark, folder):
    rates = summary.trigger_rate(table(spark, folder, "events"), "ts", 60)
    return rates.select("minute_start", "n", F.round("rate_hz", 9).alias("rate_hz"))


@query("survivor_histogram", with_views(WIN, tile_sql()) + """
SELECT survivors, count(*)::BIGINT AS n FROM (
  SELECT w.trigger_id, count(c.k)::BIGINT AS survivors FROM win w LEFT JOIN coef c USING (trigger_id) GROUP BY 1) GROUP BY 1""")
def survivor_histogram(spark, folder):
    return summary.survivor_histogram(sparse_windows(spark, folder))


@query("level_occupancy", with_views(WIN, tile_sql()) + """
SELECT level, count(*)::BIGINT AS n FROM tile GROUP BY 1""")
def level_occupancy(spark, folder):
    return summary.level_occupancy(sparse_windows(spark, folder))


@query("analysed_span", with_views(TRIG) + """
SELECT round(max(a), 6) AS span_start, round(greatest(max(a), min(b)), 6) AS span_end
FROM (SELECT ifo, min("gpsStart") AS a, max("gpsStart") AS b FROM trig GROUP BY ifo)""")
def analysed_span(spark, folder):
    return summary.analysed_span(triggers(spark, folder), "gpsStart").select(
        R6("span_start").alias("span_start"), R6("span_end").alias("span_end"))


@query("livetime_days", with_views(TRIG) + """
SELECT round(sum(b - a) / 86400.0, 9) AS livetime_days FROM (SELECT ifo, min(gps) AS a, max(gps) AS b FROM trig GROUP BY ifo)""")
def livetime_days(spark, folder):
    spans = triggers(spark, folder).groupBy("ifo").agg(F.min("gps").alias("first"), F.max("gps").alias("last"))
    return summary.covered_livetime_days(spans).select(F.round("livetime_days", 9).alias("livetime_days"))


@query("loudest_triggers", with_views(TRIG) + """
SELECT id, ifo, "EnWDF" FROM trig ORDER BY "EnWDF" DESC, id LIMIT 20""")
def loudest_triggers(spark, folder):
    return summary.loudest(triggers(spark, folder), "EnWDF", "id", 20).select("id", "ifo", "EnWDF")


@query("window_strides", with_views(TRIG) + """
SELECT n_coeff, round(min(stride), 9) AS stride FROM (
  SELECT n_coeff, 0.75::DOUBLE * n_coeff / 2048.0 AS stride FROM trig) GROUP BY n_coeff""")
def window_strides(spark, folder):
    t = triggers(spark, folder).withColumn("fs", F.lit(2048.0)).withColumn(
        "stride", F.lit(0.75) * F.col("n_coeff") / F.lit(2048.0))
    return summary.window_strides(t, "id").select("n_coeff", F.round("stride", 9).alias("stride"))


@query("session_events", """
WITH gaps AS (SELECT event_type, ts, value, CASE WHEN ts - lag(ts) OVER w < interval '5 minutes' THEN 0 ELSE 1 END AS opens
              FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
lab AS (SELECT *, sum(opens) OVER (PARTITION BY event_type ORDER BY ts) AS s FROM gaps)
SELECT event_type AS ifo, min(ts) AS started, max(ts) AS ended, count(*)::BIGINT AS n, max(value) AS peak FROM lab GROUP BY event_type, s""")
def session_events(spark, folder):
    return summary.sessions(table(spark, folder, "events").withColumnRenamed("event_type", "ifo"), "ts", "ifo", "event_id", 300, "value")


@query("review_by_class", with_views("""scored AS (
  SELECT lang, source, n_chars::DOUBLE AS injected, (n_chars + quality * 10)::DOUBLE AS recovered, quality = 1 AS found
  FROM documents JOIN labels USING (doc_id))""") + """
SELECT lang AS category, source AS subclass, count(*)::BIGINT AS n, sum(found::INT)::BIGINT AS n_found,
       round(avg(found::INT), 3) AS efficiency, round(median(recovered) FILTER (WHERE found), 6) AS median_recovered
FROM scored GROUP BY 1, 2""")
def review_by_class(spark, folder):
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    rec = docs.select(F.col("lang").alias("category"), F.col("source").alias("subclass"),
                      (F.col("n_chars") + F.col("quality") * 10).cast("double").alias("recovered_snr"),
                      (F.col("quality") == 1).alias("found"))
    return summary.by_class(rec).select("category", "subclass", "n", "n_found", "efficiency",
                                        R6("median_recovered").alias("median_recovered"))


@query("review_headline", with_views("""scored AS (
  SELECT n_chars::DOUBLE AS injected, (n_chars * (1 + quality) + doc_id % 7)::DOUBLE AS recovered, quality = 1 AS found
  FROM documents JOIN labels USING (doc_id))""") + """
SELECT count(*)::BIGINT AS n_injections, sum(found::INT)::BIGINT AS n_found, round(avg(found::INT), 6) AS efficiency,
       round(corr(injected, recovered) FILTER (WHERE found), 6) AS snr_correlation FROM scored""")
def review_headline(spark, folder):
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    rec = docs.select(F.col("n_chars").cast("double").alias("injected_snr"),
                      (F.col("n_chars") * (F.lit(1) + F.col("quality")) + F.col("doc_id") % 7).cast("double").alias("recovered_snr"),
                      (F.col("quality") == 1).alias("found"))
    return summary.headline(rec).select("n_injections", "n_found", R6("efficiency").alias("efficiency"),
                                        R6("snr_correlation").alias("snr_correlation"))


@query("population_histogram", with_views("""snr AS (SELECT n_chars / 200.0::DOUBLE AS x, lang FROM documents)""") + """
SELECT lang AS subclass, floor(x / 4.0)::INT AS bin, count(*)::BIGINT AS n FROM snr WHERE x >= 0 AND x < 100 GROUP BY 1, 2""")
def population_histogram(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("lang").alias("subclass"), (F.col("n_chars") / F.lit(200.0)).alias("snr"))
    return summary.histogram(docs, "snr", 0.0, 100.0, 25, ["subclass"])
