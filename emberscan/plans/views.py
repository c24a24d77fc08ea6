"""The analysis tables every catalogue query starts from, derived from the given ones.

Each view exists twice, as a DataFrame and as the same projection in SQL, so
that a query and its check read the same rows. Times are seconds since the
start of the analysed month, which keeps microseconds exact in a double.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscan.functions.arrays import doubles
from emberscan.operators.tiles import sparsify

MONTH_START = "2024-01-01 00:00:00"
MONTH_START_US = 1704067200000000
SPAN_S = 30 * 86400.0
WINDOW, OVERLAP, FS, SIGMA = 64, 16, 2048.0, 0.125


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def gps_of(ts) -> "F.Column":
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(ts) - micros(F.lit(MONTH_START).cast("timestamp_ntz"))) / F.lit(1e6)


def triggers(spark: SparkSession, folder: str) -> DataFrame:
    """One row per event: its type is the detector, its value the statistic."""
    k = F.regexp_extract("props", r'"k": (\d+)', 1).cast("int")
    return (
        table(spark, folder, "events")
        .select(F.col("event_id").alias("id"), F.col("event_type").alias("ifo"), gps_of(F.col("ts")).alias("gps"),
                F.col("value").alias("EnWDF"), k.alias("k"), "user_id")
        .withColumn("duration", F.lit(10.0) + F.col("k"))
        .withColumn("gpsStart", F.col("gps") - F.col("duration") / 2)
        .withColumn("gpsEnd", F.col("gpsStart") + F.col("duration"))
        .withColumn("gpsPeak", F.col("gps"))
        .withColumn("gpsCentroid", F.col("gps") + F.col("k") / 100.0)
        .withColumn("tSpread", F.col("k") / 10.0)
        .withColumn("freqMin", F.lit(0.7) * F.col("k"))
        .withColumn("freqMean", F.col("k").cast("double"))
        .withColumn("freqMax", F.lit(1.4) * F.col("k"))
        .withColumn("sigma", F.lit(1.0) + F.col("k") / 100.0)
        .withColumn("n_coeff", F.expr("shiftleft(64L, k % 3)"))
    )


TRIG = f"""trig AS (
  SELECT id, ifo, gps, EnWDF, k, user_id, duration, gps - duration / 2 AS gpsStart,
         gps - duration / 2 + duration AS gpsEnd, gps AS gpsPeak, gps + k / 100.0::DOUBLE AS gpsCentroid,
         k / 10.0::DOUBLE AS tSpread, 0.7::DOUBLE * k AS freqMin, k::DOUBLE AS freqMean, 1.4::DOUBLE * k AS freqMax,
         1.0::DOUBLE + k / 100.0::DOUBLE AS sigma, (64::BIGINT << (k % 3)) AS n_coeff
  FROM (SELECT event_id AS id, event_type AS ifo, (epoch_us(ts) - {MONTH_START_US}) / 1e6::DOUBLE AS gps,
               value AS EnWDF, regexp_extract(props, '"k": (\\d+)', 1)::INT AS k, user_id,
               10.0::DOUBLE + regexp_extract(props, '"k": (\\d+)', 1)::INT AS duration
        FROM events))"""


def windows(spark: SparkSession, folder: str) -> DataFrame:
    """One row per vector, read as a packed window of 64 coefficients on the search's own grid."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("trigger_id"),
        F.when(F.col("label") % 2 == 0, "H1").otherwise("L1").alias("ifo"),
        (F.col("vec_id") * F.lit((WINDOW - OVERLAP) / FS)).alias("gps"),
        F.lit(WINDOW).cast("long").alias("n_coeff"), F.lit(FS).alias("fs"), F.lit(SIGMA).alias("sigma"),
        F.col("label"), doubles(F.col("embedding")).alias("dense"),
    )


WIN = f"""win AS (
  SELECT vec_id AS trigger_id, CASE WHEN label % 2 = 0 THEN 'H1' ELSE 'L1' END AS ifo,
         vec_id * {(WINDOW - OVERLAP) / FS}::DOUBLE AS gps, 64::BIGINT AS n_coeff, {FS}::DOUBLE AS fs,
         {SIGMA}::DOUBLE AS sigma, label, list_transform(embedding, lambda x: x::DOUBLE) AS dense
  FROM embeddings)"""

# Thresholds in units of the noise scale: the search's own, and a low one that
# leaves several coefficients per window for the operators that group them.
LOW_CUT = 1.6


def sparse_windows(spark: SparkSession, folder: str, cut: float | None = LOW_CUT) -> DataFrame:
    base = windows(spark, folder)
    limit = None if cut is None else F.lit(cut) * F.col("sigma")
    return sparsify(base, "dense", limit).drop("dense")


def tile_sql(cut: float | None = LOW_CUT) -> str:
    """`coef` and `tile`: surviving coefficients, and their boxes on the plane."""
    limit = f"{cut}::DOUBLE * sigma" if cut is not None else "sigma * sqrt(2.0 * ln(n_coeff::DOUBLE))"
    return f"""coef AS (
  SELECT trigger_id, ifo, gps, n_coeff, fs, sigma, label, i - 1 AS k, dense[i] AS c
  FROM (SELECT *, unnest(generate_series(1, 64)) AS i FROM win)
  WHERE abs(dense[i]) >= {limit} AND dense[i] <> 0),
tile AS (
  SELECT trigger_id, ifo, k, c, sigma, fs, n_coeff AS scale, label, gps AS w_gps, lev AS level,
         gps + pos * (64 / pow(2.0, greatest(lev, 0)) / fs) AS t_lo,
         gps + (pos + 1) * (64 / pow(2.0, greatest(lev, 0)) / fs) AS t_hi,
         CASE WHEN k = 0 THEN 0.0 ELSE fs / pow(2.0, 6 - lev + 1) END AS f_lo,
         fs / pow(2.0, 6 - lev) AS f_hi, c * c AS energy
  FROM (SELECT *, CASE WHEN k = 0 THEN -1 ELSE floor(log2(k))::INT END AS lev,
               CASE WHEN k = 0 THEN 0 ELSE k - pow(2.0, floor(log2(k)))::BIGINT END AS pos FROM coef))"""


def labelled_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a label: length is the score, quality tells signal from noise."""
    docs = table(spark, folder, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"), "lang")
    return docs.join(table(spark, folder, "labels"), on="doc_id").withColumn("positive", F.col("quality") == 1)


SCORES = """scores AS (
  SELECT doc_id, n_chars::DOUBLE AS score, lang, quality, toxic, quality = 1 AS positive
  FROM documents JOIN labels USING (doc_id))"""


def injections(spark: SparkSession, folder: str, ifo: str = "signup", least: float = 60.0) -> DataFrame:
    """The loud events of one detector, taken as the truth others are matched to."""
    t = triggers(spark, folder)
    return t.where((F.col("ifo") == ifo) & (F.col("EnWDF") >= least)).select(
        F.col("id").alias("injection_id"), F.col("gps").alias("inj_gps"), F.col("EnWDF").alias("network_snr"), "user_id")


INJ = """inj AS (
  SELECT id AS injection_id, gps AS inj_gps, EnWDF AS network_snr, user_id
  FROM trig WHERE ifo = 'signup' AND EnWDF >= 60.0)"""


def with_views(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
