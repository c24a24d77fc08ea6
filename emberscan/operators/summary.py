"""Run summaries and the aggregates behind reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberscan.functions import wavelet as wv
from emberscan.operators.scan import exact_quantiles, islands


def livetime(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    span = F.max(time) - F.min(time)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), span.alias("livetime_s")).withColumn(
        "rate_hz", F.try_divide(F.col("n"), F.col("livetime_s")))


def quantile_table(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float]) -> DataFrame:
    return exact_quantiles(df, keys, value, quantiles, "statistic_value")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def coefficient_density(triggers: DataFrame) -> DataFrame:
    """How sparse the stored windows are."""
    kept = F.size("wt_index")
    return triggers.agg(
        F.count(F.lit(1)).alias("n_triggers"), F.sum(kept).alias("n_coefficients"),
        (F.sum(kept).cast("double") / F.sum("n_coeff")).alias("density"), F.max(kept).cast("long").alias("most"),
        F.count_distinct("n_coeff").alias("n_window_lengths"))


def trigger_rate(df: DataFrame, ts: str, seconds: int) -> DataFrame:
    w = F.window(ts, f"{seconds} seconds")
    return df.groupBy(w).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("minute_start"), "n", (F.col("n") / F.lit(float(seconds))).alias("rate_hz"))


def survivor_histogram(triggers: DataFrame) -> DataFrame:
    return triggers.groupBy(F.size("wt_index").cast("long").alias("survivors")).agg(F.count(F.lit(1)).alias("n"))


def level_occupancy(triggers: DataFrame) -> DataFrame:
    k = triggers.select(F.explode("wt_index").alias("k"))
    return k.groupBy(wv.level(F.col("k")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def analysed_span(df: DataFrame, time: str = "gpsStart") -> DataFrame:
    """The stretch every detector covers, of no length when they share none."""
    per = df.groupBy("ifo").agg(F.min(time).alias("a"), F.max(time).alias("b"))
    return per.agg(F.max("a").alias("span_start"), F.min("b").alias("b")).select(
        "span_start", F.greatest("span_start", "b").alias("span_end"))


def covered_livetime_days(spans: DataFrame) -> DataFrame:
    ordered = F.assert_true(F.col("last") >= F.col("first"), "a span ends before it starts")
    checked = spans.withColumn("_ok", ordered).where(F.col("_ok").isNull())
    return checked.agg((F.sum(F.col("last") - F.col("first")) / F.lit(86400.0)).alias("livetime_days"))


def loudest(df: DataFrame, statistic: str, row_id: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(statistic), row_id).limit(n)


def window_strides(triggers: DataFrame, row_id: str) -> DataFrame:
    """The declared stride of each window length, from its first row; the window itself if none is."""
    declared = F.min(F.when(F.col("stride").isNotNull(), F.struct(row_id, "stride")))
    return triggers.groupBy("n_coeff").agg(declared.alias("_s"), F.max("fs").alias("_fs")).select(
        "n_coeff", F.coalesce(F.col("_s.stride"), F.col("n_coeff") / F.col("_fs")).alias("stride"))


def sessions(df: DataFrame, ts: str, key: str, row_id: str, gap_s: int, value: str) -> DataFrame:
    """Bursts of one detector closed by a silence of `gap_s` or more.

    Labelled by the slab scan and not by `session_window`, whose batch form
    merges a detector's sessions in one task.
    """
    micros = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    labelled = islands(micros, [key], "_us", "_us", row_id, gap=F.lit(gap_s * 1_000_000 - 1))
    return labelled.groupBy(key, "island").agg(
        F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("n"),
        F.max(value).alias("peak")).drop("island")


def by_class(recovery: DataFrame) -> DataFrame:
    found = F.col("found")
    counts = recovery.groupBy("category", "subclass").agg(
        F.count(F.lit(1)).alias("n"), F.sum(found.cast("int")).alias("n_found"),
        F.round(F.avg(found.cast("int")), 3).alias("efficiency"))
    middle = exact_quantiles(recovery.where(found), ["category", "subclass"], "recovered_snr", [0.5], "median_recovered")
    return counts.join(middle.drop("q"), on=["category", "subclass"], how="left")


def headline(recovery: DataFrame) -> DataFrame:
    found = F.col("found")
    return recovery.agg(
        F.count(F.lit(1)).alias("n_injections"), F.sum(found.cast("int")).alias("n_found"),
        F.avg(found.cast("int")).alias("efficiency"),
        F.corr(F.when(found, F.col("injected_snr")), F.when(found, F.col("recovered_snr"))).alias("snr_correlation"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    inside = df.where((F.col(value) >= low) & (F.col(value) < high))
    at = F.floor((F.col(value) - low) / ((high - low) / bins)).cast("int")
    return inside.groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
