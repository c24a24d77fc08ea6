"""Chunked sample series, noise models and waveform tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "ifo string, chunk bigint, t0 double, fs double, samples array<double>"


def write_samples(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Chunks as Parquet, ranged on detector and time so that a stretch of one detector is few files."""
    chunks.repartitionByRange("ifo", "chunk").write.mode(mode).option("compression", "zstd").partitionBy("ifo").parquet(path)


def read_samples(spark: SparkSession, path: str, ifo: str | None = None, start: float | None = None,
                 stop: float | None = None) -> DataFrame:
    """Chunks of a stretch; the detector prunes folders and the time prunes row groups."""
    df = spark.read.schema(CHUNKS).parquet(path)
    if ifo is not None:
        df = df.where(F.col("ifo") == ifo)
    if stop is not None:
        df = df.where(F.col("t0") < stop)
    if start is not None:
        # A chunk that starts earlier may still reach in; its own length says so.
        df = df.where(F.col("t0") + F.size("samples") / F.col("fs") > start)
    return df


def rechunk(samples: DataFrame, length: int, keys: tuple[str, ...] = ("ifo",)) -> DataFrame:
    """`(keys, n, value)` to chunks of `length` samples; where a series breaks off, its last chunk is shorter.

    A chunk that begins late or has a hole cannot be told by its number alone and is refused; start a new key there.
    """
    at = F.floor(F.col("n") / length)
    # A chunk is `length` entries by definition.
    grouped = samples.groupBy(*keys, at.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("_s"))
    first, last = F.col("_s")[0]["n"], F.element_at("_s", -1)["n"]
    solid = (first == F.col("chunk") * length) & (last - first + 1 == F.size("_s"))
    told = F.assert_true(solid, "a chunk begins late or has a hole")
    return grouped.withColumn("_ok", told).where(F.col("_ok").isNull()).select(*keys, "chunk", F.transform("_s", lambda s: s["value"]).alias("samples"))


def save_model(model: DataFrame, path: str) -> None:
    """Noise models: one row per detector and segment."""
    model.write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# Fixed value: how waveform tables are named, model first and direction last.
WAVEFORM_NAME = r"([^/]+)_strains_(.+)\.txt$"


def waveform_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """`(model, direction, path)` of the whitespace tables in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_strains_*.txt").load(folder).select("path")
    return files.select(F.regexp_extract("path", WAVEFORM_NAME, 1).alias("model"),
                        F.regexp_extract("path", WAVEFORM_NAME, 2).alias("direction"), "path")


def read_waveforms(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every table: `(model, direction, t, h_plus, h_cross)`."""
    lines = spark.read.option("pathGlobFilter", "*_strains_*.txt").text(folder).withColumn("path", F.col("_metadata.file_path"))
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.trim("value").startswith("#") & (F.size(parts) >= 3))
    return rows.select(F.regexp_extract("path", WAVEFORM_NAME, 1).alias("model"), F.regexp_extract("path", WAVEFORM_NAME, 2).alias("direction"),
                       *[parts[i].cast("double").alias(c) for i, c in enumerate(("t", "h_plus", "h_cross"))])
