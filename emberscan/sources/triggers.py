"""Trigger files: schema, reading, writing and the run parameters beside them."""

from __future__ import annotations

import json
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of a trigger file with their types on disk, the
# longest window an index can address, and the sidecar's name.
MEASURED = ("tSpread", "duration", "duration90", "EnWDF", "sigma", "snrPeak", "freqMin", "freqMean", "freqMax", "freqQ05", "freqQ95")
TIMES = ("gps", "gpsStart", "gpsCentroid", "gpsPeak")
MAX_COEFF = 1 << 16
SIDECAR = "parametersUsed-Win{}.json"
WINDOW_IN_NAME = r"-Win(\d+)-"

TRIGGER = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in TIMES]
    + [T.StructField(c, T.FloatType()) for c in MEASURED]
    + [T.StructField("wave", T.StringType()), T.StructField("n_coeff", T.LongType()), T.StructField("fs", T.DoubleType()),
       T.StructField("wt_index", T.ArrayType(T.IntegerType())), T.StructField("wt_value", T.ArrayType(T.FloatType()))])


@dataclass
class RunParameters:
    """What a run was configured with; unknown names are kept in `extra`."""

    window: float | None = None
    overlap: float | None = None
    sampling: float | None = None
    ResamplingFactor: float | None = None
    extra: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> "RunParameters":
        found = json.loads(Path(path).read_text())
        known = {k: found.pop(k) for k in ("window", "overlap", "sampling", "ResamplingFactor") if k in found}
        return cls(**known, extra=found)

    def dump(self, path: str) -> None:
        flat = asdict(self)
        extra = flat.pop("extra")
        Path(path).write_text(json.dumps({**flat, **extra}, indent=1, sort_keys=True))


@contextmanager
def _row_reader(spark: SparkSession):
    """Files from other writers may split float bytes in a way the vectorised reader does not know."""
    name = "spark.sql.parquet.enableVectorizedReader"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: A run is the folder above a file, or above the `name=value` folders it lies in.
RUN_OF_FILE = r"^(.*?)(?:/[^/=]+=[^/]*)*/[^/]*$"


def run_folders(spark: SparkSession, paths: list[str], pattern: str = "*.parquet") -> list[str]:
    """The runs below some folders, however deep; files may be named, too. Spark lists them, no file is opened."""
    if not paths:
        raise ValueError("no trigger file paths")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(paths)
    runs = files.select(F.regexp_extract("path", RUN_OF_FILE, 1).alias("run")).distinct().orderBy("run").collect()
    if not runs:
        raise ValueError(f"no trigger files {pattern} below {', '.join(paths)}")
    return [r["run"] for r in runs]


def read_triggers(spark: SparkSession, path: str | list[str], ifo: str | None = None, pattern: str = "*.parquet",
                  foreign: bool = False) -> DataFrame:
    """Triggers of all runs below some folders, measurements as doubles and NaN as NULL.

    A run is a folder of files, or what `write_triggers` made: there, `ifo` and `n_coeff` are folders, which a filter on
    them prunes in every run. A run whose files lack a column of a trigger is refused by name. The plan has one scan a run.
    With `foreign`, the files are read once by the row reader and kept in the checkpoint folder; write them with
    `write_triggers` to be rid of the detour.
    """
    from emberscan.session import cut_lineage

    own = {f.name: f for f in [*TRIGGER, T.StructField("ifo", T.StringType())]}
    raw = None
    for run in run_folders(spark, [path] if isinstance(path, str) else list(path), pattern):
        reader = spark.read.option("pathGlobFilter", pattern).option("basePath", run)
        found = reader.parquet(run).columns
        lacking = [f.name for f in TRIGGER if f.name not in found]
        if lacking:
            raise ValueError(f"these are not trigger files: {run} has no column {', '.join(lacking)}")
        part = reader.schema(T.StructType([own[c] for c in found if c in own])).parquet(run).withColumn("_file", F.col("_metadata.file_path"))
        raw = part if raw is None else raw.unionByName(part, allowMissingColumns=True)
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in (*TIMES, *MEASURED)}
    out = raw.withColumns(clean)
    if foreign:
        with _row_reader(spark):
            out = cut_lineage(out)
    return out if ifo is None else out.withColumn("ifo", F.lit(ifo))


def with_stride(triggers: DataFrame, folder: str) -> DataFrame:
    """Attach each file's stride from the sidecar of its window length; a file without one is refused."""
    spark = triggers.sparkSession
    beside = (
        spark.read.option("multiLine", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", SIDECAR.format("*")).schema("window double, overlap double, sampling double, ResamplingFactor double")
        .json(folder).select((F.col("window") - F.col("overlap")).alias("_hop"), (F.col("sampling") / F.col("ResamplingFactor")).alias("_rate"),
                             F.regexp_extract(F.col("_metadata.file_path"), r"-Win(\d+)\.json", 1).alias("_win"),
                             F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]*$", 1).alias("_dir")))
    # A file's window is in its name, or is its partition; its run is the folder above, or above the partitions.
    named = F.regexp_extract("_file", WINDOW_IN_NAME, 1)
    t = triggers.withColumn("_win", F.when(named != "", named).otherwise(F.col("n_coeff").cast("string"))).withColumn(
        "_dir", F.regexp_extract("_file", RUN_OF_FILE, 1))
    # One sidecar per run and window length.
    joined = t.join(beside, on=["_dir", "_win"], how="left")
    told = F.assert_true(F.col("_rate").isNotNull() & (F.col("_hop") > 0), "a trigger file has no usable run parameters beside it")
    return joined.withColumn("_ok", told).where(F.col("_ok").isNull()).withColumn(
        "stride", F.col("_hop") / F.col("_rate")).drop("_ok", "_hop", "_rate", "_win", "_dir")


def checked(triggers: DataFrame) -> DataFrame:
    """Refuse windows that are too long and indices outside their window."""
    fits = (F.col("n_coeff") <= MAX_COEFF) & F.forall("wt_index", lambda i: (i >= 0) & (i < F.col("n_coeff"))) & (
        F.size("wt_index") == F.size("wt_value"))
    ok = F.assert_true(fits, "a coefficient index lies outside its window")
    return triggers.withColumn("_ok", ok).where(F.col("_ok").isNull()).drop("_ok")


def write_triggers(triggers: DataFrame, path: str, partition_by: tuple[str, ...] = ("ifo", "n_coeff"), mode: str = "append") -> None:
    """Parquet, zstd, partitioned by detector and window length, measurements as floats.

    The rows are ranged on time within each partition value, so a hot detector
    is many files, each over its own stretch of time that a filter can skip.
    """
    narrow = {c: F.col(c).cast("float") for c in MEASURED if c in triggers.columns}
    rows = checked(triggers).withColumns(narrow)
    (rows.repartitionByRange(*partition_by, "gps").sortWithinPartitions(*partition_by, "gps")
     .write.mode(mode).option("compression", "zstd").partitionBy(*partition_by).parquet(path))


def triggers_from_records(spark: SparkSession, records: list[dict], ifo: str) -> DataFrame:
    names = [f.name for f in TRIGGER]
    rows = [tuple(r.get(c) for c in names) for r in records]
    return spark.createDataFrame(rows, TRIGGER).withColumn("ifo", F.lit(ifo))
