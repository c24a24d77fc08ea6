"""Working tables in the folder the cluster shares, and shipping this package to Python workers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from emberscan.session import ensure_checkpoint_dir, ship_package

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

ARROW_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def folder(spark: SparkSession) -> str:
    """The shared scratch folder: the one the cluster names, or a temporary one in a local run."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    ensure_checkpoint_dir(spark)
    return str(spark.sparkContext.getCheckpointDir()).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write `df` to shared storage and read it back: lineage ends here, and a lost executor costs only a re-read."""
    spark = df.sparkSession
    path = new_path(spark, name)
    # What the write shuffled is not needed again once the table stands.
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    for paths in _open.get():
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: The workspaces around the running code; another thread has its own.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open workspaces", default=())


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Working tables written inside are deleted at the end. What is yielded writes a table that stays.

    Only for operators that hand back such a table: nothing may still read the others then.
    """
    paths: list[str] = []
    stays: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        out = written(df, "result")
        stays.append(paths[-1])
        return out

    token = _open.set((*_open.get(), paths))
    try:
        yield keep
    except BaseException:
        stays.clear()
        raise
    finally:
        _open.reset(token)
        _delete(spark, [p for p in paths if p not in stays])


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that an operator filled, if it is there."""
    _delete(spark, [path])


def discard(df: DataFrame) -> None:
    """Delete a working table that nothing reads any more."""
    _delete(df.sparkSession, sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


def prepare(spark: SparkSession) -> None:
    """Call first in an operator that runs Python on the executors: ships the package, and keeps what a task is handed
    at a time to some megabytes of text, on both sides of the pipe."""
    ship_package(spark)
    for name, most in ARROW_LIMITS.items():
        stated = spark.conf.get(name)
        if not (stated.isdigit() and 0 < int(stated) <= most):
            spark.conf.set(name, str(most))
