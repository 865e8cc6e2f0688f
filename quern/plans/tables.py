"""Intermediate results as tables in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which the driver and all executors see. Where none is set, a temporary one
    if all run in this process (tests); on a cluster that is an error, as executors could not read it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files: they go as each write ends, not when the driver's collector comes by."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """``df`` written as Parquet and read back; what lies above is not computed again, lost executors or not. ``stays``:
    an enclosing ``scratch`` leaves it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    if not stays and (paths := _WRITTEN.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within go at the end, but for those that stay."""
    token = _WRITTEN.set([])
    try:
        yield
    finally:
        for path in _WRITTEN.get() or ():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        _WRITTEN.reset(token)


def bounded_batches(spark: SparkSession, nbytes: int = 4 << 20) -> None:
    """Arrow batches to Python of about ``nbytes`` at most, from here on in this session: by rows alone (10,000) a batch of
    long values has no bound, neither in the worker nor in the executor's direct memory."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(limit, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= nbytes:
        spark.conf.set(limit, str(nbytes))
