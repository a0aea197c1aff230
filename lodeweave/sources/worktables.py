"""Work tables in the folder that all machines of the cluster share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where it is unset on one machine (tests) a temporary one.

    On a cluster each executor would write to its own disk: there the setting is required.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="lodeweave-"))
        where = _own[0]
    return where.rstrip("/")


def application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lodeweave-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{application_folder(spark)}/{label}-{uuid.uuid4().hex}"


def drop_work_tables(spark: SparkSession) -> None:
    """Delete the work tables of this application; call it when no result that reads them is needed any more."""
    drop_path(spark, application_folder(spark))


def drop_path(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Work tables that are stored inside are dropped at the end, but for those taken out of the list it gives."""
    paths: list[str] = []
    mark = _scratch.set(paths)
    try:
        yield paths
    finally:
        _scratch.reset(mark)
        for path in paths:
            drop_path(spark, path)


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage, and Spark with it what only garbage still names: the broadcasts and shuffle files of steps that are done.

    Between the many short steps of a long job the driver's heap grows to its limit otherwise, and shuffle files stay.
    """
    gc.collect()
    spark._jvm.System.gc()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the table read back.

    Unlike ``checkpoint()`` this computes the plan once, keeps column pruning for later readers, and
    later stages never recompute the input when an executor is lost.
    """
    path = new_path(df.sparkSession, label)
    if (paths := _scratch.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
