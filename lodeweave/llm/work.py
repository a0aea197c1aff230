"""Shared helpers of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.partitions import spread
from ..sources.worktables import scratch, shared_folder, stored

__all__ = ["documents", "map_arrow", "scratch", "shared_folder", "stored"]

#: Rows that a function sees at a time. Spark bounds the bytes of what it sends (``arrow.maxBytesPerBatch``, 64 MB).
ARROW_ROWS = 512


def map_arrow(df: DataFrame, function: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over slices of at most ARROW_ROWS rows; no setting of the session changes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(b.slice(i, ARROW_ROWS) for b in batches for i in range(0, max(1, b.num_rows), ARROW_ROWS))
        pa.default_memory_pool().release_unused()  # workers wait for the next task, whatever that is

    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
