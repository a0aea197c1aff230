"""How input is dealt to tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of a table's files that a task of a sort or join takes.
TASK_BYTES = 8 << 20
#: Bytes of text that a function sees at a time.
TEXT_BYTES = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small table of few files to all cores, for work that costs far more than the exchange.

    Larger tables come in splits enough and stay as they are: no shuffle at scale.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= cores * int(split):
        return df
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def tasks_for(df: DataFrame, each: int | None = None) -> int:
    """As many tasks as a table's bytes need, by Spark's estimate, and one a core at least: their memory stays the same where AQE would make tasks of 64 MB as compressed."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-size // (each or TASK_BYTES)))


def text_slices(batches: Iterable[pa.RecordBatch], column: int, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batches with at most ``most`` bytes in a text column, or one longer row: what Python makes of a slice is bounded, whatever Spark sends."""
    for batch in batches:
        sums = np.cumsum(np.concatenate([[0], pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)]))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(sums, sums[a] + most, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b
    pa.default_memory_pool().release_unused()
