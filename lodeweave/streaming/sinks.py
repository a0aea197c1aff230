"""Micro-batch sinks: run to the end of what is there, append once, tail, diff, upsert, follow a configuration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import change_diff
from ..sources.runs import RunTable
from ..sources.worktables import new_path


def drain(stream: DataFrame, label: str = "stream") -> DataFrame:
    """Run a stream over all that its source holds now and return the rows as a table; a restart with the same folder goes on where it stopped."""
    path = new_path(stream.sparkSession, label)
    stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def each_batch(stream: DataFrame, function: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Call ``function`` for every micro-batch, one at a time: the only writer of what it writes. After a failure a batch comes again with its number."""
    stream.writeStream.foreachBatch(function).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer into a folder of the batch's number: a repeated batch replaces itself."""
    return lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")


def tail(path: str, order: str, keep: int = 1) -> Callable[[DataFrame, int], None]:
    """The last rows of every batch; a burst gives one."""
    return lambda batch, n: batch.orderBy(F.desc(order)).limit(keep).write.mode("overwrite").parquet(f"{path}/batch={n}")


def diff_with_last(snapshots: RunTable, changes_path: str, name: str = "poll") -> Callable[[DataFrame, int], None]:
    """Each batch is a whole snapshot (path, hash): write how it differs from the last, then keep what changed. A repeated batch changes nothing."""

    def run(batch: DataFrame, n: int) -> None:
        held = snapshots.current()
        if held.writers.get(name, -1) >= n:
            return
        snapshot = batch.select("path", "hash")
        path = f"{changes_path}/batch={n}"
        change_diff(snapshots.read(held), snapshot).write.mode("overwrite").parquet(path)
        changes = batch.sparkSession.read.parquet(path)
        puts = snapshot.join(changes.where("change <> 'removed'"), "path", "left_semi")
        snapshots.write(puts, changes.where("change = 'removed'"), (name, n))
        snapshots.compact()

    return run


def upsert_changed(table: RunTable, value: str = "hash", name: str = "upsert") -> Callable[[DataFrame, int], None]:
    """Rows whose hash is new replace those of their key; equal ones are skipped. Running a batch again changes nothing.

    A batch reads the buckets of its keys and writes its own rows, not the table.
    """

    def run(batch: DataFrame, n: int) -> None:
        held = table.current()
        if held.writers.get(name, -1) >= n:
            return
        new = batch.join(table.read(held, batch).select(*table.keys, value), [*table.keys, value], "left_anti")
        table.write(new, writer=(name, n))
        table.compact()

    return run


def with_config(read: Callable[[SparkSession], dict], function: Callable[[DataFrame, int, dict], None]) -> Callable[[DataFrame, int], None]:
    """Read the configuration anew for each batch."""
    return lambda batch, n: function(batch, n, read(batch.sparkSession))


def after_mark(rows: DataFrame, mark: int, column: str = "created_at") -> tuple[DataFrame, int]:
    """Rows strictly after a mark and the next mark. Rows that come later with the mark's own time are missed; a file stream with a checkpoint misses none."""
    new = rows.where(F.col(column) > mark)
    return new, new.agg(F.coalesce(F.max(column), F.lit(mark))).first()[0]
