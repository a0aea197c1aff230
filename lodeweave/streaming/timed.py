"""Stateful streams in order of event time: a row waits until the watermark has passed it, so files that come late change nothing.

Waiting rows are a list variable of the key, appended to without being read, and what the fold keeps is a value variable. A timer of the
key fires when the watermark reaches its rows: those are folded in order, the others wait on. State is in RocksDB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Of the fold: what is kept of a key so far (None at first) and a row's values give what is kept now and the rows to emit.
Fold = Callable[[tuple | None, tuple], tuple[tuple, list[tuple]]]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which these need; the session's setting comes back after it."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class InOrder(StatefulProcessor):
    """Holds a key's rows (``ms`` first) until the watermark and folds them in order."""

    def __init__(self, fold: Fold, columns: list[str], waiting: str, kept: str, emitted: list[str]):
        self.fold, self.columns, self.schemas, self.emitted = fold, columns, (waiting, kept), emitted

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schemas[0])
        self.kept = handle.getValueState("kept", self.schemas[1])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [r for frame in rows for r in frame[self.columns].astype(object).itertuples(index=False, name=None)]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(max(r[0] for r in new))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()]
        left = [r for r in rows if r[0] > mark]
        self.waiting.clear()
        if left:
            self.waiting.put(left)  # a later timer is set for them
        kept, out = tuple(self.kept.get()) if self.kept.exists() else None, []
        for row in sorted(r for r in rows if r[0] <= mark):
            kept, new = self.fold(kept, row)
            out += [(key[0], *x) for x in new]
        if kept is not None:
            self.kept.update(kept)
        yield pd.DataFrame(out, columns=self.emitted)

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, per: str, at: str, columns: list[str], fold: Fold, kept: str, emits: str, delay: str) -> DataFrame:
    """``per`` and ``emits`` of a fold over each key's rows in order of (``at``, ``columns``), whatever the order in which they come.

    A row is folded when the watermark, ``delay`` behind the latest time, has passed it; one that comes later than that is dropped. Values of
    ``columns`` are given to the fold after the time in milliseconds; they must not be null. Rows of null time are left out.
    """
    rows = stream.where(F.col(at).isNotNull()).select(per, at, F.unix_millis(at).alias("ms"), *columns).withWatermark(at, delay)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = ["ms", *columns]
    waiting = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    output = f"`{per}` {kinds[per]}, {emits}"
    emitted = [per, *(e.split()[0] for e in emits.split(","))]
    return rows.groupBy(per).transformWithStateInPandas(InOrder(fold, names, waiting, kept, emitted), output, "append", "EventTime")


def breaker_fold(threshold: int, reset_ms: int) -> Fold:
    """Rows of (ms, id, failed): whether the breaker blocks at each. Kept: failures in a row, the time of the last."""

    def fold(kept: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        fails, last = kept or (0, -1)
        ms, number, failed = row
        blocks = bool(fails >= threshold and ms - last <= reset_ms)
        return ((fails + 1, ms) if failed else (0, last)), [(number, blocks)]

    return fold


def breaker_in_order(calls: DataFrame, delay: str, threshold: int = 3, reset_ms: int = 30_000) -> DataFrame:
    """(provider, id, open) for a stream of (provider, at, id, failed), in order of event time: the batch form's rows for any order of the files."""
    return in_order(calls, "provider", "at", ["id", "failed"], breaker_fold(threshold, reset_ms), "fails bigint, last bigint", "id bigint, open boolean", delay)


def drain_closed(stream: DataFrame, closing: Callable[[], None], folder: str) -> DataFrame:
    """Run a stream over all that its sources hold, then ``closing``, which adds rows beyond all times to a source, and run on: no row waits any more."""
    spark = stream.sparkSession
    with rocksdb(spark):
        for step in (lambda: None, closing):
            step()
            stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
