"""Keyed tables that are changed by batches: sorted runs of rows in buckets of their keys, and a log of which runs count.

A batch is written as one run, in proportion to its own rows. A commit is the atomic create of the log's next number, so of two
writers one comes second and goes on from the other's state; each entry holds the whole state, so readers take one entry and see whole
versions. Readers merge the runs, the newest row of a key first. Runs of like size are merged into one, so that there are
few of them and a row is rewritten a logarithmic number of times.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of like size that are merged into one.
FAN_IN = 4


class Run(NamedTuple):
    """A folder of rows; those of a higher rank are newer."""

    path: str
    rank: int
    bytes: int


class State(NamedTuple):
    version: int
    runs: list[Run]  # by rank
    writers: dict[str, int]  # the last batch of each named writer


class RunTable:
    """A table of ``schema`` with unique ``keys``. Rows with a null in the key never meet others: all stay.

    ``buckets``: by the keys' hash; look-ups read only those that they need. Of equal keys in a batch the greatest by ``order``
    counts (default: by all other columns).
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 16, order: list[str] | None = None):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.names
        self.order = order or [c for c in self.columns if c not in keys]
        self._jvm = spark._jvm

    # the log

    def _hadoop(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> State:
        """The last whole state."""
        where, fs = self._hadoop(f"{self.path}/log")
        numbers = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        numbers = [n for n in numbers if n.endswith(".json")]
        if not numbers:
            return State(0, [], {})
        entry = fs.open(self._hadoop(f"{self.path}/log/{max(numbers)}")[0])
        raw = json.loads(bytes(entry.readAllBytes()))
        entry.close()
        return State(raw["version"], [Run(*r) for r in raw["runs"]], raw["writers"])

    def _commit(self, state: State) -> bool:
        """Create the state's entry; false if another writer has made that version."""
        name = f"{self.path}/log/{state.version:020d}.json"
        target, fs = self._hadoop(name)
        whole, _ = self._hadoop(f"{self.path}/log/.{uuid.uuid4().hex}")
        fs.mkdirs(target.getParent())
        out = fs.create(whole, False)
        out.write(bytearray(json.dumps({"version": state.version, "runs": state.runs, "writers": state.writers}).encode()))
        out.close()
        try:
            if fs.getScheme() == "file":  # a rename would overwrite there
                at = lambda p: self._jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0))
                self._jvm.java.nio.file.Files.createLink(at(target), at(whole))
                fs.delete(whole, False)
                return True
            return fs.rename(whole, target)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            fs.delete(whole, False)
            return False

    # runs

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _has_key(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in self.keys])

    def _new_run(self, rows: DataFrame, rank: int) -> Run:
        """Rows with ``__gone`` as a run."""
        path = f"{self.path}/runs/{uuid.uuid4().hex}"
        rows = rows.withColumn("__bucket", self.bucket()).repartition("__bucket").sortWithinPartitions("__bucket", *self.keys)
        rows.write.partitionBy("__bucket").parquet(path)
        where, fs = self._hadoop(path)
        return Run(path, rank, fs.getContentSummary(where).getLength())

    def _rows(self, runs: list[Run], buckets: list[int] | None = None) -> DataFrame:
        """The newest row of each key, deleted ones with ``__gone``, and all rows without a key."""
        columns = [*self.columns, "__gone"]
        typed = self.spark.createDataFrame([], self.schema).withColumns({"__gone": F.lit(False), "__bucket": F.lit(0)}).schema
        each = [self.spark.read.schema(typed).parquet(r.path).withColumn("__rank", F.lit(r.rank)) for r in runs]
        rows = reduce(DataFrame.unionByName, each)
        if buckets is not None:
            rows = rows.where(F.col("__bucket").isin(buckets))
        if len(runs) == 1:
            return rows.select(columns)
        newest = rows.where(self._has_key()).groupBy(*self.keys).agg(F.max_by(F.struct(*columns), "__rank").alias("x")).select("x.*")
        return newest.unionByName(rows.where(~self._has_key()).select(columns))

    def read(self, version: State | None = None, keys: DataFrame | None = None) -> DataFrame:
        """Live rows; with ``keys`` only those of the buckets that hold such keys (a superset of their rows)."""
        state = version or self.current()
        if not state.runs:
            return self.spark.createDataFrame([], self.schema)
        buckets = [r[0] for r in keys.select(self.bucket()).distinct().collect()] if keys is not None else None  # at most ``buckets`` rows
        return self._rows(state.runs, buckets).where("NOT __gone").select(self.columns)

    # changes

    def _last_of_each(self, puts: DataFrame) -> DataFrame:
        puts = puts.select(self.columns)
        last = puts.where(self._has_key()).groupBy(*self.keys).agg(F.max_by(F.struct(*self.columns), F.struct(*self.order)).alias("x")).select("x.*")
        return last.unionByName(puts.where(~self._has_key()))

    def write(self, puts: DataFrame, deletes: DataFrame | None = None, writer: tuple[str, int] | None = None) -> int:
        """Put rows, after deleting those of the keys in ``deletes``; the version that holds them. A put wins over a delete of its key.

        ``writer``: a name and the number of its batch. A batch that comes again, or a batch without rows, changes nothing.
        """
        state = self.current()
        if writer and state.writers.get(writer[0], -1) >= writer[1]:
            return state.version
        rows = self._last_of_each(puts).withColumn("__gone", F.lit(False))
        if deletes is not None:
            gone = deletes.select(*self.keys).where(self._has_key()).distinct().join(rows.select(*self.keys), self.keys, "left_anti")
            rows = rows.unionByName(gone.withColumn("__gone", F.lit(True)), allowMissingColumns=True)
        run = self._new_run(rows, 0)
        if not (run.bytes or writer):
            return state.version
        while True:
            writers = state.writers | ({writer[0]: writer[1]} if writer else {})
            new = State(state.version + 1, state.runs + [run._replace(rank=state.version + 1)] * bool(run.bytes), writers)
            if self._commit(new):
                return new.version
            state = self.current()
            if writer and state.writers.get(writer[0], -1) >= writer[1]:
                return state.version

    def insert_ignore(self, rows: DataFrame, writer: tuple[str, int] | None = None) -> int:
        """Put rows whose keys are not held, of equal ones the least by ``order``; those that another writer was faster with are left out."""
        least = rows.select(self.columns).where(self._has_key()).groupBy(*self.keys).agg(F.min_by(F.struct(*self.columns), F.struct(*self.order)).alias("x")).select("x.*")
        keyless = rows.select(self.columns).where(~self._has_key())
        while True:
            state = self.current()
            if writer and state.writers.get(writer[0], -1) >= writer[1]:
                return state.version
            fresh = least.join(self.read(state, least).select(*self.keys), self.keys, "left_anti") if state.runs else least
            run = self._new_run(fresh.unionByName(keyless).withColumn("__gone", F.lit(False)), state.version + 1)
            writers = state.writers | ({writer[0]: writer[1]} if writer else {})
            if self._commit(State(state.version + 1, [*state.runs, run], writers)):
                return state.version + 1

    def compact(self, fan_in: int = FAN_IN) -> int:
        """Merge the newest runs into one where ``fan_in`` or more are of like size: each at most ``fan_in`` times the newer ones together. The version after it.

        Rows that others put meanwhile are newer than the merged ones, whatever comes first. Deleted rows go when the oldest run is among the merged.
        """
        state = self.current()
        newest, held = [], 0
        for run in reversed(state.runs):
            if held and run.bytes > fan_in * held:
                break
            newest.append(run)
            held += run.bytes
        if len(newest) < fan_in:
            return state.version
        rows = self._rows(newest)
        if len(newest) == len(state.runs):
            rows = rows.where("NOT __gone")
        run = self._new_run(rows, newest[0].rank)
        merged = {r.path for r in newest}
        while True:
            if not merged <= {r.path for r in state.runs}:
                return state.version  # another writer has merged them
            runs = sorted([r for r in state.runs if r.path not in merged] + [run], key=lambda r: r.rank)
            if self._commit(State(state.version + 1, runs, state.writers)):
                return state.version + 1
            state = self.current()
