"""Changes to tables: upserts, deletes, keys.

Each operator returns the new state of a table; tables that are kept and changed by batches are ``sources.runs.RunTable``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last write of each key wins, changes after the table; rows with a null in the key never meet and all stay."""
    both = table.withColumn("__side", F.lit(0)).unionByName(changes.withColumn("__side", F.lit(1)))
    null = F.greatest(*(F.col(k).isNull().cast("int") for k in keys)) if len(keys) > 1 else F.col(keys[0]).isNull().cast("int")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__side"), *(F.desc(c) for c in order)))
    return both.withColumn("__null", null).withColumn("__r", rank).where("__r = 1 OR __null = 1").drop("__side", "__null", "__r")


def insert_ignore(table: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first write of each key stays."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    fresh = new.join(table.select(*keys), keys, "left_anti").withColumn("__r", rank).where("__r = 1").drop("__r")
    return table.unionByName(fresh)


def delete_files(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Files and what hangs on them: symbols and chunks of the file, edges of its symbols; children of deleted symbols and chunks elsewhere lose their link. ``gone``: id of files."""
    by = lambda df, column: df.join(gone.select(F.col("id").alias(column)), column, "left_anti")
    files, symbols, chunks = by(tables["files"], "id"), by(tables["symbols"], "file_id"), by(tables["chunks"], "file_id")
    lost = tables["symbols"].join(gone.select(F.col("id").alias("file_id")), "file_id", "left_semi").select(F.col("id").alias("__lost"))
    clear = lambda df, c: df.join(lost, df[c] == F.col("__lost"), "left").withColumn(c, F.when(F.col("__lost").isNull(), F.col(c))).drop("__lost")
    edges = tables["edges"].join(lost.withColumnRenamed("__lost", "src"), "src", "left_anti").join(lost.withColumnRenamed("__lost", "dst"), "dst", "left_anti")
    return {"files": files, "symbols": clear(symbols, "parent_id"), "chunks": clear(chunks, "symbol_id"), "edges": edges}


def with_ids(rows: DataFrame, columns: list[str], first: int = 1) -> DataFrame:
    """Dense ids from ``first`` in the order of ``columns``, without one task holding all rows.

    Rows are range-partitioned; counts of the partitions, a row each, give every partition its first id.
    """
    from ..sources.worktables import stored

    parts = rows.repartitionByRange(*columns).sortWithinPartitions(*columns)
    parts = stored(parts.withColumn("__p", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("__p").agg(F.count("*").alias("n"))
    offsets = counts.select("__p", (F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + first - 1).alias("__o"))
    local = F.row_number().over(Window.partitionBy("__p").orderBy(*columns))
    return parts.withColumn("__n", local).join(F.broadcast(offsets), "__p").withColumn("id", F.col("__n") + F.col("__o")).drop("__p", "__n", "__o")


def working_memory(ops: DataFrame) -> DataFrame:
    """The state after a sequence of (ord, task_id, op, key, value): set, delete, and clear of a whole task."""
    cleared = ops.where("op = 'clear'").groupBy("task_id").agg(F.max("ord").alias("__clear"))
    last = ops.where("op <> 'clear'").groupBy("task_id", "key").agg(F.max_by(F.struct("op", "value", "ord"), "ord").alias("x"))
    live = last.join(cleared, "task_id", "left").where("x.op = 'set' AND (__clear IS NULL OR x.ord > __clear)")
    return live.select("task_id", "key", "x.value")
