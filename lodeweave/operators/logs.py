"""Application logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


#: Lines of a log that one task puts in order.
BLOCK_LINES = 10_000


def parse_lines(lines: DataFrame, log: str, line: str = "line", raw: str = "raw", block_lines: int = BLOCK_LINES) -> DataFrame:
    """Entries of logs given as numbered lines: ``log``, ``line``, ``level``, ``message``, ``timestamp``, ``raw``, ``stack``.

    Terminal escapes go, blank lines too. Indented ``at`` lines belong to the entry before; at the very top of a
    log one is an entry of its own. Logs are cut into blocks of lines: a block's first lines take the entry that is open at the end of
    the blocks before, so that one huge log is many tasks.
    """
    rows = lines.select(log, line, X.strip_ansi(F.col(raw)).alias("raw")).where(F.trim("raw") != "").withColumn("__block", F.floor(F.col(line) / block_lines))
    rows = rows.withColumn("__head", ~F.col("raw").rlike(r"^\s+at "))
    last = F.max(F.when(F.col("__head"), F.col(line)))
    blocks = rows.groupBy(F.col(log).alias("__log"), F.col("__block").alias("__b")).agg(last.alias("last"), F.min(line).alias("first"))
    before = Window.partitionBy("__log").orderBy("__b")
    blocks = blocks.select("__log", "__b", F.coalesce(F.max("last").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.min("first").over(before)).alias("__open"))
    inside = Window.partitionBy(log, "__block").orderBy(line)
    rows = rows.withColumn("__entry", last.over(inside)).join(blocks, F.col(log).eqNullSafe(F.col("__log")) & (F.col("__block") == F.col("__b")))
    rows = rows.withColumn("__entry", F.coalesce("__entry", "__open"))
    frame = F.when(F.col(line) != F.col("__entry"), F.struct(F.col(line).alias("n"), X.stack_frame(F.col("raw")).alias("f")))
    out = rows.groupBy(log, "__entry").agg(F.min_by("raw", line).alias("raw"), F.array_sort(F.collect_list(frame)).alias("stack")).withColumnRenamed("__entry", line)
    return out.select(log, line, X.log_level(F.col("raw")).alias("level"), F.trim("raw").alias("message"), X.iso_time(F.col("raw")).alias("timestamp"), "raw", F.transform("stack", lambda x: x["f"]).alias("stack"))
