"""Packing: optimal length buckets and token-budget batches.

A dynamic program over the global length histogram (at most ``max_length`` + 1 rows) chooses the bucket
bounds with the least padding. Inside a bucket, sequences take consecutive ranks and a batch is a run of
``budget // bound`` ranks. Ranks are distributed: counts of (bucket, shard) give each shard its first
rank, so no task orders a whole bucket and only the last batch of a bucket can be short.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .work import documents, stored

WORD = r"[^\x20\x09-\x0D]+"
#: The offsets table has at most buckets * MAX_SHARDS rows of 16 bytes, small enough to broadcast at any input size.
MAX_SHARDS = 65_536
SHARD_ROWS = 256


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def best_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total of bound * count."""
    order = np.argsort(lengths)
    x = np.asarray(lengths, dtype=np.float64)[order]
    c = np.concatenate([[0.0], np.cumsum(np.asarray(counts, dtype=np.float64)[order])])
    n, k = len(x), min(buckets, len(x))
    if not n:
        return []
    cost, came = np.full(n + 1, np.inf), []
    cost[0] = 0.0
    for _ in range(k):
        new, back = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        for j in range(1, n + 1):
            at = cost[:j] + x[j - 1] * (c[j] - c[:j])
            back[j] = at.argmin()
            new[j] = at[back[j]]
        cost = new
        came.append(back)
    out, j = [], n
    for back in reversed(came):
        out.append(int(x[j - 1]))
        j = int(back[j])
    return out[::-1]


def pack(df: DataFrame, length: Column, id_col: str = "doc_id", buckets: int = 8, max_length: int = 2048, budget: int = 65_536) -> DataFrame:
    """One row per sequence: ``id_col``, ``piece``, ``start``, ``length``, ``bucket`` (from 0), ``bound``, ``batch`` (from 0 in its bucket), ``slot``, ``padding``.

    A row longer than ``max_length`` gives consecutive pieces of ``max_length`` and a rest; every other
    row gives one piece, of length 0 for an empty or null text. Nothing is dropped; repeated rows and null ids are sequences of
    their own. A batch holds at most ``budget // bound`` sequences (one at least), so bound * sequences
    stays within the budget unless one bound alone exceeds it. An empty table gives an empty result. Other columns are ignored.
    """
    rows = stored(df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"), length.cast("long").alias("n")), "lengths")
    last = F.greatest(F.lit(0), F.expr(f"(n - 1) div {max_length}")).cast("int")
    cut = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).withColumn("start", F.col("piece").cast("long") * max_length)
    cut = cut.withColumn("length", F.least(F.lit(max_length).cast("long"), F.col("n") - F.col("start")))
    seen = cut.groupBy("length").count().collect()  # at most max_length + 1 rows
    bounds = best_bounds([r["length"] for r in seen], [r["count"] for r in seen], buckets) or [max_length]
    held = [sum(r["count"] for r in seen if lo < r["length"] <= hi) for lo, hi in zip([-1, *bounds], bounds, strict=False)]

    def by_bucket(values: list[int], kind: str) -> Column:
        out = F.lit(values[-1])
        for bound, value in reversed(list(zip(bounds[:-1], values[:-1], strict=True))):
            out = F.when(F.col("length") <= bound, F.lit(value)).otherwise(out)
        return out.cast(kind)

    shards = [max(1, min(MAX_SHARDS, n // SHARD_ROWS)) for n in held]
    cut = cut.withColumn("bucket", by_bucket(list(range(len(bounds))), "int")).withColumn("bound", by_bucket(bounds, "long"))
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("uid", "piece"), by_bucket(shards, "long")).cast("int"))
    sizes = cut.groupBy("bucket", "shard").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("bucket", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("uid", "piece")) - 1)
    ranked = ranked.join(F.broadcast(firsts), ["bucket", "shard"]).withColumn("rank", F.col("rank") + F.col("first"))
    fits = F.greatest(F.lit(1).cast("long"), F.expr(f"{budget} div greatest(bound, 1)"))
    return ranked.withColumn("fits", fits).select(
        F.col("id").alias(id_col), "piece", "start", "length", "bucket", "bound",
        F.expr("rank div fits").alias("batch"), F.expr("rank % fits").alias("slot"), (F.col("bound") - F.col("length")).alias("padding"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words in optimal length buckets and batches of 65,536 words."""
    return pack(documents(spark, sf_dir), word_count(F.col("text")))
