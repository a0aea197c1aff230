"""Scans in blocks against windows, on keys that hold everything and on many small ones."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeweave.operators import scans
from lodeweave.operators import sequences as S


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(4)
    data = [(draw.choice(["hot"] * 8 + ["a", "b", None]), draw.randrange(400), i, draw.choice([None, 1, 2, 30])) for i in range(3_000)]
    return spark.createDataFrame(data, "k string, t long, i long, v long").cache()


def plain(rows, itself, ties):
    w = Window.partitionBy("k").orderBy("t", *([] if ties else ["i"]))
    w = w if ties else w.rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    return rows.select("k", "i", F.sum("v").over(w).alias("sum"), F.max("v").over(w).alias("max"), F.min("v").over(w).alias("min"), F.last("v", True).over(w).alias("last"))


@pytest.mark.parametrize("itself, ties", [(True, False), (False, False), (True, True)])
def test_running_values(rows, itself, ties):
    order = [F.col("t")] if ties else [F.col("t"), F.col("i")]
    kinds = {"sum": scans.SUM, "max": scans.MAX, "min": scans.MIN} | ({} if ties else {"last": scans.LAST})
    blocks = scans.in_blocks(rows, "k", order, 8)
    got = scans.running(blocks, "k", order, {n: (r, F.col("v")) for n, r in kinds.items()}, itself, ties).select("k", "i", *kinds)
    want = plain(rows, itself, ties).select("k", "i", *kinds)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert blocks.where("k = 'hot'").select(scans.BLOCK).distinct().count() > 1  # a key is many tasks
    assert scans.running(scans.in_blocks(rows.where("false"), "k", order), "k", order, {"sum": (scans.SUM, F.col("v"))}).collect() == []


def test_no_task_holds_a_hot_key(spark, rows):
    """The rows of one key with everything stand in blocks of about the same size, and no window of the plan is over the key alone but that of the summaries."""
    hot = rows.withColumn("k", F.lit("one"))
    blocks = scans.in_blocks(hot, "k", [F.col("i")], 8)
    sizes = [r["count"] for r in blocks.groupBy(scans.BLOCK).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 2 * sum(sizes) / len(sizes)
    ends = scans.running(blocks, "k", [F.col("i")], {"sum": (scans.SUM, F.col("v"))})
    plan = ends._jdf.queryExecution().optimizedPlan().toString()
    assert "BroadcastHint" in plan or "strategy=broadcast" in plan


def test_breaker_and_cache_in_blocks(spark, rows, monkeypatch):
    whole = scans.in_blocks
    monkeypatch.setattr(S, "in_blocks", lambda *a: whole(*a, 7))
    calls = rows.where("k IS NOT NULL").withColumn("failed", F.col("v") > 1)
    w = Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, -1)
    streak = calls.withColumn("s", F.coalesce(F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w), F.lit(0)))
    fails = F.coalesce(F.count_if("failed").over(Window.partitionBy("k", "s").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.max(F.when(F.col("failed"), F.col("t"))).over(w)
    want = streak.select("i", F.coalesce((fails >= 2) & (F.col("t") - last <= 3), F.lit(False)).alias("open"))
    got = S.breaker_open(calls, "k", "t", "i", "failed", threshold=2, reset_ms=3).select("i", "open")
    assert got.exceptAll(want).isEmpty() and got.count() == calls.count() and got.where("open").count() > 10
    items = calls.select("k", "i", F.coalesce("v", F.lit(0)).alias("tokens"))
    down = Window.partitionBy("k").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    hot = items.select("i", ((F.col("tokens") <= 20) & (F.sum(F.when(F.col("tokens") <= 20, F.col("tokens")).otherwise(0)).over(down) <= 20)).alias("hot"))
    assert S.fifo_hot(items, 20, "k", "i").select("i", "hot").exceptAll(hot).isEmpty()
