"""Streams in order of event time against the batch form, for files in any order."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import sequences as S
from lodeweave.streaming import timed

SCHEMA = "provider string, at timestamp, id bigint, failed boolean"
START = datetime.datetime(2024, 1, 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_files_in_any_order(spark, tmp_path, seed):
    draw = random.Random(seed)
    rows = [(draw.choice("ab"), START + datetime.timedelta(seconds=draw.randrange(600)), i, draw.random() < 0.7) for i in range(120)]
    for n in range(4):  # files mix all times
        spark.createDataFrame(rows[n::4], SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/in/f={n}")
    spark.createDataFrame([("a", None, 500, True)], SCHEMA).write.parquet(f"file://{tmp_path}/in/f=9")
    calls = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    out = timed.breaker_in_order(calls, "1 hour", threshold=2, reset_ms=20_000)
    end = spark.createDataFrame([("z", START + datetime.timedelta(days=9), -1, False)], SCHEMA)
    got = timed.drain_closed(out, lambda: end.write.parquet(f"file://{tmp_path}/in/f=end"), f"file://{tmp_path}/out").where("id >= 0")
    batch = spark.createDataFrame(rows, SCHEMA).withColumn("t", F.unix_millis("at"))
    want = S.breaker_open(batch, "provider", "t", "id", "failed", threshold=2, reset_ms=20_000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("provider", "id", "open").collect()))
    assert {r.open for r in got.collect()} == {True, False}
    assert spark.conf.get(timed.PROVIDER, None) != timed.ROCKSDB


def test_fold_keeps_two_numbers():
    fold = timed.breaker_fold(3, 10)
    kept, seen = None, []
    for ms, failed in enumerate([True, True, True, True, False, True]):
        kept, out = fold(kept, (ms, ms, failed))
        seen += out
        assert len(kept) == 2
    assert [o for _, o in seen] == [False, False, False, True, True, False]
