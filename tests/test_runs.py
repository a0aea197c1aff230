"""Kept tables: runs, their log and their merge against a dictionary."""

import random
import threading

import pytest

from lodeweave.sources.runs import RunTable
from lodeweave.streaming import sinks

SCHEMA = "k string, n int, v string"


def rows_of(table, *a):
    return sorted((tuple(r) for r in table.read(*a).collect()), key=repr)


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_against_a_dictionary(spark, tmp_path, seed):
    draw = random.Random(seed)
    table, want, keyless = RunTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], buckets=4), {}, []
    assert rows_of(table) == [] and table.compact() == 0
    states = []
    for step in range(6):
        rows = [(draw.choice("abcdefgh"), draw.randrange(9), str(step)) for _ in range(draw.randrange(5))] + [(None, step, "x")] * draw.randrange(2)
        if step % 3 == 1:
            table.insert_ignore(batch(spark, rows))
            want = {r[0]: r for r in sorted(rows, key=repr, reverse=True) if r[0]} | want
        else:
            gone = draw.sample("abcdefgh", 2)
            table.write(batch(spark, rows), spark.createDataFrame([(g,) for g in gone] + [(None,)], "k string"))
            want = {k: r for k, r in want.items() if k not in gone} | {r[0]: r for r in sorted(r for r in rows if r[0])}
        keyless += [r for r in rows if r[0] is None]
        if step == 4:
            runs = len(table.current().runs)
            table.compact()
            assert len(table.current().runs) < runs
        states.append((table.current(), sorted([*want.values(), *keyless], key=repr)))
    for state, rows in states:  # every version as it was, also after the merge
        assert rows_of(table, state) == rows
    found = {tuple(r) for r in table.read(keys=batch(spark, [("a", 0, "")])).collect() if r.k == "a"}
    assert found == {want[k] for k in want if k == "a"}


def test_two_writers_lose_nothing(spark, tmp_path):
    """Both begin from one state; the second to commit goes on from the first's."""
    path = f"file://{tmp_path}/t"
    errors = []

    def run(name):
        try:
            mine = RunTable(spark, path, SCHEMA, ["k"], buckets=2)
            for i in range(4):
                mine.write(batch(spark, [(f"{name}{i}", i, name)]), writer=(name, i))
            if name == "a":
                mine.compact(2)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=run, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    table = RunTable(spark, path, SCHEMA, ["k"], buckets=2)
    assert not errors and rows_of(table) == sorted((f"{n}{i}", i, n) for n in "ab" for i in range(4))
    assert table.current().version == 9 and table.current().writers == {"a": 3, "b": 3}


def test_a_version_is_made_once(spark, tmp_path):
    table = RunTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"])
    state = table.current()._replace(version=1)
    assert table._commit(state) and not table._commit(state._replace(writers={"late": 1}))
    assert table.current() == state


def test_repeated_batches(spark, tmp_path):
    table = RunTable(spark, f"file://{tmp_path}/t", "path string, hash string", ["path"])
    write = sinks.upsert_changed(table)
    one = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2")], "path string, hash string")
    write(one, 0)
    before = table.current()
    write(one, 0)
    assert table.current() == before and rows_of(table) == [("a", "1"), ("b", "2")]
    write(one.where("path = 'a'"), 1)  # nothing new: no run
    assert table.current().runs == before.runs
    polls = sinks.diff_with_last(RunTable(spark, f"file://{tmp_path}/s", "path string, hash string", ["path"]), f"file://{tmp_path}/changes")
    for n, snapshot in ((1, one.where("hash = '1'")), (2, one.where("path = 'a'")), (2, one.where("path = 'a'"))):
        polls(snapshot, n)
    changes = lambda n: sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/changes/batch={n}").collect()))
    assert changes(1) == [("a", "added"), ("b", "added")] and changes(2) == [("b", "removed")]


def test_a_batch_costs_its_own_rows(spark, tmp_path):
    table = RunTable(spark, f"file://{tmp_path}/t", "id bigint, v string", ["id"])
    table.write(spark.range(200_000).selectExpr("id", "md5(cast(id AS string)) AS v"))
    table.write(spark.range(20).selectExpr("id * 1000 AS id", "'new' AS v"))
    large, small = table.current().runs
    assert small.bytes * 50 < large.bytes
    assert table.compact(2) == 2  # a small run is not worth the large one
    assert table.read().where("v = 'new'").count() == 20 and table.read().count() == 200_000
    plan = table.read(keys=spark.range(1))._jdf.queryExecution().executedPlan().toString()
    assert "__bucket" in plan and "PartitionFilters" in plan
