"""What a task, a worker and the driver hold does not grow with the tables."""

import duckdb
import pyarrow as pa
import pytest

from lodeweave import plans
from lodeweave.operators import code as C
from lodeweave.operators import indexing as I
from lodeweave.operators import structure
from lodeweave.sources import partitions

TEXTS = [
    "The 32nd day\nAnd 4486733645976649 again",
    "a `quote\nThe lost one\nof` three /* lines\nAnd another\n*/ The end",
    "class {\nThe inner (\nfunction plain() {}\nAnd }",
    "The function\nThe été\nAnd  The separator\r\nThe\u0085The line\n\nThe\nAnd",
    "",
    None,
]


def test_table_function_reads_any_text(spark, tmp_path):
    """Names that begin with a digit; quotes, comments and brackets across lines; line ends that only Java knows."""
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in plans.QUERIES["e3_table_function"](spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(c.execute(plans.SQL["e3_table_function"]).fetchall())
    assert len(got) == 6


def test_slices_of_texts():
    """Slices hold every row once, in order, and no more text than they may; a longer row stands alone."""
    texts = ["a" * n for n in (10, 90, 1, 500, 0, 99, 1)] + [None, "é" * 50]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "code"])
    parts = list(partitions.text_slices([batch.slice(0, 4), batch.slice(4)], 1, 100))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len((x or "").encode()) for x in p.column(1).to_pylist()) <= 100 for p in parts)


@pytest.mark.parametrize("work", [lambda f: C.split_code(f), C.extract_symbols, C.extract_edges])
def test_workers_give_small_batches(spark, work):
    """16 MB of text in one Arrow batch come out in several: a worker never holds what it makes of all of them."""
    one = "function a() { b(); }\n" * 1500
    files = spark.createDataFrame([(i, one, "typescript", "f") for i in range(500)], "id long, code string, lang string, stem string")
    batches = work(files.coalesce(1)).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([len(set(b.column(0).to_pylist()))])], names=["n"]) for b in bs if b.num_rows), "n long")
    assert max(r.n for r in batches.collect()) <= 1 + partitions.TEXT_BYTES // len(one)


def test_scan_takes_linear_time_on_words():
    """Little more than what a regex alone takes to step over the same tokens one by one: 1.5 times as much here, 3.1 before the fast path."""
    import re
    import time

    code = "function f(a) { return a + b * 3 - g(a, \"some words in a string\"); } // and a comment\n" * 6000
    every = re.compile(r"(?:\s+|//[^\n]*)*+(?:(\w+)|(\"[^\"]*\")|([\s\S]))")

    def took(work):
        began = time.process_time()
        work()
        return time.process_time() - began

    bare = min(took(lambda: [(m.lastindex, m[m.lastindex], m.start(m.lastindex), m.end()) for m in every.finditer(code) if m.lastindex]) for _ in range(3))
    assert min(took(lambda: structure.tokens(code, "typescript")) for _ in range(3)) < 2.3 * bare


@pytest.mark.parametrize("name", ["w5_parallel_groups", "w6_file_conflicts"])
def test_plans_are_dealt_by_bytes(spark, small, monkeypatch, name):
    monkeypatch.setattr(partitions, "TASK_BYTES", 4 << 10)
    assert plans.QUERIES[name](spark, small).rdd.getNumPartitions() >= 20


def test_index_plans_stay_small(spark, monkeypatch):
    """No step of an index hands the driver more than a few joins at once."""
    from lodeweave.operators import joins

    sizes = []

    def seen(df, label):
        sizes.append(str(df._jdf.queryExecution().optimizedPlan().toString()).count("Join "))
        return real(df, label)

    real = I.stored
    monkeypatch.setattr(I, "stored", seen)
    files = spark.createDataFrame([("a.ts", "function alpha() { beta(); gama(); }\n", "typescript", "a"), ("b.ts", "function beta() {}\nfunction gamma() { alpha(); }\n", "typescript", "b")], "path string, code string, lang string, stem string")
    index = I.index_files(files.where("path = 'a.ts'"), I.empty_index(spark))
    index = I.index_files(files, index)
    assert sorted(r.strategy for r in index["references"].collect()) == ["fuzzy", "import_resolved", "import_resolved"]
    assert max(sizes) <= 6 and joins.resolve_edges


def test_facts_come_from_one_pass(spark):
    """Of equal names in a file the last, and every edge from a symbol once; what two passes and their joins gave before."""
    code = "import { x } from './x';\nfunction twice() { a(); a(); }\nclass C extends B { m() { a(); } }\nfunction twice() { b(); }\n"
    files = spark.createDataFrame([(1, code, "typescript", "f"), (2, "def one():\n    two()\n", "python", "g"), (3, None, None, None)], "id long, code string, lang string, stem string")
    facts = C.extract_facts(files).collect()
    symbols = {}
    for r in sorted(C.extract_symbols(files).collect(), key=lambda r: r.start):
        symbols[r.id, r.qualified_name] = tuple(r)
    names = ["id", "kind", "name", "qualified_name", "parent", "start", "end", "start_line", "end_line"]
    assert sorted(tuple(r[n] for n in names) for r in facts if r.qualified_name) == sorted(symbols.values(), key=lambda x: (x[0], x[1]))
    edges = {(r.id, r.src_qn, r.dst_qn, r.kind, r.confidence) for r in C.extract_edges(files).collect() if (r.id, r.src_qn) in symbols}
    got = [(r.id, r.src_qn, r.dst_qn, r.kind, r.confidence) for r in facts if r.src_qn]
    assert set(got) == edges and len(got) == len(edges) > 3


def test_names_with_other_beginnings_make_no_keys(spark):
    """Names meet by their beginnings before they become hundreds of keys, and no pair is lost by it."""
    import random

    from lodeweave.operators import joins
    from lodeweave.sources.worktables import stored

    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abé_1") for _ in range(draw.choice([0, 1, 2, 3, 4, 5, 6, 9, 23, 27])))
    sides = [{word() for _ in range(150)} | {f"{p}777{i}" for i in range(50)} for p in ("absent_", "fn")]
    frames = [spark.createDataFrame([(x,) for x in sorted(s)], f"{c} string") for s, c in zip(sides, "wn", strict=True)]
    w, n = stored(frames[0], "w"), stored(frames[1], "n")
    left = [{r[0] for r in df.collect()} for df in joins.with_shared_heads(w, n, "w", "n", 2, stored)]
    assert not any(x.startswith("absent_") for x in left[0]) and not any(x.startswith("fn") for x in left[1])
    plain = {tuple(r) for r in joins.near_names(w, n, "w", "n", 2).collect()}
    assert {tuple(r) for r in joins.near_names(w, n, "w", "n", 2, stored).collect()} == plain and len(plain) > 100


def test_index_gives_back_what_its_steps_took(spark):
    """After a batch the driver knows next to no shuffle of its steps, and of their tables only the index is left."""
    import os
    import time

    from lodeweave.sources import worktables

    shuffles = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    folder = worktables.application_folder(spark).removeprefix("file://")
    spark._jvm.System.gc()
    time.sleep(2)
    tables, before = set(os.listdir(folder)) if os.path.isdir(folder) else set(), shuffles()
    files = spark.createDataFrame([("a.ts", "function alpha() { beta(); gama(); }\n", "typescript", "a"), ("b.ts", "function beta() {}\nfunction gamma() { alpha(); }\n", "typescript", "b")], "path string, code string, lang string, stem string")
    index = I.index_files(files, I.empty_index(spark))
    until = time.time() + 20
    while shuffles() > before + 8 and time.time() < until:
        time.sleep(0.5)
    assert shuffles() <= before + 8
    assert sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - tables) == sorted(index)


def test_index_joins_stay_off_the_driver(spark, monkeypatch):
    """The driver builds no broadcast of a table that grows with the files, whatever Spark guesses of its size."""
    plans_of = {}

    def seen(df, label):
        plans_of[label] = plans_of.get(label, "") + str(df._jdf.queryExecution().executedPlan().toString())
        return real(df, label)

    real = I.stored
    monkeypatch.setattr(I, "stored", seen)
    files = spark.createDataFrame([("a.ts", "function alpha() { beta(); gama(); }\n", "typescript", "a"), ("b.ts", "function beta() {}\nfunction gamma() { alpha(); }\n", "typescript", "b")], "path string, code string, lang string, stem string")
    I.index_files(files, I.index_files(files.where("path = 'a.ts'"), I.empty_index(spark)))
    joins_of = {label for label, text in plans_of.items() if "Join" in text}
    assert {"again", "looked", "named", "near", "references"} <= joins_of
    assert not [label for label in joins_of - {"chunks"} if "Broadcast" in plans_of[label]]
