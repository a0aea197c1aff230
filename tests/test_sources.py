"""Sources, stores and mutations on small literal input."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lodeweave import plans
from lodeweave.functions import text as X
from lodeweave.operators import mutations as M
from lodeweave.operators import predicates as P
from lodeweave.sources import files as S
from lodeweave.sources import records as R
from lodeweave.sources import tables as T
from lodeweave.sources.worktables import application_folder, drop_work_tables, scratch, shared_folder, stored


@pytest.fixture
def tree(tmp_path):
    for name, text in {"a.ts": "x", "src/b.py": "y", "src/test/c.test.ts": "z", "node_modules/d.ts": "n", ".git/e.ts": "h", "src/.hidden.py": "h", "readme.md": "m", "src/F.JAVA": "f"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_scan_and_profile(spark, tree):
    files = S.scan(spark, tree)
    assert {(r.path, r.lang, bytes(r.content)) for r in files.collect()} == {("a.ts", "typescript", b"x"), ("src/b.py", "python", b"y"), ("src/test/c.test.ts", "typescript", b"z"), ("src/F.JAVA", "java", b"f")}
    assert [tuple(r) for r in S.profile(S.scan(spark, tree, content=False, mapped=False)).collect()] == [("typescript", 2, 5, True), ("java", 1, 5, True), ("python", 1, 5, True)]
    assert {r.path for r in S.hashes(spark, tree, ["*.py", "test/"]).collect()} == {"a.ts", "src/F.JAVA"}


def test_logs_and_config(spark, tmp_path):
    path = f"{tmp_path}/log"
    R.append_actions(spark.createDataFrame([(1, "t", "shell", {"a": "b"})], R.ACTION), path)
    R.append_actions(spark.createDataFrame([("u", "shell", {"c": "d"})], "taskId string, kind string, payload map<string,string>"), path)
    rows = R.read_actions(spark, path).orderBy("ts").collect()
    assert rows[0].payload == {"a": "b"} and rows[1].taskId == "u" and rows[1].ts > 1
    with open(f"{path}/bad.json", "w") as f:
        f.write("\n{broken\n")
    assert R.read_actions(spark, path, strict=False, last=1).first().taskId == "u"
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        R.read_actions(spark, path).collect()
    (tmp_path / "c.json").write_text('{"a": 2}')
    (tmp_path / "d.yaml").write_text(": : :")
    assert R.read_config(spark, f"{tmp_path}/c.json", {"a": 1, "b": 1}) == {"a": 2, "b": 1}
    assert R.read_config(spark, f"{tmp_path}/d.yaml", {"a": 1}) == R.read_config(spark, f"{tmp_path}/none", {"a": 1}) == {"a": 1}
    (tmp_path / "app.log").write_text("  at lost (x.js:1:2)\n2024-01-01T00:00:00 \x1b[31mERROR\x1b[0m boom\n    at f (/a.js:10:5)\n\n  at /b.js:7:1\nWARN hm\n")
    entries = R.read_logs(spark, f"{tmp_path}/app.log").orderBy("line").collect()
    assert [(e.level, e.timestamp, len(e.stack)) for e in entries] == [("unknown", None, 0), ("error", "2024-01-01T00:00:00", 2), ("warn", None, 0)]
    assert [(f.fn, f.file, f.line, f.col) for f in entries[1].stack] == [("f", "/a.js", 10, 5), (None, "/b.js", 7, 1)]


def test_vector_store(spark):
    store = T.VectorStore(spark, "vectors_test")
    store.create("docs", 2)
    row = lambda i, v: (i, v, "c", "p", 1, 2, "ts", "{}")
    store.insert("docs", spark.createDataFrame([row("a", [1.0, 0.0]), row("b", [0.0, 1.0])], T.VECTOR))
    with pytest.raises(Exception, match="dimension is not 2: 3"):
        store.insert("docs", spark.createDataFrame([row("c", [1.0, 0.0, 0.0])], T.VECTOR))
    store.delete("docs", spark.createDataFrame([("a",)], "id string"))
    assert [r.id for r in store.table("docs").collect()] == ["b"] and store.has("docs") and store.collections() == ["docs"]
    store.drop("docs")
    assert not store.has("docs")


def test_sealed_store(spark):
    key = X.passphrase_key("p", b"salt")
    facts = spark.createDataFrame([("1", "é one", 1), ("2", "two", 2), ("3", "two", 3)], "id string, text string, created_at long")
    store = stored(T.push_facts(facts, spark.createDataFrame([], T.MODEL["shared_facts"]), key, "me"), "team")
    assert {(r.id, r.text) for r in T.pull_facts(store, key).collect()} == {("1", "é one"), ("2", "two")}
    assert [r.id for r in T.pull_facts(store, key, since=1).collect()] == ["2"]
    assert T.push_facts(facts, store, key, "me").count() == 0
    assert {r.text for r in T.pull_facts(store, X.passphrase_key("q", b"salt")).collect()} == {None}


def test_upsert_keeps_null_keys(spark):
    t = spark.createDataFrame([("a", None, 1), ("a", "x", 1)], "k string, s string, n int")
    out = M.upsert(t, spark.createDataFrame([("a", None, 2), ("a", "x", 0)], t.schema), ["k", "s"], ["n"])
    assert sorted(map(tuple, out.collect()), key=repr) == [("a", "x", 0), ("a", None, 1), ("a", None, 2)]


def test_dispatch_and_keys(spark):
    df = spark.createDataFrame([("Write and find it",), ("SEARCH",), ("rename",), ("hello",)], "t string")
    got = [r[0] for r in df.select(P.dispatch(F.col("t"), {"search": "s", "refactor": "r"}, default="d")).collect()]
    assert got == ["d", "s", "r", "d"]
    keys = spark.createDataFrame([("a", "sk-a-12345678"), ("a", "sk-b-12345678"), ("b", "short")], "p string, k string")
    assert [r[0] for r in keys.select(P.key_error(F.col("p"), F.col("k"), {"a": "sk-a-"})).collect()] == [None, "a keys start with sk-a-", "Key too short"]


def test_levels_fall_back_to_everything(spark):
    df = spark.createDataFrame([("info",), ("debug",)], "level string")
    assert P.relevant_levels(df).count() == 2
    assert P.relevant_levels(df.union(spark.createDataFrame([("warn",)], "level string"))).count() == 1


def test_work_tables_can_be_dropped(spark):
    stored(spark.range(3), "gone").collect()
    folder = application_folder(spark).removeprefix("file://")
    assert os.path.isdir(folder)
    drop_work_tables(spark)
    assert not os.path.exists(folder)


def test_scratch_tables_go(spark):
    with scratch(spark) as paths:
        gone, kept = stored(spark.range(3), "gone"), stored(spark.range(4), "kept")
        assert gone.count() == 3
        mine = paths.pop()
    assert kept.count() == 4 and os.path.exists(mine.removeprefix("file://")) and not os.path.exists(paths[0].removeprefix("file://"))
    with pytest.raises(RuntimeError), scratch(spark) as paths:
        stored(spark.range(3), "gone")
        raise RuntimeError
    assert not os.path.exists(paths[0].removeprefix("file://"))


def test_clusters_need_a_shared_folder():
    class Fake:
        conf = {}

        def __init__(self, master):
            self.sparkContext = type("C", (), {"master": master})

    for master in ("yarn", "spark://x:7077", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_folder(Fake(master))
    for master in ("local", "local[*]", "local[8]", "local[8, 2]"):
        assert shared_folder(Fake(master)).startswith("file://")


def test_yaml_mappings():
    text = """---
# routes
retries: 7   # often
rate: 0.5
name: "a: b # c"
other: 'it''s'
none:
on: true
empty: ~
url: http://x.org/y
list:
  - one
  - 2
  - {a: 1}
nested:
  deep:
    x: -1
    y: [1, 2]
routes:
  - tag: code
    model: m1
  - tag: docs
    models:
      - m2
      - m3
"""
    with pytest.raises(ValueError):
        R.yaml_mapping(text)  # a flow mapping without quotes
    found = R.yaml_mapping(text.replace("{a: 1}", '{"a": 1}'))
    assert found == {"retries": 7, "rate": 0.5, "name": "a: b # c", "other": "it's", "none": None, "on": True, "empty": None, "url": "http://x.org/y", "list": ["one", 2, {"a": 1}], "nested": {"deep": {"x": -1, "y": [1, 2]}}, "routes": [{"tag": "code", "model": "m1"}, {"tag": "docs", "models": ["m2", "m3"]}]}
    assert R.yaml_mapping("") == {} and R.yaml_mapping('{"a": [1]}') == {"a": [1]}
    for wrong in ("- a\n- b", ": : :", "a: |\n  text", "a: 1\n  b: 2", "a: &x 1", "just text", "a: 1\n- b"):
        with pytest.raises(ValueError):
            R.yaml_mapping(wrong)


def test_profile_by_its_own_rules(spark, tmp_path):
    names = ["a.ts", "b.TSX", "c.rb", "d.txt", "x/e.py", "x/y/my_spec.rb", "target/f.ts", "x/__pycache__/g.py", ".git/h.py", "node_modules/i.js", "1/2/3/4/5/in.go", "1/2/3/4/5/6/out.go"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("x")
    got = [tuple(r) for r in S.project_profile(spark, str(tmp_path)).collect()]
    assert sorted(r[:2] for r in got) == [("Go", 1), ("Python", 1), ("Ruby", 2), ("TypeScript", 2)] and {r[2:] for r in got} == {(7, True)}


def test_hashes_of_files(spark, tmp_path):
    import hashlib

    for n, text in {"a.ts": "é", "b.py": "b\n", "skip/c.ts": "x", "d.md": "y"}.items():
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text(text)
    got = {r.path: r.hash for r in S.hashes(spark, str(tmp_path), ["skip/"]).collect()}
    assert got == {n: hashlib.sha256(t.encode()).hexdigest() for n, t in {"a.ts": "é", "b.py": "b\n"}.items()}


def test_paging_stream_against_a_loop(spark, small):
    """Every turn added to a cache of 300 tokens, then the first one read, with lists."""
    want = []
    turns = {}
    for r in spark.read.parquet(f"{small}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, -(-len(r.text) // 4)))
    for conv, rows in turns.items():
        hot, cold = [], {}

        def put(item, n, at):
            if n > 300:
                cold[item] = n
                want.append((conv, at, item, "cold"))
                return
            while hot and sum(x[1] for x in hot) + n > 300:
                out = hot.pop(0)
                cold[out[0]] = out[1]
                want.append((conv, at, out[0], "cold"))
            hot.append((item, n))

        for turn, n in rows:
            put(str(turn), n, 2 * turn)
            if "0" in cold:
                want.append((conv, 2 * turn + 1, "0", "hit"))
                put("0", cold.pop("0"), 2 * turn + 1)
            else:
                want.append((conv, 2 * turn + 1, "0", "miss"))
    got = [(r.cache, r.ord, r.item, r.event) for r in plans.QUERIES["st2_pager_stream"](spark, small).collect()]
    assert sorted(got) == sorted(want)


def test_tail_of_a_stream(spark, small):
    """One file is one micro-batch: its last event."""
    last = spark.read.parquet(f"{small}/events.parquet").orderBy("event_id", ascending=False).first()
    assert [tuple(r) for r in plans.QUERIES["st4_log_tail"](spark, small).collect()] == [(last.event_id, last.event_type)]


def test_lines_of_split_files(spark, tmp_path):
    """Many byte splits of a file give the lines of a plain reader, and entries that cross them are whole."""
    draw = random.Random(8)
    pieces = ["2024-01-01T00:00:00 ERROR é 😀", "    at f (a.ts:1:2)", "", "  ", "WARN x\r", "info " + "y" * 700]
    texts = {f"{i}.log": "\n".join(draw.choice(pieces) for _ in range(n)) + end for i, (n, end) in enumerate([(900, ""), (1, "\n"), (350, "\n\n"), (1, ""), (500, "\r\n")])}
    texts["5.log"] = ""
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    held = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = R.read_lines(spark, f"file://{tmp_path}").collect()
        entries = [(r.file.rsplit("/", 1)[1], r.line, r.raw, len(r.stack)) for r in R.read_logs(spark, f"file://{tmp_path}").collect()]
        assert spark.read.text(f"file://{tmp_path}/0.log", lineSep="\n").rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held[0])
        spark.conf.set("spark.sql.files.openCostInBytes", held[1])
    got = sorted((r.file.rsplit("/", 1)[1], r.line, r.raw) for r in rows)
    plain = {name: text.split("\n")[: -1 if text.endswith("\n") or not text else None] for name, text in texts.items()}
    assert got == sorted((name, i, x) for name, lines in plain.items() for i, x in enumerate(lines))
    want = []
    for name, lines in plain.items():
        mine = []
        for i, x in enumerate(lines):
            if x.strip(" ") == "":
                continue
            if x.startswith("    at") and mine:
                mine[-1][3] += 1
            else:
                mine.append([name, i, x, 0])
        want += map(tuple, mine)
    assert sorted(entries) == sorted(want)
