"""Window forms and folds against plain loops on random input."""

import random
import re

from pyspark.sql import functions as F

from lodeweave import plans
from lodeweave.operators import code as C
from lodeweave.operators import graphs as G
from lodeweave.operators import joins as J
from lodeweave.operators import logs
from lodeweave.operators import sequences as S
from lodeweave.plans import quality
from lodeweave.streaming.stateful import Pager


def test_budget_prefix_is_the_greedy_fill(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.randint(1, 50)) for g in range(60) for i in range(rng.randint(0, 12))]
    got = {(r.g, r.id) for r in S.budget_prefix(spark.createDataFrame(rows, "g int, id int, token_count int"), 90, per=["g"]).collect()}
    want = set()
    for g in range(60):
        left = 90
        for n, i in sorted((t, i) for h, i, t in rows if h == g):
            if n <= left:
                left -= n
                want.add((g, i))
    assert got == want


def test_parallel_groups(spark):
    rng = random.Random(2)
    rows = list({(p, s, rng.randint(0, 30)) for p in range(40) for s in range(rng.randint(1, 8)) for _ in range(3)})
    got = {(r.plan, r.step): r.group for r in S.parallel_groups(spark.createDataFrame(rows, "plan int, step int, file int")).collect()}
    for p in range(40):
        used, group = set(), 0
        for s in sorted({s for q, s, _ in rows if q == p}):
            files = {f for q, t, f in rows if (q, t) == (p, s)}
            group += bool(files & used) or not group
            used |= files
            assert got[p, s] == group


def test_fifo_and_pager_agree(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.randint(1, 60)) for g in range(60) for i in range(rng.randint(1, 15))]
    got = {(r.g, r.i) for r in S.fifo_hot(spark.createDataFrame(rows, "g int, i int, tokens int"), 50, "g", "i").where("hot").collect()}
    want = set()
    for g in range(60):
        pager = Pager(50, [], {})
        for h, i, t in rows:
            if h == g:
                pager.add(str(i), t)
        want |= {(g, int(i)) for i, _ in pager.hot}
    assert got == want


def test_breaker(spark):
    rng = random.Random(4)
    rows = []
    for p in range(30):
        t = 0
        for i in range(40):
            t += rng.choice([1000, 9000, 40000])
            rows.append((p, i, t, rng.random() < 0.7))
    got = {(r.p, r.i): r.open for r in S.breaker_open(spark.createDataFrame(rows, "p int, i int, t long, failed boolean"), "p", "t", "i", "failed").collect()}
    for p in range(30):
        state, fails, opened = "closed", 0, 0
        for _, i, t, failed in (r for r in rows if r[0] == p):
            if state == "open" and t - opened > 30000:
                state = "half-open"
            assert got[p, i] == (state == "open")
            if failed:
                fails += 1
                if fails >= 3:
                    state, opened = "open", t
            else:
                fails, state = 0, "closed"


def test_rollovers(spark):
    for every, keep in ((20, 5), (4, 1), (7, 6)):
        stored, want = 0, []
        for n in range(1, 120):
            stored += 1
            if stored % every == 0:
                want.append(n)
                stored = keep
        got = [r.id for r in spark.range(1, 120).where(S.rollovers(F.col("id"), every, keep)).orderBy("id").collect()]
        assert got == want


def test_pager_reads_back():
    p = Pager(100, [], {})
    assert p.add("a", 60) == [] and p.add("b", 60) == ["a"] and p.add("big", 101) == ["big"]
    assert p.read("a") == (True, ["b"]) and p.read("none") == (False, [])
    assert p.hot == [["a", 60]] and set(p.cold) == {"b", "big"}


def test_segments_agree_with_the_splitter(spark):
    code = "import x\n\nfunction a() {\n  1\n}\n\n  class B {\n}\n\n\n" * 5
    files = spark.createDataFrame([(1, code, "typescript"), (2, "", "python"), (3, "  \n", "go"), (4, "def f():\n  pass\n\nclass C: pass\n", "Python")], "id int, code string, lang string")
    got = sorted((r.id, r.start_line, r.end_line, r.content) for r in C.segments(files).collect())
    want = sorted((r.id, r.start_line, r.end_line, r.content) for r in C.split_code(files, overlap=0).collect())
    assert got == want


def test_line_chunks_cover_and_overlap():
    content = "\n".join(f"line {i} " + "x" * (i % 40) for i in range(200))
    out = C.line_chunks(C.Chunk(content, 1, 200), 500, 300)
    assert out[0].first == 1 and out[-1].last == 200
    for a, b in zip(out, out[1:], strict=False):
        assert b.first <= a.last + 1 and len(a.text) <= 500
    assert [o.first for o in out[-3:]] == [198, 199, 200]  # the tail steps back to the end


def windows_by_joining(lines, at, size, back):
    """Windows from line ``at`` on, by joining lines and looking how long they are."""
    if at >= len(lines):
        return []
    fits = [b for b in range(at + 1, len(lines) + 1) if len("\n".join(lines[at:b]) + "\n") <= size]
    end = fits[-1] if fits else at + 1
    return [(at, end), *windows_by_joining(lines, max(at + 1, end - back), size, back)]


def test_line_chunks_against_joined_lines():
    rng = random.Random(6)
    for _ in range(300):
        lines = ["x" * rng.choice([0, 1, 5, 20, 60]) for _ in range(rng.randint(1, 40))]
        size, overlap = rng.randint(5, 120), rng.choice([0, 80, 160, 300])
        cut = [("\n".join(lines[a:b]).rstrip(), a + 7, b + 6) for a, b in windows_by_joining(lines, 0, size, max(1, overlap // 80))]
        assert C.line_chunks(C.Chunk("\n".join(lines), 7, 6 + len(lines)), size, overlap) == [x for x in cut if x[0]]


def test_chunks_of_documents_against_joined_lines(spark, small):
    """The query of chunks: segments, windows and what each takes over, put together from line numbers."""
    got = {}
    for r in plans.QUERIES["t2_packed_chunks"](spark, small).collect():
        got.setdefault(r.id, []).append((r.chunk, r.content, r.start_line, r.end_line, r.language))
    for r in quality.as_code(spark, small).collect():
        lines, bare = (r.code or "").split("\n"), []
        heads = [i for i, x in enumerate(lines) if i == 0 or re.match(C.BOUNDARIES.get((r.lang or "").lower(), C.BOUNDARIES["typescript"]), x.lstrip())]
        for k, a in enumerate(heads):
            part = "\n".join(lines[a : heads[k + 1] if k + 1 < len(heads) else len(lines)]).rstrip().split("\n")
            last = heads[k + 1] if k + 1 < len(heads) else len(lines)
            if len("\n".join(part)) <= 500:
                bare.append(("\n".join(part), a + 1, last))
            else:
                bare += [("\n".join(part[x:y]).rstrip(), a + 1 + x, a + y) for x, y in windows_by_joining(part, 0, 500, 2)]
        bare = [x for x in bare if x[0]]
        want = [(0, *bare[0], (r.lang or "typescript").lower())] if bare else []
        for n, ((before, *_), (text, first, last)) in enumerate(zip(bare, bare[1:], strict=False), 1):
            shown = before[-160:]
            want.append((n, shown + "\n" + text, max(1, first - len(shown.split("\n"))), last, (r.lang or "typescript").lower()))
        assert sorted(got.get(r.id, [])) == want


def test_extractor():
    ts = "import { z } from './zed';\nexport class Dog extends Animal implements Pet {\n  constructor(private n: string) { super(n); }\n  bark(): void { this.voice.play('wau'); helper(1); }\n}\ninterface Pet { n: string }\ntype Id = string;\nconst twice = (x: number) => helper(x) * 2;\nasync function helper(x) { if (x) { return x; } }\n"
    symbols, edges = C.scan_code(ts, "typescript", "dog")
    assert {(k, q) for k, _, q, *_ in symbols} == {("class", "dog.Dog"), ("constructor", "dog.Dog.constructor"), ("method", "dog.Dog.bark"), ("interface", "dog.Pet"), ("type", "dog.Id"), ("arrow_function", "dog.twice"), ("function", "dog.helper")}
    assert {(s, t, k) for s, t, k, *_ in edges} == {("dog", "./zed", "imports"), ("dog.Dog", "Animal", "extends"), ("dog.Dog", "Pet", "implements"), ("dog.Dog.bark", "play", "calls"), ("dog.Dog.bark", "helper", "calls"), ("dog.twice", "helper", "calls")}
    py = "import os\nclass A(B):\n    def __init__(self):\n        self.run()\n\ndef f():\n    return os.path.Join('é')\n"
    symbols, edges = C.scan_code(py, "python", "m")
    assert [(k, q) for k, _, q, *_ in symbols] == [("class", "m.A"), ("constructor", "m.A.__init__"), ("function", "m.f")]
    assert {(s, t, k) for s, t, k, *_ in edges} == {("m", "os", "imports"), ("m.A", "B", "extends"), ("m.A.__init__", "run", "calls"), ("m.f", "join", "calls")}
    assert C.scan_code("def broken(:", "python", "m") == ([("function", "broken", "m.broken", None, 0, 12, 1, 1)], [])


def test_resolution_order(spark):
    from lodeweave.operators.joins import resolve_edges

    symbols = spark.createDataFrame([(0, "add", "util.add"), (1, "add", "calc.add"), (2, "Calc", "calc.Calc"), (3, "run", "calc.Calc.run"), (4, "format", "format.format")], "ord int, name string, qualified_name string")
    edges = spark.createDataFrame(
        [("util.x", "util.add", "calls", 0.8), ("util.x", "add", "calls", 0.8), ("calc.Calc.go", "run", "calls", 0.8), ("helpers.x", "sum", "calls", 0.8), ("helpers.x", "Format", "calls", 0.8), ("helpers.x", "calc.run", "calls", 0.8), ("helpers.x", "fromat", "calls", 0.8), ("helpers.x", "zzzzzz", "calls", 0.8), ("helpers", "./util", "imports", 1.0)],
        "src_qn string, dst_qn string, kind string, confidence double",
    )
    bindings = spark.createDataFrame([("sum", "util.add")], "local string, target string")
    got = {(r.src_qn, r.dst_qn): (r.target, r.score, r.resolved, r.strategy) for r in resolve_edges(edges, symbols, bindings).collect()}
    assert got == {
        ("util.x", "util.add"): ("util.add", 1.0, True, "exact"),
        ("util.x", "add"): ("util.add", 0.95, True, "local_scope"),
        ("calc.Calc.go", "run"): ("calc.Calc.run", 0.95, True, "local_scope"),
        ("helpers.x", "sum"): ("util.add", 0.9, True, "file_alias"),
        ("helpers.x", "Format"): ("format.format", 0.85, True, "import_resolved"),
        ("helpers.x", "calc.run"): ("calc.Calc.run", 0.75, True, "type_hint"),
        ("helpers.x", "fromat"): ("format.format", 0.5, True, "fuzzy"),
        ("helpers.x", "zzzzzz"): ("zzzzzz", 0.8, False, "unresolved"),
        ("helpers", "./util"): ("./util", 1.0, False, "unresolved"),
    }


def test_nearest_names_against_all_pairs(spark):
    rng = random.Random(7)
    letters = lambda n: "".join(rng.choice("abé") for _ in range(n))
    names = [letters(rng.choice([0, 1, 2, 3, 5, 8, 22, 23, 24, 25, 26, 27, 40, 90])) for _ in range(400)]
    targets = [None, "", "zzz"]
    for x in names:
        for _ in range(rng.randint(0, 3)):  # edits
            at = rng.randint(0, len(x))
            x = rng.choice([x[:at] + rng.choice("abéx") + x[at:], x[:at] + x[at + 1 :], x[:at] + rng.choice("abx") + x[at + 1 :]])
        targets.append(x)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, left = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
        return row[-1]

    want = {}
    for t in set(targets) - {None}:
        near = [(distance(t, x), i, x) for i, x in enumerate(names) if abs(len(t) - len(x)) <= 2]
        if near and min(near)[0] <= 2:
            want[t] = (min(near)[2], min(near)[0])
    got = J.nearest_names(spark.createDataFrame([(t,) for t in targets], "target string"), spark.createDataFrame(list(enumerate(names)), "ord int, name string"))
    assert {r.target: (r.name, r.distance) for r in got.collect()} == want
    assert len(want) > 300


def test_logs_in_blocks(spark):
    """Entries that cross blocks, logs that begin with frames, blank lines and blocks without an entry."""
    rng = random.Random(8)
    rows = [(name, i, rng.choice(["2024-01-02T03:04:05 ERROR x", "    at f (a.js:1:2)", "    at b.js:3:4", "    at odd", "", "info y"]) if rng.random() < 0.7 else "    at g (c.js:5:6)") for name in "pqr" for i in range(200)]
    rows += [("s", i, "  at only") for i in range(9)] + [("t", 5, "one")]
    want = {}
    for name in "pqrst":
        entry = None
        for _, i, raw in sorted(r for r in rows if r[0] == name and r[2].strip()):
            if entry is None or not re.match(r"\s+at ", raw):
                entry = i
                want[name, i] = (raw, [])
            else:
                want[name, entry][1].append(raw.strip())
    df = spark.createDataFrame(rows, "log string, line int, raw string")
    for block in (1, 7, 10_000):
        got = {(r.log, r.line): (r.raw, [f.raw for f in r.stack]) for r in logs.parse_lines(df, "log", block_lines=block).collect()}
        assert got == want


def test_closure_against_breadth_first(spark):
    rng = random.Random(9)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(120)]
    got = {(r.root, r.node): r.depth for r in G.closure(spark.createDataFrame(pairs, "src long, dst long"), spark.range(61).withColumnRenamed("id", "root"), 3).collect()}
    want = {}
    for root in range(61):
        seen, wave = {root}, {root}
        for depth in (1, 2, 3):
            wave = {b for a, b in pairs if a in wave} - seen
            seen |= wave
            want |= {(root, x): depth for x in wave}
    assert got == want
