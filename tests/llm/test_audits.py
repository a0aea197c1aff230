"""Whitening, decontamination and the filter audit against plain Python on small tables with every kind of odd row."""

import collections
import hashlib
import itertools
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from compare import same_rows
from pyspark.sql import functions as F

from lodeweave.llm import decontamination, filter_audit, queries, whitening
from lodeweave.llm.work import documents, stored

# 11 whitening


def plain_whitening(rows, k=4):
    """Rows by (id, component): n, deviation, explained; and the whitened values of each component, whose sign is free."""
    good = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = []
    for i, x in good:
        z = np.array([float(Fraction(n * v - s, n)) for v, s in zip(x, sums, strict=True)]) @ vectors / np.sqrt(values)
        deviation = sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True))
        out += [(i, j + 1, n, deviation, z[j], values[j] / np.trace(centred.T @ centred / n)) for j in range(len(values))]
    return out


def check_whitening(got, want):
    got, want = sorted(got, key=repr), sorted(want, key=repr)
    exact = lambda r: tuple(r[:4])
    assert collections.Counter(map(exact, got)) == collections.Counter(map(exact, want))
    for j in {r[1] for r in want}:
        mine, other = (sorted((r[0], r[3], r[4]) for r in x if r[1] == j) for x in (got, want))
        turn = np.sign(sum(a[2] * b[2] for a, b in zip(mine, other, strict=True)))
        assert max(abs(turn * a[2] - b[2]) for a, b in zip(mine, other, strict=True)) < 1e-8
        assert {round(r[5], 9) for r in got if r[1] == j} == {round(r[5], 9) for r in want if r[1] == j}
    assert len({r[6] for r in got}) == 1 and got[0][6] < 1e-9


def test_whitening(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    check_whitening([tuple(r) for r in queries.QUERIES["op11_whitening"](spark, small).collect()], plain_whitening(rows))


def test_whitening_of_odd_rows(spark):
    draw = random.Random(1)
    vector = lambda: [draw.gauss(0, 3 - i / 2) for i in range(5)]
    hot = vector()
    rows = [(i, hot) for i in range(40)] + [(100 + i, vector()) for i in range(60)]
    odd = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (204, []), (205, [1.0, 2.0])]
    schema = "vec_id long, embedding array<double>, component string, n string, x string, __vector string"
    df = spark.createDataFrame([(*r, "own", "own", "own", "own") for r in rows + odd + rows[:3]], schema)
    check_whitening([tuple(r) for r in whitening.whiten(df).collect()], plain_whitening(rows + rows[:3]))
    empty = whitening.whiten(df.where("false"))
    assert empty.collect() == [] and empty.columns[:2] == ["vec_id", "component"]
    (null_id,) = {r.vec_id for r in whitening.whiten(df.where("vec_id < 103").withColumn("vec_id", F.lit(None).cast("long"))).collect()}
    assert null_id is None


def test_whitening_without_variance(spark):
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in flat] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)] * 2
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id long, embedding array<float>")).collect()
    assert all((r.whitened is None) == (r.component > 1) and r.identity_error < 1e-9 for r in line) and len(line) == 27
    assert {(r.component, round(r.explained, 9)) for r in line} == {(1, 1.0), (2, 0.0), (3, 0.0)}


def test_deviations_beyond_a_long_are_exact_or_null():
    c = whitening.Components(3, [10**15, 5], np.eye(2), np.ones(2), np.zeros(2), 2.0, 0.0, 1)
    x = np.array([[333_333_333_333_333, 1], [10**15, 0]])
    assert whitening.deviations(x, c) == [(999_999_999_999_999 - 10**15) ** 2 + 4, None]


@pytest.mark.parametrize("falling", [0.9, 1.0])
def test_iteration_with_a_narrow_block(spark, falling):
    """Falling spectra converge in the block that they begin with or a wider one; flat ones widen it until it holds all directions."""
    draw = np.random.default_rng(3)
    x = np.floor(draw.standard_normal((600, 40)) * 1000 * falling ** np.arange(40) @ np.linalg.qr(draw.standard_normal((40, 40)))[0]).astype(np.int64)
    fit = stored(spark.createDataFrame([(row,) for row in x.tolist()], "x array<bigint>"), "fit")
    c = whitening.components(fit, 3, block=6)
    covariance = np.cov(x.T, bias=True)
    values, vectors = np.linalg.eigh(covariance)
    assert c.n == 600 and c.sums == x.sum(axis=0).tolist() and abs(c.trace / np.trace(covariance) - 1) < 1e-12
    assert np.allclose(c.values, values[::-1][:3], rtol=1e-12) and c.residuals.max() <= whitening.RESIDUAL * c.values[0]
    assert np.allclose(np.abs(np.sum(c.vectors * vectors[:, ::-1][:, :3], axis=0)), 1, atol=1e-12) and c.identity_error < 1e-9
    assert 1 < c.passes < 40


# 12 decontamination


def plain_hits(text, items, window=10):
    """Hit words by number, and the items, by trying every window at every word."""
    low = lambda t: "".join(chr(ord(c) | 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010FFFF]+", low(t))
    mine = words(text)
    hit, found = set(), set()
    for item, other in items:
        other = words(other)
        n = min(window, len(other))
        windows = {tuple(other[i : i + n]) for i in range(len(other) - n + 1)} if n else ()
        for i in range(len(mine) - n + 1) if n else ():
            if tuple(mine[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(item)
    return len(mine), sorted(hit), sorted(x for x in found if x is not None)


def spans_of(hit):
    out = []
    for _, g in itertools.groupby(enumerate(hit), lambda x: x[1] - x[0]):
        g = [j for _, j in g]
        out.append((g[0], g[-1] + 1))
    return out


def check_hits(df, items_df, items, texts, **limits):
    got = collections.Counter((r[0], r.n_words, tuple((s.start, s.end) for s in r.spans), tuple(r["items"])) for r in decontamination.decontaminate(df, items_df, **limits).collect())
    want = collections.Counter()
    for i, text in texts:
        n, hit, found = plain_hits(text, items, limits.get("window", 10))
        want[i, n, tuple(spans_of(hit)), tuple(found)] += 1
    assert got == want


def random_case(seed):
    draw = random.Random(seed)
    some = lambda n: " ".join(draw.choice("ab cd EF gh".split()) for _ in range(n))
    items = [(str(i), some(draw.choice([0, 1, 3, 4, 6, 9, 30]))) for i in range(8)]
    texts = []
    for i in range(25):
        text = some(draw.randrange(30))
        for _ in range(draw.randrange(3)):
            words = draw.choice(items)[1].split()
            a = draw.randrange(len(words) + 1)
            text += draw.choice([" ", " zz, "]) + " ".join(words[a : a + draw.randrange(1, 12)])
        texts.append((i, text))
    return items, texts


@pytest.mark.parametrize("seed", range(12))
def test_automaton_on_few_words(seed):
    """Few different words: windows overlap, repeat and end in one another."""
    items, texts = random_case(seed)
    for window in (3, 5, 10):
        pieces = [decontamination.Piece(int(i), decontamination.words_of(t)) for i, t in items if t]
        a = decontamination.Automaton(pieces, window)
        assert a.states <= 2 * sum(len(p.words) for p in pieces) + 1
        for _, text in texts:
            n, hit, found = plain_hits(text, items, window)
            spans, got = a.stream(decontamination.words_of(text))
            assert spans == spans_of(hit) and sorted(map(str, got)) == found


def test_decontamination_of_odd_rows(spark, odd, clashing, none, small, monkeypatch):
    base = odd.where("doc_id = 1").first().text
    schema = "item_id long, text string, spans string, n_words string"
    items = [(1, base.upper()), (2, None), (3, ""), (4, "?!"), (5, "ALL rights, reserved"), (None, "zwei drei"), (7, base), (7, base), (8, "日本語、テスト"), (9, "drei eins " * 3_000)]
    items_df = spark.createDataFrame([(*x, "own", "own") for x in items], schema)
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    named = [(None if i is None else str(i), t) for i, t in items]
    check_hits(odd, items_df, named, texts)
    check_hits(clashing, items_df, named, texts)
    check_hits(odd, items_df.where("false"), [], texts)
    assert decontamination.decontaminate(none, items_df).collect() == []
    monkeypatch.setattr(decontamination, "PIECE_WINDOWS", 7)
    check_hits(odd, items_df, named, texts, block_bytes=40_000)


def test_clean_texts(spark):
    item = "one two three four five six seven eight nine ten eleven"
    filler = " ".join(f"w{i}" for i in range(100))
    rows = [(1, f"Before, {item.upper()}; after. {filler}"), (2, f"x {item}"), (3, "short one: red fox!"), (4, f"the Red-Fox {filler}"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([("a", item), ("b", "red fox")], "item_id string, text string")
    got = {r.doc_id: r.clean_text for r in decontamination.decontaminate(df, items).collect()}
    assert got == {1: f"Before, ; after. {filler}", 2: "x ", 3: "short one: !", 4: f"the Red-Fox {filler}", 5: None, 6: ""}


def test_decontamination_query(spark, small, duck):
    same_rows(queries.QUERIES["op12_decontamination"](spark, small), queries.SQL["op12_decontamination"], duck)
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in queries.QUERIES["op12_decontamination"](spark, small).collect()}
    texts = {r.doc_id: r.text for r in documents(spark, small).collect()}
    bad = [i for i, r in rows.items() if r.contaminated]
    for i in bad[:10] + sorted(rows)[:10]:
        n, hit, found = plain_hits(texts[i], items)
        assert tuple(rows[i])[1:] == (n, len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit))
    assert bad


# 13 filter audit


def plain_audit(rows, labels):
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    facts = []
    for i, text, part in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and i > first[t],
        }
        facts.append((part or "", fails, (i, 1, "q") in labels, (i, 1, "t") in labels))
    out = []
    for part in {f[0] for f in facts}:
        mine, removed_by = [f for f in facts if f[0] == part], collections.Counter()
        steps = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [f for f in left if f[1][name]]
                redundant = sum(f[1][name] for f in mine) - len(gone)
                left = [f for f in left if not f[1][name]]
                removed_by[name] += len(gone)
                alone = sum(f[1][name] and sum(f[1].values()) == 1 for f in mine)
                steps.append((part, order, step, len(left), len(gone), redundant, alone, sum(f[2] for f in gone), sum(f[3] for f in gone), name))
        out += [(*s[:-1], removed_by[s[-1]]) for s in steps]
    return collections.Counter(out)


def test_first_failures():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120)
    for mask, (j, order) in itertools.product(range(32), enumerate(filter_audit.ORDERS)):
        assert table[mask, j] == next((s for s, f in enumerate(order) if mask >> "ABCDE".index(f) & 1), 5)


def test_filter_audit(spark, odd, clashing, none, monkeypatch):
    long = " ".join(f"word{i}" for i in range(250))
    more = [(20, long, "en", "a", 1), (21, long, "de", "a", 1), (22, long + " #", "en", "a", 1), (23, long.upper(), None, "a", 1), (24, "same " * 300, "en", "a", 1), (None, long, "", "a", 1), (1, long, "en", "a", 1)]
    df = odd.unionByName(spark.createDataFrame(more, odd.schema))
    labels = [(1, 1, 0), (1, 0, 1), (1, 1, 0), (5, None, 1), (21, 1, 1), (23, 0, 1), (None, 1, 1), (99, 1, 1)]
    labels_df = spark.createDataFrame([(*x, "own", "own") for x in labels], "doc_id long, quality int, toxic int, part string, n string")
    flags = {(i, q, "q") for i, q, _ in labels if i} | {(i, t, "t") for i, _, t in labels if i}
    want = plain_audit([(r.doc_id, r.text, r.lang) for r in df.collect()], flags)
    got = filter_audit.filter_audit(df, labels_df)
    assert got.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert collections.Counter(map(tuple, got.collect())) == want
    monkeypatch.setattr(filter_audit, "PARTS", 1)
    assert collections.Counter(map(tuple, filter_audit.filter_audit(df, labels_df).collect())) == want
    own = plain_audit([(r.doc_id, r.text, r.lang) for r in odd.collect()], flags)
    assert collections.Counter(map(tuple, filter_audit.filter_audit(clashing, labels_df).collect())) == own
    assert filter_audit.filter_audit(none, labels_df).collect() == []
    assert all(r.good_lost == r.toxic_lost == 0 for r in filter_audit.filter_audit(odd, labels_df.where("false")).collect())


def test_filter_audit_query(spark, small, duck):
    same_rows(queries.QUERIES["op13_filter_audit"](spark, small), queries.SQL["op13_filter_audit"], duck)
