"""The index does not depend on how files are split into batches, nor on their order."""

import random

import pytest

from lodeweave.operators import indexing as I

#: Calls of other files, late ones, near names (fuzzy), names that two files declare, a qualified target, methods by the class around.
FILES = {
    "a.ts": "import { b } from './b';\nexport function alpha() { beta(); gamma(); nowhere(); }\nclass Box extends Base { put() { this.take(); twice(); } take() {} }\n",
    "b.ts": "export function beta() { alpha(); deltas(); }\nfunction twice() {}\n",
    "c.py": "def gamma():\n    beta()\n    take()\n",
    "d.rs": "fn delta() { gama(); twice(); }\nstruct Base { x: i32 }\n",
    "e.go": "package e\nfunc twice() { delta() }\nfunc Lonely() { nowherf() }\n",
    "f.java": "class Base { void betas() { alpha(); lonely(); } }\n",
}
LANGS = {"ts": "typescript", "py": "python", "rs": "rust", "go": "go", "java": "java"}
FIRST = {"a.ts": "function deltas() { beta(); }\nfunction nowherf() {}\n", "e.go": "func gone() { alpha() }\n"}


def batch(spark, files):
    return spark.createDataFrame([(p, c, LANGS[p.split(".")[1]], p.split(".")[0]) for p, c in files.items()], "path string, code string, lang string, stem string")


def edges(index):
    names = {r.id: f"{r.path}:{r.qualified_name}" for r in index["symbols"].collect()}
    return sorted((names[r.src], names[r.dst], r.kind, r.confidence) for r in index["edges"].collect())


@pytest.fixture(scope="module")
def at_once(spark):
    return edges(I.index_files(batch(spark, FILES), I.empty_index(spark)))


def test_edges_at_once(at_once):
    assert ("a.ts:a.alpha", "b.ts:b.beta", "calls", 0.85) in at_once
    assert ("a.ts:a.Box.put", "a.ts:a.Box.take", "calls", 0.95) in at_once
    assert ("d.rs:d.delta", "c.py:c.gamma", "calls", 0.5) in at_once  # gama
    assert ("b.ts:b.beta", "d.rs:d.delta", "calls", 0.5) in at_once  # deltas
    assert not any(b.endswith("twice") and a.startswith("a.ts") and s == 0.85 for a, b, _, s in at_once)  # two files declare it


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_gives_the_same_index(spark, at_once, seed):
    """Older versions of two files come first and are replaced; callers come before what they call."""
    draw = random.Random(seed)
    paths = sorted(FILES)
    draw.shuffle(paths)
    cut = draw.randrange(1, 5)
    first = {p: FIRST.get(p, FILES[p]) for p in paths[:cut]} | FIRST
    index = I.empty_index(spark)
    for files in (first, {p: FILES[p] for p in paths[cut:]}, {p: FILES[p] for p in FILES if p in first}):
        index = I.index_files(batch(spark, files), index)
    assert edges(index) == at_once


def test_removed_files_and_empty_batches(spark):
    both = I.index_files(batch(spark, {"a.ts": FILES["a.ts"], "b.ts": FILES["b.ts"]}), I.empty_index(spark))
    assert I.index_files(batch(spark, {"a.ts": FILES["a.ts"]}), both) is both
    none = batch(spark, FILES).where("false")
    left = I.index_files(none, both, removed=spark.createDataFrame([("b.ts",), ("never.ts",)], "path string"))
    assert edges(left) == edges(I.index_files(batch(spark, {"a.ts": FILES["a.ts"]}), I.empty_index(spark)))
    assert {r.path for r in left["chunks"].collect()} == {"a.ts"}
