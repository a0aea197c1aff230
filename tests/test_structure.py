"""Symbols and edges off the token stream: forms that misled a scanner of braces, and hostile files in linear time."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lodeweave.functions.text import match_offsets, running_sums
from lodeweave.operators import code as C
from lodeweave.operators.structure import scan_code, tokens


def found(code, lang="typescript"):
    symbols, edges = scan_code(code, lang, "f")
    return [(k, q) for k, _, q, *_ in symbols], [(a, b, k) for a, b, k, *_ in edges]


def calls(code, lang="typescript"):
    return [(a, b) for a, b, k in found(code, lang)[1] if k == "calls"]


def test_braces_in_parameters():
    assert calls("function a(x = {y: 1}) { b(); }") == [("f.a", "b")]
    assert calls("export function Card({ title }) { render(title); }") == [("f.Card", "render")]
    assert calls("function f(o: { a: number }): { x: number } { g(o); }") == [("f.f", "g")]
    assert found("class A { run({ a }) { this.go(a); } }") == ([("class", "f.A"), ("method", "f.A.run")], [("f.A.run", "go", "calls")])


def test_what_looks_like_code_in_texts():
    assert calls("function a() { s = `x ${b(`y ${c('}')} z`)} d(`; e(/[/{\"]f(/g); if (x) /}/.test(y); return 4 / g(1) / 2; }") == [("f.a", x) for x in ("b", "c", "e", "test", "g")]
    assert calls("fn a<'b>(c: &'b str) { d('{', \"}\", b'\\''); /* e( /* f( */ g( */ h(r#\"i(\"}\"#); }", "rust") == [("f.a", "d"), ("f.a", "h")]
    assert calls("func a() { b(`\n{`, \"}\", '{') // c(\n}", "go") == [("f.a", "b")]
    assert calls('int a() { return b(R"x(}"){)x", \'}\'); }', "cpp") == [("f.a", "b")]
    assert calls('class A { void b() { c(@"\\", "}"); d("""); } }', "csharp") == [("f.A.b", "c"), ("f.A.b", "d")]
    assert calls('class A { void b() { c("""\n } " d( """); e(); } }', "java") == [("f.A.b", "c"), ("f.A.b", "e")]
    assert calls('def a():\n    """b( \\""" c(\n"""\n    d(\'e(\') # f(\n    g(f"h(")', "python") == [("f.a", "d"), ("f.a", "g")]


def test_symbols_of_all_languages():
    assert found("type T<X> = { a: X } | string;\ninterface I { run(): void }\nenum E { A }\nconst a = 1, b = async ({c}: {c: D}): Promise<{e: F}> => g(c)\nconst h = function* () { i() }; let j = k => l(k)")[0] == [
        ("type", "f.T"), ("interface", "f.I"), ("class", "f.E"), ("arrow_function", "f.h"), ("arrow_function", "f.j")]
    assert found("const b = async ({c}: {c: D}): Promise<{e: F}> => g(c)")[0] == [("arrow_function", "f.b")]
    assert found("type (\n A struct { n int }\n B interface { C() }\n)\nfunc (a *A) D(e func(int) int) (interface{}, error) { return F(e), nil }", "go") == ([("class", "f.A"), ("interface", "f.B"), ("function", "f.D")], [("f.D", "f", "calls")])
    assert found("trait S { fn m(&self); fn d(&self) { k!() } }\nstruct P(i32);\nfn g<T: Fn(A) -> B>(f: T) -> impl Fn() where T: X { h(); }", "rust")[0] == [("class", "f.S"), ("method", "f.S.m"), ("method", "f.S.d"), ("class", "f.P"), ("function", "f.g")]
    assert found("class A : B, I { int X => g(); A(int x) : base(x) { } int F<T>(T t) where T : class { return G<int>(t); } void H() => K(); }", "csharp") == (
        [("class", "f.A"), ("constructor", "f.A.A"), ("method", "f.A.F"), ("method", "f.A.H")], [("f.A", "B", "extends"), ("f.A", "I", "extends"), ("f.A.F", "g", "calls"), ("f.A.H", "k", "calls")])
    assert found("class A<T> extends B<T> implements I, J { int x = foo(1); public A() { init(); } public <T> List<T> get(Map<S, T> m) throws E { return new X(m.get()); } abstract void no(); }", "java") == (
        [("class", "f.A"), ("constructor", "f.A.A"), ("method", "f.A.get")], [("f.A", "B", "extends"), ("f.A", "I", "implements"), ("f.A", "J", "implements"), ("f.A.A", "init", "calls"), ("f.A.get", "x", "calls"), ("f.A.get", "get", "calls")])
    assert found("#include <v>\nnamespace n { class A : public B { public: A(int x) : y{x} { i(); } ~A() {} int g() const { return 1; } }; }\nint A::h(int x) { return f(x); }", "cpp")[0] == [
        ("class", "f.A"), ("constructor", "f.A.A"), ("method", "f.A.A"), ("method", "f.A.g"), ("function", "f.h")]
    assert found("class A(B, metaclass=M):\n  class In:\n    async def deep(self): f()\n\n  def m(a=(1,\n2)):\n    def g(): pass\n    return h(a)\nx = y()", "python") == (
        [("class", "f.A"), ("class", "f.A.In"), ("method", "f.A.In.deep"), ("method", "f.A.m"), ("function", "f.A.m.g")], [("f.A", "B", "extends"), ("f.A.In.deep", "f", "calls"), ("f.A.m", "h", "calls")])


def test_extents_in_bytes():
    code = "// é\nfunction a() {\n  'é';\n}\nclass B { c() {} }"
    symbols = scan_code(code, "typescript", "f")[0]
    spans = {q: code.encode()[a:b].decode() for _, _, q, _, a, b, *_ in symbols}
    assert [s[-2:] for s in symbols] == [(2, 4), (5, 5), (5, 5)]
    assert spans == {"f.a": "function a() {\n  'é';\n}", "f.B": "class B { c() {} }", "f.B.c": "c() {}"}


HOSTILE = [
    ("function a() {", "ts"), ("'\\", "ts"), ("=/[", "ts"), ("`${", "ts"), ("a<", "ts"), ("(", "ts"), ("class A ", "ts"), ("class A extends ", "ts"), ("const a = x => ", "ts"), ("const a = (x): ", "ts"), ("class A { a(): ", "ts"),
    ("type a = ", "ts"), ("import a ", "ts"), ("}])({[", "ts"), ("}`", "ts"), ("class A implements B, ", "ts"), ("fn a(x) ", "rust"), ('r#"', "rust"), ("/*", "rust"), ("use a::{", "rust"), ("func a(x) ", "go"), ("type (\na b\n", "go"),
    ("def a(\n", "python"), ("class A(B,", "python"), ("'''", "python"), ('"""\\', "python"), ("a::a(", "cpp"), ('R"a(', "cpp"), ("a b(c) ", "cpp"), ("a b() throws ", "java"), ("class A { b(c) { ", "java"), ("a b(c) where d : ", "csharp"), ('@"', "csharp"), ("namespace a.", "csharp"),
]


@pytest.mark.parametrize("piece, lang", HOSTILE)
def test_hostile_files(piece, lang):
    code = piece * (100_000 // len(piece))
    began = time.perf_counter()
    scan_code(code, lang, "f")
    assert time.perf_counter() - began < 8  # quadratic ones take minutes


def test_links_of_brackets():
    """Every token is what the file holds there; brackets link both ways and nest."""
    draw = random.Random(5)
    for lang in ("typescript", "python", "go", "rust", "java", "cpp", "csharp"):
        for _ in range(60):
            code = "".join(draw.choice(["(", ")", "[", "]", "{", "}", "'", '"', "`", "${", "/", "a", " ", "\n", "\\", "//", "/*", "*/", "é", "=>", "<", '"""', "r#"]) for _ in range(80))
            t = tokens(code, lang)
            assert t.start == sorted(t.start) and all(a < b for a, b in zip(t.start, t.end, strict=True))
            for i, x in enumerate(t.text):
                assert x in code[t.start[i] : t.end[i]]
                assert (t.line[i], t.last[i]) == (code.count("\n", 0, t.start[i]) + 1, code.count("\n", 0, t.end[i]) + 1)
                if x in (")", "]", "}") and t.link[i] >= 0:
                    assert t.link[t.link[i]] == i and t.within[i] == t.within[t.link[i]]


def test_offsets_in_long_texts(spark):
    draw = random.Random(2)
    rows = [(i, "".join(draw.choice(["ab", "é", "\n", "x", "😀"]) for _ in range(n))) for i, n in enumerate((0, 1, 63, 64, 65, 5_000, 60_000))]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {r.id: [tuple(m) for m in r.m] for r in df.select("id", match_offsets(F.col("t"), "ab", lines=True).alias("m")).collect()}
    for i, t in rows:
        assert got[i] == [("ab", m.start(), t.count("\n", 0, m.start()) + 1) for m in re.finditer("ab", t)]
    sums = spark.createDataFrame([([],), ([3],), (list(range(1000)),), (None,)], "a array<int>").select(running_sums(F.col("a")).alias("s")).collect()
    assert [r.s for r in sums] == [[], [3], [sum(range(i + 1)) for i in range(1000)], None]


def test_complexity_of_small_files(spark):
    """Counted by hand: branchy has 2 if (one of them else if, counted twice), for, while, case twice, catch, a conditional and three operators, one of them in the function after it."""
    files = [
        ("a.ts", "export function plain(x) {\n  return x;\n}\n"),
        ("b.ts", "function branchy(a, b) {\n  if (a && b) { for (let i = 0; i < 3; i++) { while (a) { a--; } } }\n  else if (b || a) { return a ? 1 : 2; }\n  switch (a.type) { case 1: break; case 2: break; }\n  try { b(); } catch (e) { }\n}\nconst arrow = async (x) => x || 1;\n"),
        ("c.ts", "x && y; function late() { a || b }\n" + "if (x) {}\n" * 200),
    ]
    got = {tuple(r) for r in C.function_complexity(spark.createDataFrame(files, "id string, code string")).collect()}
    assert got == {("a.ts", "plain", 1, 1), ("b.ts", "branchy", 1, 13), ("b.ts", "arrow", 7, 2), ("c.ts", "late", 1, 151)}


def test_design_of_small_files(spark):
    files = [
        ("c.ts", "interface Wide { a(): void; b(): void; c(): void; d(): void; e(): void; f(): void; g(): void; h(): void; i(): void }\nclass A { constructor() { this.x = new Thing(); } }\n"),
        ("d.ts", "switch (a.kind) {}\nswitch (b.type) {}\nswitch ( c.variant ) {}\ninterface Thin { a(): void }\nclass B { constructor(private x: X) {} }\n"),
        ("e.ts", "\n".join(f"export function f{i}() {{ return {i}; }}" for i in range(12)) + "\n" + "// line\n" * 400),
    ]
    got = {tuple(r) for r in C.design_violations(spark.createDataFrame(files, "id string, code string")).collect()}
    assert got == {("c.ts", "ISP", "medium", 9), ("c.ts", "DIP", "high", 1), ("d.ts", "OCP", "low", 3), ("e.ts", "SRP", "medium", 12)}
