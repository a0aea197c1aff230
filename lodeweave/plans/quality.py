"""Splitting, symbols, complexity, duplication, design."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import code as C
from ..operators import indexing as I
from .registry import query, table, wide_table

#: Documents read as code: lines that begin with 'The' or 'And' declare functions.
_SQL_CODE = r"regexp_replace(text, '(?m)^(The|And) ', 'function \1 ', 'g')"


def as_code(spark, d):
    code = F.regexp_replace("text", r"(?m)^(The|And) ", "function $1 ")
    return wide_table(spark, d, "documents").select(F.col("doc_id").alias("id"), code.alias("code"), "lang", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("stem"))


@query("t1_declaration_segments", f"""WITH l AS (SELECT id, generate_subscripts(ls, 1) - 1 AS n, unnest(ls) AS line FROM (SELECT doc_id AS id, string_split({_SQL_CODE}, chr(10)) AS ls FROM documents)),
s AS (SELECT *, sum(CASE WHEN n = 0 OR regexp_matches(ltrim(line), '^function (The|And)') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS segment FROM l)
SELECT id, segment::BIGINT AS segment, CAST(min(n) + 1 AS INT) AS start_line, CAST(max(n) + 1 AS INT) AS end_line, md5(regexp_replace(string_agg(line, chr(10) ORDER BY n), '\\s+$', '')) AS content FROM s GROUP BY ALL HAVING length(regexp_replace(string_agg(line, chr(10) ORDER BY n), '\\s+$', '')) > 0""")  # fmt: skip
def t1(spark, d):
    return C.segments(as_code(spark, d)).withColumn("content", F.md5("content"))


@query("t2_packed_chunks")
def t2(spark, d):
    """All chunks of documents at most 500 characters long where lines allow, with 160 characters of overlap; tests hold the fold against a second implementation."""
    return C.split_code(as_code(spark, d), size=500, overlap=160)


@query("t3_chunk_metadata", r"SELECT doc_id AS id, 0 AS chunk, 1 AS start_line, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INT) AS end_line, lower(lang) AS language, md5(regexp_replace(text, '\s+$', '')) AS content FROM documents WHERE length(text) > 0")
def t3(spark, d):
    """Documents as single chunks of a language without declarations: lines from 1, inclusive."""
    rows = wide_table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("code"), "lang")
    return C.split_code(rows, size=1 << 30).select("id", "chunk", "start_line", "end_line", "language", F.md5("content").alias("content"))


#: Code for each line of a document, by the document's number: @N stands for a name from the line, @S for its text in strings, @T for the line as it is.
PROGRAMS = {
    "typescript": """export async function fn@N({ a, b } = { a: 1 }, s: { t: number }): Promise<{ ok: boolean }> { // @T
  return absent_@N(`@S ${a ? absent_@N("}") : '{'} @S`) / 2; /* @S */
}
class C@N extends Base@N<{ x: number }> implements I@N { m@N({ a }) { const r = /[{"]@S/; this.fn@N(a); } }
""",
    "javascript": """const f@N = async ({ a }) => { // @T
  if (a) /}{/.test("@S"); return `@S${(() => { return f@N(a) })()}`;
};
""",
    "python": '''class C@N(Base@N, metaclass=M):  # @T
    def m@N(self, a=(1,
            2)):
        """@S def no(:"""
        return self.f@N("@S")
async def f@N(): return absent_@N()
''',
    "go": """type T@N struct { n int } // @T
func (t *T@N) M@N(f func(int) int, m map[string]struct{}) (interface{}, error) {
  return M@N(`@S`, "}"), nil
}
""",
    "rust": """struct P@N<'a> { x: &'a str } // @T
fn f@N<'a, F: Fn(i32) -> bool>(x: &'a str, f: F) -> Result<&'a str, ()> where F: Fn(i32) -> bool {
  f@N(r#"@S"}"#, '{', b'}'); absent_@N!(x)
}
""",
    "java": """class A@N<T> extends B@N<T> implements I@N { // @T
  public A@N(int x) { absent_@N("@S"); }
  @Over(x = 1) public <T> List<T> get@N(Map<String, T> m) throws E, F { return get@N('{', m); }
}
""",
    "cpp": """#include "h@N.h"
class A@N : public B@N { int x{1}; public: A@N(int y) : x{y} { absent_@N("@S"); } }; // @T
static std::vector<int> f@N(const std::map<int, std::string>& m) { return f@N(R"(@S)")[0]; }
""",
    "csharp": """using N@N.Text; // @T
class A@N : B@N { int X => absent_@N(1); A@N(int x) : base(x) { absent_@N(@"@S""}"); } T F@N<T>(T t) where T : class { return F@N<int>(t); } }
""",
}
#: And after the last line: a function of the file (@M), which calls that of the document with the next id (@P).
_LAST = {
    "typescript": "function shared@M() { shared@P(); }\n", "javascript": "function shared@M() { shared@P(); }\n", "python": "def shared@M(): shared@P()\n", "go": "func shared@M() { shared@P() }\n",
    "rust": "fn shared@M() { shared@P() }\n", "java": "void shared@M() { shared@P(); }\n", "cpp": "void shared@M() { shared@P(); }\n", "csharp": "void shared@M() { shared@P(); }\n",
}
#: What a line declares: kind, name, parent; and its edges: from, to, kind, line, and score and target of a call that an index resolves.
_DECLARED = {
    "typescript": [("function", "fn@N", ""), ("class", "C@N", ""), ("method", "m@N", "C@N")],
    "javascript": [("arrow_function", "f@N", "")],
    "python": [("class", "C@N", ""), ("method", "m@N", "C@N"), ("function", "f@N", "")],
    "go": [("class", "T@N", ""), ("function", "M@N", "")],
    "rust": [("class", "P@N", ""), ("function", "f@N", "")],
    "java": [("class", "A@N", ""), ("constructor", "A@N", "A@N"), ("method", "get@N", "A@N")],
    "cpp": [("class", "A@N", ""), ("constructor", "A@N", "A@N"), ("function", "f@N", "")],
    "csharp": [("class", "A@N", ""), ("constructor", "A@N", "A@N"), ("method", "F@N", "A@N")],
}
_EDGES = {
    "typescript": [("fn@N", "absent_@N", "calls", 2, 0, ""), ("fn@N", "absent_@N", "calls", 2, 0, ""), ("C@N", "Base@N", "extends", 4, 0, ""), ("C@N", "I@N", "implements", 4, 0, ""), ("C@N.m@N", "fn@N", "calls", 4, 0.95, "fn@N")],
    "javascript": [("f@N", "test", "calls", 2, 0, ""), ("f@N", "f@N", "calls", 2, 0.95, "f@N")],
    "python": [("C@N", "Base@N", "extends", 1, 0, ""), ("C@N.m@N", "f@N", "calls", 5, 0.95, "f@N"), ("f@N", "absent_@N", "calls", 6, 0, "")],
    "go": [("M@N", "m@N", "calls", 3, 0.85, "M@N")],
    "rust": [("f@N", "f@N", "calls", 3, 0.95, "f@N"), ("f@N", "absent_@N", "calls", 3, 0, "")],
    "java": [("A@N", "B@N", "extends", 1, 0, ""), ("A@N", "I@N", "implements", 1, 0, ""), ("A@N.A@N", "absent_@N", "calls", 2, 0, ""), ("A@N.get@N", "get@N", "calls", 3, 0.95, "A@N.get@N")],
    "cpp": [("", "h@N.h", "imports", 1, 0, ""), ("A@N", "B@N", "extends", 2, 0, ""), ("A@N.A@N", "absent_@N", "calls", 2, 0, ""), ("f@N", "f@N", "calls", 3, 0.95, "f@N")],
    "csharp": [("", "N@N.Text", "imports", 1, 0, ""), ("A@N", "B@N", "extends", 2, 0, ""), ("A@N.A@N", "absent_@N", "calls", 2, 0, ""), ("A@N.F@N", "f@N", "calls", 2, 0.85, "A@N.F@N")],
}


def _values(rows):
    return ", ".join("(" + ", ".join([str(n), *(repr(x) if isinstance(x, str) else str(x) for x in r)]) + ")" for n, of in enumerate(rows.values()) for r in of)


def programs(spark, d):
    """id, code, lang, stem of a file made from the whole text of each document, in one of eight languages."""
    docs = wide_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    at = (F.col("id") % len(PROGRAMS)).cast("int")
    names, units, lasts = (F.get(F.array(*map(F.lit, x)), at) for x in (PROGRAMS, PROGRAMS.values(), _LAST.values()))

    def unit(line, k):
        name = F.concat_ws("_", F.col("id"), k, F.lower(F.regexp_extract(line, "[A-Za-z]+", 0)))
        plain = F.regexp_replace(line, "[^A-Za-z0-9 {}();<>=:.,]", "")
        return F.replace(F.replace(F.replace("__unit", F.lit("@N"), name), F.lit("@S"), plain), F.lit("@T"), line)

    last = F.replace(F.replace(lasts, F.lit("@M"), F.md5(F.col("id").cast("string"))), F.lit("@P"), F.md5((F.col("id") + 1).cast("string")))
    code = F.concat(F.array_join(F.transform(F.split("text", "\n"), unit), ""), last)
    return docs.withColumn("__unit", units).select("id", code.alias("code"), names.alias("lang"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("stem"))


_N, _LINES = len(PROGRAMS), [p.count("\n") for p in PROGRAMS.values()]
#: Lines of documents with their names, symbols and edges of the files made of them.
_UNITS = f"""l AS (SELECT doc_id AS id, doc_id % {_N} AS n, generate_subscripts(ls, 1) - 1 AS k, unnest(ls) AS line, len(ls) AS lines FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
u AS (SELECT id, n, k, lines, id || '_' || k || '_' || lower(regexp_extract(line, '[A-Za-z]+')) AS nm FROM l),
s(n, kind, name, parent) AS (VALUES {_values(_DECLARED)}),
e(n, src, dst, kind, line, score, target) AS (VALUES {_values(_EDGES)}),
m AS (SELECT DISTINCT id, n, lines, md5(id::VARCHAR) AS own, md5((id + 1)::VARCHAR) AS other FROM u),
sym AS (SELECT id, kind, replace(name, '@N', nm) AS name, replace(parent, '@N', nm) AS parent FROM u JOIN s USING (n) UNION ALL SELECT id, 'function', 'shared' || own, '' FROM m),
edge AS (SELECT id, replace(src, '@N', nm) AS src, replace(dst, '@N', nm) AS dst, kind, (k * {_LINES!r}[n + 1] + line)::INT AS line, score, CASE WHEN target <> '' THEN 'f' || id || '.' || replace(target, '@N', nm) END AS target FROM u JOIN e USING (n)
  UNION ALL SELECT id, 'shared' || own, 'shared' || other, 'calls', (lines * {_LINES!r}[n + 1] + 1)::INT, 0.85, 'f' || (id + 1) || '.shared' || other FROM m)"""


@query("t4_symbols", f"WITH {_UNITS} SELECT id, kind, name, CASE WHEN parent <> '' THEN 'f' || id || '.' || parent END AS parent, 'f' || id || CASE WHEN parent <> '' THEN '.' || parent ELSE '' END || '.' || name AS qualified_name FROM sym")
def t4(spark, d):
    """Classes, methods, interfaces, types and functions, nested ones too, of files in eight languages."""
    return C.extract_symbols(programs(spark, d)).select("id", "kind", "name", "parent", "qualified_name")


@query("t5_edges", f"WITH {_UNITS} SELECT id, 'f' || id || CASE WHEN src <> '' THEN '.' || src ELSE '' END AS src_qn, dst AS dst_qn, kind, CASE kind WHEN 'calls' THEN 0.8 ELSE 1.0 END::DOUBLE AS confidence, line FROM edge")
def t5(spark, d):
    """Imports, inheritance and calls of the same files."""
    return C.extract_edges(programs(spark, d))


_INDEXES = {}


def indexed(spark, d):
    """The index after the files of odd documents, those of even ones, a batch in which one file in seven is another, and that batch again. A file calls a function of the next document's."""
    if (spark.sparkContext.applicationId, d) in _INDEXES:  # three queries read the tables of one index
        return _INDEXES[spark.sparkContext.applicationId, d]
    index, files = I.empty_index(spark), programs(spark, d).withColumn("path", F.concat_ws("/", "lang", "stem"))
    changed = files.where("id % 7 = 0").withColumn("code", F.lit("class New {\n  run() { help(); }\n}\nfunction help() {}\n")).withColumn("lang", F.lit("typescript"))
    for batch in (files.where("id % 2 = 1"), files.where("id % 2 = 0"), changed, changed):
        index = I.index_files(batch, index, size=1 << 30)
    _INDEXES[spark.sparkContext.applicationId, d] = index
    return index


_NEW = "id % 7 = 0"
#: Lines of a unit, from 0, that begin a chunk. The last function does but in Java and C#.
_BEGINS = {"typescript": [0, 3], "javascript": [0], "python": [0, 1, 5], "go": [0], "rust": [0, 1], "java": [1], "cpp": [2], "csharp": []}
_INDEX = f"""{_UNITS},
f AS (SELECT id, n, lines, {list(PROGRAMS)!r}[n + 1] || '/f' || id AS path FROM m),
x AS (SELECT id, kind, name, parent FROM sym WHERE NOT {_NEW}
  UNION ALL SELECT id, kind, name, parent FROM f, (VALUES ('class', 'New', ''), ('method', 'run', 'New'), ('function', 'help', '')) v(kind, name, parent) WHERE {_NEW}),
y AS (SELECT id, kind, 'f' || id || '.' || CASE WHEN parent <> '' THEN parent || '.' ELSE '' END || name AS qn, CASE WHEN parent <> '' THEN 'f' || id || '.' || parent END AS pqn FROM x)"""


@query("index_symbols", f"WITH {_INDEX} SELECT path, kind, qn AS qualified_name, pqn AS parent FROM y JOIN f USING (id)")
def index_symbols(spark, d):
    """Symbols of an index over four batches, with their parents."""
    s = indexed(spark, d)["symbols"]
    return s.alias("s").join(s.select(F.col("id").alias("p"), F.col("qualified_name").alias("parent")), F.col("s.parent_id") == F.col("p"), "left").select("path", "kind", "qualified_name", "parent")


@query("index_edges", f"""WITH {_INDEX}
SELECT DISTINCT 'f' || id || '.' || src AS src, target AS dst, score::DOUBLE AS confidence FROM edge JOIN (SELECT qn AS target FROM y) USING (target) WHERE NOT {_NEW}
UNION ALL SELECT 'f' || id || '.New.run', 'f' || id || '.help', 0.95::DOUBLE FROM f WHERE {_NEW}""")  # fmt: skip
def index_edges(spark, d):
    """Calls that the index resolved, late ones and ones whose target went too; those to names that no file declares, or many do alike, are not held."""
    index = indexed(spark, d)
    s = index["symbols"]
    ends = index["edges"].where("kind = 'calls'").join(s.select(F.col("id").alias("src"), F.col("qualified_name").alias("a")), "src").join(s.select(F.col("id").alias("dst"), F.col("qualified_name").alias("b")), "dst")
    return ends.select(F.col("a").alias("src"), F.col("b").alias("dst"), "confidence")


@query("index_chunks", f"""WITH {_INDEX},
b AS (SELECT path, 0 AS begins FROM f UNION SELECT path, k * {_LINES!r}[n + 1] + unnest(({list(_BEGINS.values())!r}::INT[][])[n + 1]) FROM u JOIN f USING (id, n, lines) WHERE NOT {_NEW}
  UNION SELECT path, lines * {_LINES!r}[n + 1] FROM f WHERE NOT {_NEW} AND NOT starts_with(path, 'java/') AND NOT starts_with(path, 'csharp/') UNION SELECT path, 3 FROM f WHERE {_NEW}),
z AS (SELECT path, CASE WHEN {_NEW} THEN 5 ELSE lines * {_LINES!r}[n + 1] + 2 END AS total FROM f)
SELECT path, (row_number() OVER w - 1)::INT AS chunk, coalesce(lead(begins) OVER w, total)::INT AS end_line, row_number() OVER w = 1 AS bare FROM b JOIN z USING (path) WINDOW w AS (PARTITION BY path ORDER BY begins)""")  # fmt: skip
def index_chunks(spark, d):
    """Chunks of all files after four batches."""
    return indexed(spark, d)["chunks"].select("path", "chunk", "end_line", (F.col("chunk") == 0).alias("bare"))


#: Documents read as code with branches: some words and commas become ones.
_BRANCHY = [(", ", " && "), (" that ", " if ("), (" the ", " case "), (" in ", " while (")]


def _replaced(text, pairs):
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _replaced_sql(text, pairs):
    for old, new in pairs:
        text = f"replace({text}, {sql_text(old)}, {sql_text(new)})"
    return text


def sql_text(text):
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_COUNTED = " + ".join(f"len(regexp_extract_all(body, {sql_text(p)}))" for p in C.BRANCHES)


@query("t6_complexity", f"""WITH c AS (SELECT doc_id AS id, string_split({_replaced_sql(_SQL_CODE, _BRANCHY)}, chr(10)) AS ls FROM documents),
f AS (SELECT id, ls, n, regexp_extract(ls[n], '^function (\\w+)', 1) AS name FROM (SELECT id, ls, unnest(range(1, len(ls) + 1)) AS n FROM c) WHERE regexp_matches(ls[n], '^function (The|And)')),
b AS (SELECT id, name, n, array_to_string(ls[n:n + {C.BODY_LINES - 1}], chr(10)) AS body FROM f)
SELECT id, name, n::INT AS line, (1 + {_COUNTED})::INT AS complexity FROM b""")  # fmt: skip
def t6(spark, d):
    """Functions of documents read as code, with the branches in the 150 lines from each on."""
    rows = as_code(spark, d)
    return C.function_complexity(rows.select("id", _replaced(F.col("code"), _BRANCHY).alias("code")))


#: Documents read as code with exports, switches, wide interfaces and constructors that make things.
_DESIGNED = [("\n", "\nexport function x"), (" that ", "\nswitch (a.kind) "), (" with ", " constructor() { new Thing(); } "), (" the ", "\n"), (". ", " }\ninterface I { "), (" ", "( "), ("export( function( ", "export function "), ("switch( ", "switch "), ("interface( I( {", "interface I {"), ("new( ", "new ")]


@query("t8_design_checks", f"""WITH c AS (SELECT doc_id AS id, {_replaced_sql("text", _DESIGNED)} AS t FROM documents),
x AS (SELECT id, len(string_split(t, chr(10))) AS lines, len(regexp_extract_all(t, '\\bpublic\\s+\\w+\\s*\\(')) + len(regexp_extract_all(t, '(?m)^export\\s+(?:async\\s+)?function\\s+')) AS exports,
  len(regexp_extract_all(t, 'switch\\s*\\(\\s*\\w+\\.(?:type|kind|variant)\\s*\\)')) AS switches, regexp_extract_all(t, 'interface\\s+\\w+\\s*\\{{[^}}]+\\}}') AS bodies, len(regexp_extract_all(t, 'constructor[^{{]*\\{{[^}}]*new\\s+[A-Z]\\w+\\s*\\(')) AS made FROM c)
SELECT id, 'SRP' AS principle, 'medium' AS severity, exports::INT AS n FROM x WHERE lines > 400 AND exports > 10
UNION ALL SELECT id, 'OCP', 'low', switches::INT FROM x WHERE switches > 2
UNION ALL SELECT id, 'ISP', 'medium', n::INT FROM (SELECT id, len(regexp_extract_all(unnest(bodies), '\\w+\\s*[(<:]')) AS n FROM x) WHERE n > 8
UNION ALL SELECT id, 'DIP', 'high', made::INT FROM x WHERE made > 0""")  # fmt: skip
def t8(spark, d):
    """Design checks of documents read as code."""
    rows = wide_table(spark, d, "documents").select(F.col("doc_id").alias("id"), _replaced(F.col("text"), _DESIGNED).alias("code"))
    return C.design_violations(rows)


_W = r"""WITH l AS (SELECT id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, '//') AND NOT starts_with(x, '*')) AS ls FROM (SELECT doc_id AS id, text FROM documents)),
w AS (SELECT id, unnest(range(1, len(ls) - 6)) AS i, ls FROM l WHERE len(ls) >= 8),
t AS (SELECT id, CAST(i AS INT) AS start_line, trim(regexp_replace(array_to_string(ls[i:i + 7], chr(10)), '\s+', ' ', 'g')) AS t FROM w),
h AS (SELECT id, start_line, substr(sha256(t), 1, 16) AS hash FROM t WHERE length(t) >= 30),
d AS (SELECT hash, count(*) AS occurrences FROM h GROUP BY hash HAVING count(*) > 1)
"""


def as_lines(spark, d):
    return wide_table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("code"))


@query("w4_line_windows", _W + "SELECT id, start_line, hash FROM h")
def w4(spark, d):
    return C.line_windows(as_lines(spark, d))


@query("a10_duplicate_groups", _W + "SELECT h.id, start_line, hash, occurrences FROM h JOIN d USING (hash)")
def a10(spark, d):
    return C.duplicate_blocks(C.line_windows(as_lines(spark, d)))


@query("a11_duplicate_rate", _W + "SELECT (SELECT count(*) FROM d) AS duplicates, (SELECT sum(len(ls))::BIGINT FROM l) AS lines, round((SELECT count(*) FROM d) * 8 / (SELECT sum(len(ls)) FROM l), 6) AS rate")
def a11(spark, d):
    return C.duplicate_rate(as_lines(spark, d)).withColumn("rate", F.round("rate", 6))


@query("t7_duplication", _W + "SELECT hash, occurrences, min(h.id) AS first_id FROM h JOIN d USING (hash) GROUP BY ALL")
def t7(spark, d):
    """Duplicated blocks with the first document that holds each."""
    return C.duplicate_blocks(C.line_windows(as_lines(spark, d))).groupBy("hash", "occurrences").agg(F.min("id").alias("first_id"))


@query("a12_solid_score", "SELECT user_id, greatest(0, 100 - 5 * count(*) FILTER (event_type = 'error'))::BIGINT AS score FROM events GROUP BY user_id")
def a12(spark, d):
    """Five points off for each violation; errors stand for violations."""
    return table(spark, d, "events").groupBy("user_id").agg(A.solid_score(F.count_if(F.col("event_type") == "error")).alias("score"))


@query("a13_quality_gate", "SELECT p_brand AS file, max(p_size) <= 49 AND avg(CASE WHEN p_type = 'ECONOMY' THEN 1.0 ELSE 0.0 END) <= 0.2 AND 100 - 5 * count(*) FILTER (p_size = 50) >= 60 AS passed FROM part GROUP BY p_brand")
def a13(spark, d):
    """Complexity, duplication and score against their limits; part sizes and types stand for them."""
    rows = table(spark, d, "part").groupBy(F.col("p_brand").alias("file")).agg(F.max("p_size").alias("m"), F.avg((F.col("p_type") == "ECONOMY").cast("double")).alias("r"), A.solid_score(F.count_if(F.col("p_size") == 50)).alias("s"))
    return rows.select("file", A.quality_gate(F.col("m"), F.col("r"), F.col("s"), most=49, rate=0.2).alias("passed"))
