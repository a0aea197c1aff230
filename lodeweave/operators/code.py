"""Source code: splitting, symbols and call edges, complexity, duplication, design checks."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_bounds, match_offsets, running_sums
from ..sources.partitions import text_slices
from .structure import scan_code

#: What begins a top-level declaration, on a left-trimmed line; other languages are read as TypeScript (fixed values).
BOUNDARIES = {
    "typescript": r"^(?:export\s+(?:default\s+)?)?(?:async\s+)?(?:function\*?\s+\w|class\s+\w|interface\s+\w|type\s+\w|enum\s+\w|abstract\s+class\s+\w|const\s+\w|let\s+\w)",
    "javascript": r"^(?:export\s+(?:default\s+)?)?(?:async\s+)?(?:function\*?\s+\w|class\s+\w|const\s+\w|let\s+\w|var\s+\w)",
    "python": r"^(?:async\s+)?(?:def|class)\s+\w",
    "java": r"^(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+.*\s+\w+\s*[({]",
    "go": r"^(?:func|type|var|const)\s+\w",
    "rust": r"^(?:pub(?:\s*\([^)]*\))?\s+)?(?:fn|struct|enum|trait|impl|type|const|static|mod)\s+\w",
    "cpp": r"^(?:[\w:*&<>]+\s+)+\w+\s*\(",
    "csharp": r"^(?:(?:public|private|protected|internal|static|abstract|virtual|override|sealed)\s+)+\w",
}


def is_boundary(line: Column, lang: Column) -> Column:
    trimmed = F.regexp_replace(line, r"^\s+", "")
    out = trimmed.rlike(BOUNDARIES["typescript"])
    for name, pattern in BOUNDARIES.items():
        out = F.when(F.lower(lang) == name, trimmed.rlike(pattern)).otherwise(out)
    return out


def segments(files: DataFrame, id_col: str = "id", code: str = "code", lang: str = "lang") -> DataFrame:
    """Declaration segments of each file: ``segment`` (from 1), ``start_line``, ``end_line`` (from 1, inclusive), ``content`` without trailing blanks; empty ones are dropped.

    Arrays of a file's lines and of the numbers of those that begin a declaration: no shuffle.
    """
    rows = files.select(id_col, F.col(lang).alias("__lang"), F.split(code, "\n").alias("__lines"))
    begins = F.transform("__lines", lambda x, i: F.when((i == 0) | is_boundary(x, F.col("__lang")), i))
    rows = rows.select(id_col, "__lines", F.filter(begins, lambda i: i.isNotNull()).alias("__at"))
    after = lambda k: F.coalesce(F.get("__at", k + 1), F.size("__lines"))
    text = lambda i, k: F.regexp_replace(F.array_join(F.slice("__lines", i + 1, after(k) - i), "\n"), r"\s+\z", "")
    each = F.transform("__at", lambda i, k: F.struct((k + 1).cast("long").alias("segment"), (i + 1).alias("start_line"), after(k).alias("end_line"), text(i, k).alias("content")))
    return rows.select(id_col, F.explode(each).alias("s")).select(id_col, "s.*").where(F.length("content") > 0)


class Chunk(NamedTuple):
    """Text, first and last line."""

    text: str
    first: int
    last: int


def split_text(code: str, lang: str, size: int = 2500, overlap: int = 300) -> list[Chunk]:
    """Chunks of a file: its declaration segments, those longer than ``size`` as line windows, each with the end of the one before in front.

    A file without any text but blanks is cut into windows as a whole. A chunk's first line moves up by the lines it takes over.
    """
    begins = re.compile(BOUNDARIES.get(lang.lower(), BOUNDARIES["typescript"]))
    lines = code.split("\n")
    edges = [0, *(i for i, line in enumerate(lines) if i and begins.match(line.lstrip())), len(lines)]
    bare = []
    for a, b in itertools.pairwise(edges):
        whole = Chunk("\n".join(lines[a:b]).rstrip(), a + 1, b)
        bare += [whole] * bool(whole.text) if len(whole.text) <= size else line_chunks(whole, size, overlap)
    bare = bare or line_chunks(Chunk(code, 1, len(lines)), size, overlap)
    ends = [x.text[-overlap:] if overlap > 0 else None for x in bare]
    return bare[:1] + [x if end is None else Chunk(f"{end}\n{x.text}", max(1, x.first - 1 - end.count("\n")), x.last) for end, x in zip(ends, bare[1:], strict=False)]


def line_chunks(part: Chunk, size: int, overlap: int) -> list[Chunk]:
    """Windows of whole lines of at most ``size`` characters, line breaks included, or of one longer line.

    The lengths are added up once, and for every line a binary search over the sums gives where a window that begins
    there ends. A window begins ``overlap // 80`` lines, one at least, before the last one's end, but after its begin.
    """
    lines = part.text.split("\n")
    sums = np.cumsum([0, *(len(x) + 1 for x in lines)])
    here = np.arange(len(lines))
    stop = np.maximum(here + 1, np.searchsorted(sums, sums[:-1] + size, "right") - 1)
    then = np.maximum(here + 1, stop - max(1, overlap // 80))
    windows, at = [], 0
    while at < len(lines):
        windows.append((at, int(stop[at])))
        at = int(then[at])
    cut = [Chunk(part.text[sums[a] : sums[b] - 1].rstrip(), part.first + a, part.first + b - 1) for a, b in windows]
    return [x for x in cut if x.text]


def split_code(files: DataFrame, id_col: str = "id", code: str = "code", lang: str = "lang", size: int = 2500, overlap: int = 300) -> DataFrame:
    """``id_col``, ``chunk`` (from 0), ``content``, ``start_line``, ``end_line``, ``language`` for each chunk of each file. A map over the files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            ids = batch.column(0).to_pylist()
            rows = [(i, n, *c, (g or "typescript").lower()) for i, t, g in zip(ids, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True) for n, c in enumerate(split_text(t or "", g or "", size, overlap))]
            kinds = [batch.schema[0].type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[id_col, "chunk", "content", "start_line", "end_line", "language"])

    part = files.select(id_col, code, lang)
    return part.mapInArrow(run, f"`{id_col}` {part.schema[0].dataType.simpleString()}, chunk int, content string, start_line int, end_line int, language string")


def _per_file(files: DataFrame, id_col: str, which: int, names: list[str], kinds: list[pa.DataType], schema: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            rows = [(i, *r) for i, *f in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in scan_code(*(x or "" for x in f))[which]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([batch.schema[0].type, *kinds])], names=[id_col, *names])

    part = files.select(id_col, "code", "lang", "stem")
    return part.mapInArrow(run, f"`{id_col}` {part.schema[0].dataType.simpleString()}, {schema}")


def extract_symbols(files: DataFrame, id_col: str = "id") -> DataFrame:
    """``files``: id, code, lang, stem; null code is empty, a null or unknown language read as TypeScript. A map over the files, linear in each."""
    s, n = pa.string(), pa.int32()
    return _per_file(files, id_col, 0, ["kind", "name", "qualified_name", "parent", "start", "end", "start_line", "end_line"], [s, s, s, s, n, n, n, n], "kind string, name string, qualified_name string, parent string, start int, end int, start_line int, end_line int")


def extract_edges(files: DataFrame, id_col: str = "id") -> DataFrame:
    """imports, extends, implements (confidence 1) and calls (0.8, last member name in lower case)."""
    s = pa.string()
    return _per_file(files, id_col, 1, ["src_qn", "dst_qn", "kind", "confidence", "line"], [s, s, s, pa.float64(), pa.int32()], "src_qn string, dst_qn string, kind string, confidence double, line int")


#: A file's symbols and edges in one table: columns of the other kind are null.
FACTS = "kind string, name string, qualified_name string, parent string, start int, end int, start_line int, end_line int, src_qn string, dst_qn string, confidence double"


def extract_facts(files: DataFrame, id_col: str = "id") -> DataFrame:
    """Symbols (``qualified_name`` is set), of equal qualified names in a file the last, and edges from these (``src_qn`` is set), each once.

    One pass over each file: no shuffle. ``id_col`` is unique.
    """
    s, n = pa.string(), pa.int32()
    kinds = [s, s, s, s, n, n, n, n, s, s, pa.float64()]

    def facts(code: str | None, lang: str | None, stem: str | None) -> Iterator[tuple]:
        symbols, edges = scan_code(code or "", lang or "", stem or "")
        last = {x[2]: x for x in sorted(symbols, key=lambda x: x[4])}
        yield from ((*x, None, None, None) for x in last.values())
        for src, dst, kind, confidence in dict.fromkeys(tuple(x[:4]) for x in edges):
            if src in last:
                yield (kind, *[None] * 7, src, dst, confidence)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            rows = [(i, *r) for i, *f in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in facts(*f)]
            names = [id_col, *(x.split()[0] for x in FACTS.split(", "))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([batch.schema[0].type, *kinds])], names=names)

    part = files.select(id_col, "code", "lang", "stem")
    return part.mapInArrow(run, f"`{id_col}` {part.schema[0].dataType.simpleString()}, {FACTS}")


#: Where a function starts, and what counts as a branch (fixed values).
FUNCTION = r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[^=]+)\s*=>)"
BRANCHES = [r"\bif\s*\(", r"\belse\s+if\s*\(", r"\bfor\s*\(", r"\bwhile\s*\(", r"\bcase\s+", r"\bcatch\s*\(", r"\?\s*[^:]", r"&&|\|\|"]
BODY_LINES = 150


def function_complexity(files: DataFrame, id_col: str = "id", code: str = "code") -> DataFrame:
    """``id_col``, ``name``, ``line``, ``complexity``: 1 and the branches in the 150 lines from each function's start on.

    A file's lines and where they begin are arrays, from which a function takes its own 150 only.
    """
    rows = files.select(F.col(id_col), F.split(code, "\n").alias("__lines"), match_offsets(F.col(code), FUNCTION, lines=True).alias("__found")).where(F.size("__found") > 0)
    rows = rows.withColumn("__ends", running_sums(F.transform("__lines", lambda x: F.length(x) + 1)))

    def body(m: Column) -> Column:
        begin = F.when(m["line"] > 1, F.get("__ends", m["line"] - 2)).otherwise(0)
        first = F.get("__lines", m["line"] - 1)
        return F.array_join(F.concat(F.array(F.substr(first, m["start"] - begin + 1)), F.slice("__lines", m["line"] + 1, F.lit(BODY_LINES - 1))), "\n")

    rows = rows.select(id_col, F.explode(F.transform("__found", lambda m: F.struct(m["text"].alias("text"), m["line"].alias("line"), body(m).alias("body")))).alias("m"))
    name = F.coalesce(*(F.when(g != "", g) for g in (F.regexp_extract("m.text", FUNCTION, i) for i in (1, 2))), F.lit("<anonymous>"))
    branches = reduce(lambda a, b: a + b, [F.regexp_count("m.body", F.lit(ascii_bounds(p))) for p in BRANCHES])
    return rows.select(id_col, name.alias("name"), "m.line", (branches + 1).alias("complexity"))


WINDOW_LINES, LEAST_LENGTH = 8, 30


def code_lines(code: Column) -> Column:
    """Trimmed lines without empty ones and those that begin as comments."""
    trimmed = F.transform(F.split(code, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda x: (x != "") & ~x.startswith("//") & ~x.startswith("*"))


def line_windows(files: DataFrame, id_col: str = "id", code: str = "code") -> DataFrame:
    """``id_col``, ``start_line`` (of the filtered lines), ``hash`` of each run of eight lines with white space collapsed, at least 30 characters long."""
    lines = files.select(id_col, code_lines(F.col(code)).alias("lines")).where(F.size("lines") >= WINDOW_LINES)
    starts = F.sequence(F.lit(1), F.size("lines") - (WINDOW_LINES - 1))
    text = lambda i: F.trim(F.regexp_replace(F.array_join(F.slice("lines", i, F.lit(WINDOW_LINES)), "\n"), r"\s+", " "))
    each = lines.select(id_col, F.explode(F.transform(starts, lambda i: F.struct(i.alias("start_line"), text(i).alias("t")))).alias("w"))
    return each.where(F.length("w.t") >= LEAST_LENGTH).select(id_col, "w.start_line", F.substring(F.sha2("w.t", 256), 1, 16).alias("hash"))


def duplicate_blocks(windows: DataFrame) -> DataFrame:
    """The windows whose hash occurs twice or more, with ``occurrences``; a row each, so that a frequent block stays spread."""
    often = windows.groupBy("hash").agg(F.count("*").alias("occurrences")).where("occurrences > 1")
    return windows.join(often, "hash")


def duplicate_rate(files: DataFrame, id_col: str = "id", code: str = "code") -> DataFrame:
    """(duplicates, lines, rate): eight lines for every duplicated hash over all filtered lines; the rate can exceed 1."""
    hashes = line_windows(files, id_col, code).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("duplicates"))
    total = files.agg(F.coalesce(F.sum(F.size(code_lines(F.col(code)))), F.lit(0)).cast("long").alias("lines"))
    both = hashes.join(F.broadcast(total))  # a row each
    return both.withColumn("rate", F.when(F.col("lines") > 0, F.col("duplicates") * WINDOW_LINES / F.col("lines")).otherwise(0.0))


def design_violations(files: DataFrame, id_col: str = "id", code: str = "code") -> DataFrame:
    """``id_col``, ``principle``, ``severity``, ``n``: responsibilities, switches on type, wide interfaces, ``new`` in constructors (limits are fixed values)."""
    src = F.col(code)
    lines = F.length(src) - F.length(F.replace(src, F.lit("\n"), F.lit(""))) + 1
    exports = F.regexp_count(src, F.lit(ascii_bounds(r"\bpublic\s+\w+\s*\("))) + F.regexp_count(src, F.lit(r"(?m)^export\s+(?:async\s+)?function\s+"))
    switches = F.regexp_count(src, F.lit(r"switch\s*\(\s*\w+\.(?:type|kind|variant)\s*\)"))
    members = F.transform(F.regexp_extract_all(src, F.lit(r"interface\s+\w+\s*\{[^}]+\}"), F.lit(0)), lambda b: F.regexp_count(b, F.lit(r"\w+\s*[(<:]")))
    made = F.size(F.regexp_extract_all(src, F.lit(r"constructor[^{]*\{[^}]*new\s+[A-Z]\w+\s*\("), F.lit(0)))
    one = lambda p, s, n: F.struct(F.lit(p).alias("principle"), F.lit(s).alias("severity"), n.cast("int").alias("n"))
    none = F.array().cast("array<struct<principle:string,severity:string,n:int>>")
    found = F.concat(
        F.when((lines > 400) & (exports > 10), F.array(one("SRP", "medium", exports))).otherwise(none),
        F.when(switches > 2, F.array(one("OCP", "low", switches))).otherwise(none),
        F.transform(F.filter(members, lambda n: n > 8), lambda n: one("ISP", "medium", n)),
        F.when(made > 0, F.array(one("DIP", "high", made))).otherwise(none),
    )
    return files.select(id_col, F.explode(found).alias("v")).select(id_col, "v.*")
