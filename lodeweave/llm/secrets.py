"""Secret scans with a trigram inverted index.

Each block of texts gets an inverted index: for every byte trigram of the texts, with A-Z lowered, the sorted
numbers of the texts that hold it. From each rule's regex a Boolean query over trigrams is derived: every match
contains the trigrams of at least one alternative. Postings are intersected and united as the query says, and only
candidate texts are verified with the regex. A rule whose regex has no mandatory trigram scans every text. The
index is per block, as an index of segments: no shuffle, and a lost executor costs its blocks only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import documents, map_arrow

#: Kind, pattern, letters in either case, group that is measured, its least length. The base rules come first.
BASE_RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", False, 0, 20),
    ("hex", r"[0-9a-f]+", False, 0, 24),
]
#: Rules that the method adds, by published token formats.
MORE_RULES = [
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False, 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", False, 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", False, 0, 20),
    ("google", r"AIza[A-Za-z0-9_-]+", False, 0, 39),
    ("stripe", r"[sr]k_(?:live|test)_[A-Za-z0-9]+", False, 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 0, 0),
    ("url_password", r"[a-z][a-z0-9+.]*://[A-Za-z0-9_.~-]+:[^\s:@/]+@", False, 0, 0),
]
#: The same matches in time linear in the text, where the plain pattern looks at a run of letters again from each of them:
#: from the start of the run, its first letters that can begin a match, and the match as group ``s``.
LINEAR = {
    "jwt": r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(?P<s>eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++)",
    "url_password": r"(?<![a-z0-9+.])[0-9+.]*+(?P<s>[a-z][a-z0-9+.]*+://[A-Za-z0-9_.~-]++:[^\s:@/]++@)",
}
#: A part of a regex keeps its exact strings up to this many; a query has at most this many alternatives.
MOST_STRINGS, MOST_SETS = 64, 1024
#: Bytes of texts indexed at a time.
INDEX_BYTES = 1 << 20

Query = frozenset[frozenset[str]]  # any of these sets of trigrams, all of a set; an empty set: no condition
ANY: Query = frozenset([frozenset()])


def _both(a: Query, b: Query) -> Query:
    return frozenset(x | y for x in a for y in b) if len(a) * len(b) <= MOST_SETS else (a if b == ANY else b)


def _of_strings(strings: Iterable[str]) -> Query:
    """What the texts around any of these strings must contain."""
    sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
    return ANY if not sets or any(not x for x in sets) else frozenset(sets)


class _Part:
    """A piece of a regex: the exact strings it can match, or None, and the query that every match satisfies."""

    def __init__(self, strings: set[str] | None, query: Query = ANY):
        self.strings, self.query = strings, query

    def whole(self) -> Query:
        return self.query if self.strings is None else _both(self.query, _of_strings(self.strings))


class _Regex:
    """Reads the syntax that rules use: literals, escapes, classes, groups, ``|``, ``? * +``; anything else is a ValueError."""

    CLASSES = {"s": " \t\n\r\f\v", "d": "0123456789"}

    def __init__(self, pattern: str):
        self.rest = pattern

    def query(self) -> Query:
        out = self.either().whole()
        if self.rest:
            raise ValueError(f"unbalanced: {self.rest}")
        return frozenset(x for x in out if not any(y < x for y in out))  # a smaller set says more

    def take(self, text: str) -> bool:
        if hit := self.rest.startswith(text):
            self.rest = self.rest[len(text) :]
        return hit

    def next(self) -> str:
        c, self.rest = self.rest[:1], self.rest[1:]
        return c

    def either(self) -> _Part:
        parts = [self.sequence()]
        while self.take("|"):
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        if all(p.strings is not None for p in parts) and sum(len(p.strings) for p in parts) <= MOST_STRINGS:
            return _Part(set().union(*(p.strings for p in parts)))
        return _Part(None, frozenset().union(*(p.whole() for p in parts)))

    def sequence(self) -> _Part:
        held, query, exact = {""}, ANY, True
        while self.rest and self.rest[0] not in "|)":
            part = self.repeated()
            if part.strings is not None and len(held) * len(part.strings) <= MOST_STRINGS:
                held = {a + b for a in held for b in part.strings}
            else:
                query, held, exact = _both(_both(query, _of_strings(held)), part.query), part.strings or {""}, False
        return _Part(held) if exact else _Part(None, _both(query, _of_strings(held)))

    def repeated(self) -> _Part:
        part = self.one()
        if self.take("?"):
            return _Part(part.strings | {""}) if part.strings is not None else _Part(None)
        if self.take("*"):
            return _Part(None)
        return _Part(None, part.whole()) if self.take("+") else part

    def one(self) -> _Part:
        if self.take("("):
            self.take("?:")
            part = self.either()
            if not self.take(")"):
                raise ValueError("open group")
            return part
        if self.take("["):
            chars = self.members()
            return _Part(chars if chars and len(chars) <= 8 else None)
        c = self.next()
        if c == "\\":
            chars = self.escape()
            return _Part(chars if len(chars) <= 8 else None)
        if c in ".^$?*+{}":
            raise ValueError(f"not read: {c}")
        return _Part({c})

    def escape(self) -> set[str]:
        c = self.next()
        if c == "x":
            return {chr(int(self.next() + self.next(), 16))}
        if c in self.CLASSES:
            return set(self.CLASSES[c])
        if c.isalnum():
            raise ValueError(f"not read: {c}")
        return {c}

    def members(self) -> set[str] | None:
        """The characters of a class; None for a negated one."""
        negated, out = self.take("^"), set()
        while not self.take("]"):
            c = self.next()
            if not c:
                raise ValueError("open class")
            chars = self.escape() if c == "\\" else {c}
            if len(chars) == 1 and self.rest[:1] == "-" and self.rest[1:2] != "]":
                self.next()
                chars = {chr(x) for x in range(ord(chars.pop()), ord(self.next()) + 1)}
            out |= chars
        return None if negated else out


def lowered(text: str) -> str:
    return text.lower() if text.isascii() else re.sub("[A-Z]+", lambda m: m.group().lower(), text)


def trigram_query(pattern: str) -> Query:
    """A Boolean query over trigrams, in lower case, that every text with a match satisfies; ANY where there is no mandatory trigram."""
    return frozenset(frozenset(map(lowered, x)) for x in _Regex(pattern).query())


class BlockIndex:
    """For every trigram of the bytes of a block of texts, A-Z lowered, the sorted numbers of the texts that hold it."""

    def __init__(self, texts: list[str]):
        parts, held, size = [], [], 0
        for i, text in enumerate(texts):
            data = text.encode().lower()  # of bytes: ASCII only
            for at in range(0, max(1, len(data) - 2), INDEX_BYTES):
                piece = data[at : at + INDEX_BYTES + 2]
                if size + len(piece) > INDEX_BYTES and held:
                    parts.append(self._pairs(held))
                    held, size = [], 0
                held.append((i, piece))
                size += len(piece)
        parts.append(self._pairs(held))
        pairs = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
        self.codes, self.texts = pairs >> np.uint64(32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)

    @staticmethod
    def _pairs(held: list[tuple[int, bytes]]) -> np.ndarray:
        """Distinct pairs of trigram and text, as sorted numbers."""
        x = np.frombuffer(b"".join(p for _, p in held), np.uint8).astype(np.uint64)
        if len(x) < 3:
            return np.zeros(0, np.uint64)
        ends = np.cumsum([len(p) for _, p in held])
        owner = np.repeat(np.array([i for i, _ in held], np.uint64), [len(p) for _, p in held])
        pairs = (x[:-2] << np.uint64(48)) | (x[1:-1] << np.uint64(40)) | (x[2:] << np.uint64(32)) | owner[:-2]
        inside = np.ones(len(pairs), bool)
        for step in (1, 2):  # trigrams that reach into the next text
            at = ends - step
            inside[at[(at >= 0) & (at < len(pairs))]] = False
        pairs = np.sort(pairs[inside])
        return pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs

    def postings(self, trigram: str) -> np.ndarray:
        a, b, c = trigram.encode()
        code = np.uint64(a << 16 | b << 8 | c)
        return self.texts[np.searchsorted(self.codes, code) : np.searchsorted(self.codes, code, "right")]


class Scanner:
    def __init__(self, rules: list[tuple]):
        self.rules = []
        for kind, pattern, fold, group, least in rules:
            linear = LINEAR.get(kind) if (kind, pattern, fold, group, least) in MORE_RULES else None
            regex = re.compile(linear or pattern, re.A | re.I if fold else re.A)
            self.rules.append((kind, regex, "s" if linear else 0, group if not linear else "s", least, trigram_query(pattern)))

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text the spans as (start, rule, end), sorted."""
        index = BlockIndex(texts)
        postings = {g: index.postings(g) for rule in self.rules for x in rule[5] for g in x}
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for r, (_, regex, span, group, least, query) in enumerate(self.rules):
            if frozenset() in query:
                candidates: Iterable[int] = range(len(texts))
            else:
                both = lambda a, b: np.intersect1d(a, b, assume_unique=True)
                candidates = reduce(np.union1d, (reduce(both, sorted((postings[g] for g in x), key=len)) for x in query)).tolist()
            for i in candidates:
                for m in regex.finditer(texts[i]):
                    if m.end(group) - m.start(group) >= least:
                        out[i].append((m.start(span), r, m.end(span)))
        for spans in out:
            spans.sort()
        return out


@lru_cache(maxsize=4)
def scanner(rules: tuple[tuple, ...]) -> Scanner:
    return Scanner(list(rules))


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: list[tuple] = MORE_RULES) -> DataFrame:
    """Per row ``id_col`` and ``spans``: array of (kind, start, end) in code points, by start, then by rule.

    Of a kind, matches are leftmost and do not overlap; kinds may. A null text counts as empty and has no
    spans. Repeated rows and null ids give a row each, an empty table an empty result; other columns are ignored. Very
    long texts are indexed in parts and scanned whole, in time linear in their length.
    """
    rules = tuple(BASE_RULES + more)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [[{"kind": s.rules[r][0], "start": a, "end": b} for a, r, b in x] for x in s.scan([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=[id_col, "spans"])

    part = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    return map_arrow(part, run, f"`{id_col}` {part.schema[0].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``."""
    found = secret_spans(documents(spark, sf_dir))
    base = [k for k, *_ in BASE_RULES]
    as_text = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    of_kinds = lambda kinds: F.filter("spans", lambda x: x["kind"].isin(kinds))
    joined = lambda spans: F.array_join(F.transform(spans, as_text), ",")
    return found.select(
        "doc_id",
        *(F.size(of_kinds([k])).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(joined(of_kinds(base)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def _op5_sql() -> str:
    """Matches by regexp_extract_all, their places by the lengths of what lies between (string_split_regex)."""
    parts, names = [], []
    for n, (kind, pattern, fold, group, least) in enumerate(BASE_RULES + MORE_RULES):
        p = "'" + ("(?i)" if fold else "") + pattern.replace("'", "''") + "'"
        parts.append(
            f"SELECT doc_id, {n} AS rule, '{kind}' AS kind, list_sum(list_transform(b[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[:i - 1], lambda x: length(x))), 0) AS start, length(f[i]) AS size, length(g[i]) AS measured, {least} AS least "
            f"FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS f, regexp_extract_all(text, {p}, {group}) AS g, string_split_regex(text, {p}) AS b FROM documents WHERE regexp_matches(text, {p})))"
        )
        names.append(kind)
    base = ", ".join(f"'{k}'" for k, *_ in BASE_RULES)
    span = "kind || ':' || start || ':' || (start + size)"
    return f"""WITH m AS ({" UNION ALL ".join(parts)}), k AS (SELECT doc_id, rule, kind, start::BIGINT AS start, size FROM m WHERE measured >= least),
t AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg({span}, ',' ORDER BY start, rule) FILTER (kind IN ({base})) AS base, string_agg({span}, ',' ORDER BY start, rule) AS spans FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id"""


OP5_SQL = _op5_sql()
