"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

The automaton of all items is broadcast, and every text is streamed through it word by word: its state and the length
of the longest match that ends at the word say which windows of items end there. A window is ``window`` consecutive
words of an item, or all words of a shorter one. A match of at least a window's length is hit as a whole; the state of its
last window, and the states of short items on the way to the root, name the items.

Items are cut into overlapping pieces, which share no window less, and pieces are dealt into blocks of about
``block_bytes``: an automaton is of bounded size. Where there is more than one block, texts are streamed once for each and the
spans of a text are united.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .licenses import WORD
from .work import documents, map_arrow, stored

#: Bytes of items, in lower case, that one automaton takes: about 170,000 words, 75 MB in a worker.
BLOCK_BYTES = 1 << 20
#: Windows of an item that one piece has.
PIECE_WINDOWS = 1_000
_LOWER = bytes((c | 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_WORD_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
Span = tuple[int, int]
#: Most words of a span and most coverage of a text that stay; None: no clean text is asked for.
Limits = tuple[int, float] | None


def words_of(text: str) -> list[bytes]:
    """Words of a text in UTF-8 with A-Z in lower case: runs of ASCII letters and digits and of other characters than ASCII."""
    return text.encode().translate(_LOWER).split()


class Piece(NamedTuple):
    item: int
    words: list[bytes]


class Automaton:
    """Suffix automaton of many word sequences.

    A state stands for the sequences that end at the same places in the pieces; ``length`` is that of the longest and ``link``
    leads to the state of the longest suffix that ends at more places.
    """

    def __init__(self, pieces: list[Piece], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.length, self.link = [0], [-1]
        edges: list[dict[int, int]] = [{}]
        ends = []
        for piece in pieces:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in piece.words]
            last = 0
            for w in ids:
                last = self._extended(edges, last, w)
            ends.append((piece.item, ids))
        self.states = len(edges)
        #: The next state by state * words + word.
        self.next = {v * len(self.vocabulary) + w: to for v, out in enumerate(edges) for w, to in out.items()}
        order = sorted(range(1, self.states), key=self.length.__getitem__)
        #: For a match of a window or more, the state whose sequences of ``window`` words are its last window.
        self.window_state = [-1] * self.states
        for v in order:
            if self.length[v] >= window:
                self.window_state[v] = v if self.length[self.link[v]] < window else self.window_state[self.link[v]]
        self.window_items: dict[int, list[int]] = defaultdict(list)
        #: Short items by their state, with their lengths.
        self.short_items: dict[int, list[Span]] = defaultdict(list)
        for item, ids in ends:
            v = 0
            for n, w in enumerate(ids, 1):
                v = edges[v][w]
                if n >= window:
                    self._add(self.window_items[self.window_state[v]], item)
            if len(ids) < window:
                self._add(self.short_items[v], (len(ids), item))
        #: The nearest state with short items, from the state itself towards the root; -1: none.
        self.short_state = [-1] * self.states
        for v in order:
            self.short_state[v] = v if v in self.short_items else self.short_state[self.link[v]]

    @staticmethod
    def _add(to: list, x: object) -> None:
        if not to or to[-1] != x:
            to.append(x)

    def _extended(self, edges: list[dict[int, int]], last: int, w: int) -> int:
        """The state of the sequence of ``last`` and ``w``, made where it is missing."""
        length, link = self.length, self.link

        def new(n: int, up: int, out: dict[int, int]) -> int:
            length.append(n)
            link.append(up)
            edges.append(out)
            return len(edges) - 1

        def split(at: int) -> int:
            """The state that ``w`` leads to from ``at``, cut so that its longest sequence is that of ``at`` and ``w``."""
            to = edges[at][w]
            if length[to] == length[at] + 1:
                return to
            part = new(length[at] + 1, link[to], dict(edges[to]))
            link[to] = part
            while at >= 0 and edges[at].get(w) == to:
                edges[at][w] = part
                at = link[at]
            return part

        if w in edges[last]:
            return split(last)
        state = new(length[last] + 1, 0, {})
        at = last
        while at >= 0 and w not in edges[at]:
            edges[at][w] = state
            at = link[at]
        if at >= 0:
            link[state] = split(at)
        return state

    def stream(self, words: list[bytes]) -> tuple[list[Span], set[int]]:
        """Spans of hit words, end exclusive, in order and apart; numbers of the items whose windows occur."""
        follow, link, length, short_state, window, wide = self.next.get, self.link, self.length, self.short_state, self.window, len(self.vocabulary)
        spans: list[Span] = []
        windows: set[int] = set()
        items: set[int] = set()
        state = matched = 0
        for i, w in enumerate(map(self.vocabulary.get, words)):
            if w is None:
                state = matched = 0
                continue
            to = follow(state * wide + w)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = follow(state * wide + w)
            if to is None:
                continue
            state = to
            matched += 1
            if matched >= window:
                windows.add(self.window_state[state])
                start = i + 1 - matched
            elif short_state[state] < 0:
                continue
            else:
                start = i + 1
            at = short_state[state]
            while at > 0:
                for n, item in self.short_items[at]:
                    if n <= matched:
                        items.add(item)
                        start = min(start, i + 1 - n)
                at = short_state[link[at]]
            if start > i:
                continue
            while spans and start <= spans[-1][1]:
                start = min(start, spans.pop()[0])
            spans.append((start, i + 1))
        for v in windows:
            items.update(self.window_items[v])
        return spans, items


def without_spans(text: str, spans: list[Span], n_words: int, most_words: int, most_coverage: float) -> str:
    """The text without the spans of more than ``most_words`` words, and without any where they cover more than ``most_coverage`` of its words."""
    if sum(b - a for a, b in spans) <= most_coverage * n_words:
        spans = [s for s in spans if s[1] - s[0] > most_words]
    if not spans:
        return text
    data = text.encode()
    places = [m.span() for m in _WORD_BYTES.finditer(data)]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, data[at:]]).decode()


def united(spans: Iterable[Span]) -> list[Span]:
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def pieces_of(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Rows of item, start and words: pieces that overlap by a word less than a window, so that every window is in one."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    t = items.select(F.col(id_col).cast("string").alias("item"), F.regexp_extract_all(F.translate(F.col(text_col), capitals, capitals.lower()), F.lit(WORD), F.lit(0)).alias("words"))
    t = t.where(F.size("words") > 0).withColumn("start", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - window), F.lit(PIECE_WINDOWS))))
    return t.select("item", "start", F.slice("words", F.col("start") + 1, F.lit(PIECE_WINDOWS + window - 1)).alias("words"))


def automata(items: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[tuple[Automaton, list[str | None]]]:
    """The automaton and the item ids of each block; only one block is on the driver at a time."""
    pieces = pieces_of(items, id_col, text_col, window)
    pieces = stored(pieces.withColumn("bytes", F.octet_length(F.array_join("words", " ")).cast("long")), "pieces")
    blocks = -(-(pieces.agg(F.sum("bytes")).first()[0] or 0) // block_bytes)
    for block in range(blocks):
        rows = pieces.where(F.pmod(F.xxhash64("item", "start", "words"), F.lit(blocks)) == block).select("item", "words").toArrow().to_pylist()
        ids = sorted({r["item"] for r in rows}, key=lambda x: (x is None, x))
        number = {x: i for i, x in enumerate(ids)}
        yield Automaton([Piece(number[r["item"]], [w.encode() for w in r["words"]]) for r in rows], window), ids


def facts(ids: pa.Array, texts: list[str | None], spans: list[list[Span]], items: list[list[str]], limits: Limits) -> pa.RecordBatch:
    n_words = [len(words_of(t or "")) for t in texts]
    arrays = [ids, pa.array(n_words, pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], SPANS), pa.array(items, pa.list_(pa.string()))]
    if limits:
        arrays.append(pa.array([without_spans(t, s, n, *limits) if s else t for t, s, n in zip(texts, spans, n_words, strict=True)], pa.string()))
    return pa.RecordBatch.from_arrays(arrays, names=["id", "n_words", "spans", "items", "clean_text"][: len(arrays)])


def schema_of(df: DataFrame, limits: Limits) -> str:
    """Of ``facts``; the first column of ``df`` is the id."""
    out = f"`{df.columns[0]}` {df.schema[0].dataType.simpleString()}, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
    return out + (", clean_text string" if limits else "")


def streamed(df: DataFrame, block: Broadcast | None, limits: Limits) -> DataFrame:
    """Facts of every row of (id, text) against one automaton."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, ids = block.value if block else (None, [])
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [automaton.stream(words_of(t or "")) if automaton else ([], ()) for t in texts]
            yield facts(batch.column(0), texts, [s for s, _ in found], [[ids[i] for i in sorted(x) if ids[i] is not None] for _, x in found], limits)

    return map_arrow(df, run, schema_of(df, limits))


def in_blocks(df: DataFrame, blocks: list[Broadcast], limits: Limits) -> DataFrame:
    """As ``streamed`` against several automata, one after the other: what they find is united per row."""
    id_col, text_col = df.columns
    rows = stored(df.withColumn("__uid", F.monotonically_increasing_id()), "texts")
    hits = [streamed(rows.select("__uid", text_col), b, None).where(F.size("spans") > 0).select("__uid", "spans", "items") for b in blocks]
    hits = stored(reduce(DataFrame.unionAll, hits), "hits").groupBy("__uid").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [united((x["start"], x["end"]) for x in s or ()) for s in batch.column(2).to_pylist()]
            yield facts(batch.column(0), batch.column(1).to_pylist(), spans, [sorted(x or ()) for x in batch.column(3).to_pylist()], limits)

    return map_arrow(rows.join(hits, "__uid", "left").select(id_col, text_col, "spans", "items"), run, schema_of(df, limits))


def decontaminate(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    window: int = 10, most_words: int = 9, most_coverage: float = 0.2, texts: bool = True, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per row ``id_col``, ``n_words``, ``spans`` (word numbers from 0, end exclusive), ``items`` (ids as strings, in order) and ``clean_text``.

    ``spans`` hold the words inside any occurrence of an item's window. ``clean_text`` is the text without those of more than
    ``most_words`` words; where spans cover more than ``most_coverage`` of a text's words, all of them go. ``texts`` = False leaves
    that column out. Null and empty texts have no words and no spans, and a null text stays null. An item without words has no
    window; one without an id hits words but is not listed; repeated items are one. Rows that repeat and rows without an id are each
    told by themselves. No items or no rows give no spans or an empty result. Long texts are streamed whole; other columns are ignored.
    """
    spark = df.sparkSession
    limits = (most_words, most_coverage) if texts else None
    part = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    blocks = [spark.sparkContext.broadcast(a) for a in automata(items, item_id_col, item_text_col, window, block_bytes)]
    if len(blocks) > 1:
        return in_blocks(part, blocks, limits)
    return streamed(part, blocks[0] if blocks else None, limits)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every whole text of ``documents`` against all of ``benchmark``."""
    out = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), texts=False)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    out = out.withColumn("n_hit", n_hit).withColumn("items", F.array_sort("items"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), v AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), p AS (
  SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d
), g AS MATERIALIZED (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM p, (SELECT DISTINCT n FROM v) WHERE i + n - 1 <= len(w)
), h AS (
  SELECT r, i, n, item_id FROM g JOIN v USING (n, x)
), k AS (
  SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r
), t AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k ON k.r = d.r LEFT JOIN t ON t.r = d.r
"""
