"""Language identification: words first, backing off to shorter and shorter character n-grams.

A word known from training is scored by its log frequency in each language. An unseen word is scored by
its longest character n-grams (with word borders) that the model knows: where it has none, the next
shorter ones are looked up and count for less with each step.

The model holds every word and n-gram of the training sample, once seen or often, as a sorted array of 64-bit hashes
with the languages that have it: 12 bytes a string and 8 for each of its languages.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import documents, map_arrow

WORD = re.compile(r"[^\W\d_]+")
#: Bounds of what is learned from, a hash sample of distinct labelled texts: texts of a language, and of all languages
#: together, of which each has an equal part but LEAST_ROWS. All that the model holds comes from these.
TRAIN_ROWS, TRAIN_TOTAL, LEAST_ROWS = 4_000, 64_000, 50
LONGEST = 4
#: What a step to shorter n-grams leaves of a word's weight; count added to every string.
BACKOFF = 0.4
SMOOTH = 0.1
#: Distinct words counted before a task hands them on, n-grams hashed and scores computed at a time.
HELD, GRAMS, CELLS = 50_000, 1 << 20, 1 << 22

_U = np.uint64


def word_counts(text: str) -> Counter:
    """Words of a text; those of a long one are never all in memory."""
    return Counter(WORD.findall(text)) if len(text) < 1 << 20 else Counter(m.group() for m in WORD.finditer(text))


def word_keys(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), _U, len(words))


def gram_keys(words: list[str], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of words and hashes of their runs of ``n`` characters; with word borders for n > 1."""
    return run_keys([f"<{w}>" for w in words] if n > 1 else words, n)


def run_keys(words: list[str], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
    for at in range(0, len(codes) - n + 1, GRAMS):
        end = min(at + GRAMS, len(codes) - n + 1)
        inside = np.flatnonzero(owner[at:end] == owner[at + n - 1 : end + n - 1])
        h = np.full(len(inside), n, _U)
        for k in range(n):
            h = (h ^ codes[at + k : end + k][inside]) * _U(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> _U(29))) * _U(0x94D049BB133111EB)
            h ^= h >> _U(32)
        yield owner[at:end][inside], h


class Model:
    """Log frequencies of words (kind 0) and n-grams (kind n) in each language; only those of languages that have the string are held.

    ``kinds``, ``keys``, ``langs`` and ``counts`` are columns of a table with a row per string and language; ``langs``
    are numbers of ``languages``.
    """

    def __init__(self, languages: list[str], kinds: np.ndarray, keys: np.ndarray, langs: np.ndarray, counts: np.ndarray):
        self.languages = languages
        order = np.lexsort((langs, kinds, keys))
        kinds, keys, self.langs, counts = kinds[order], keys[order], langs[order].astype(np.int32), counts[order].astype(np.float64)
        new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.kinds, self.starts = keys[new], kinds[new].astype(np.int8), np.append(new, len(keys))
        self.more = (np.log(counts + SMOOTH) - math.log(SMOOTH)).astype(np.float32)
        held = np.bincount(self.kinds, minlength=LONGEST + 1)
        totals = np.bincount(kinds.astype(np.int64) * len(languages) + self.langs, counts, (LONGEST + 1) * len(languages)).reshape(LONGEST + 1, -1)
        #: By kind and language: the log of a string that the language does not have.
        self.absent = math.log(SMOOTH) - np.log(totals + SMOOTH * (held[:, None] + 1))

    @classmethod
    def of(cls, counts: dict[int, dict[str, dict[str, float]]]) -> Model:
        """From plain counts: by kind, string and language."""
        languages = sorted({x for table in counts.values() for row in table.values() for x in row})
        key = lambda kind, x: next(run_keys([x], kind))[1][0] if kind else word_keys([x])[0]
        rows = [(kind, key(kind, x), languages.index(lang), c) for kind, table in counts.items() for x, row in table.items() for lang, c in row.items() if c]
        column = lambda i, t: np.array([r[i] for r in rows], t)
        return cls(languages, column(0, np.int64), column(1, _U), column(2, np.int64), column(3, np.float64))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the strings with these hashes; -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, at, -1)

    def entries(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What scores the words: numbers of words, rows of the model, weights."""
        rows = self.find(word_keys(words))
        known = np.flatnonzero(rows >= 0)
        found = [(known, rows[known], np.ones(len(known)))]
        left, weight = np.flatnonzero(rows < 0), 1.0
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            hits = [np.zeros(0, np.int64)]
            for owner, keys in gram_keys([words[i] for i in left], n):
                rows = self.find(keys)
                at = np.flatnonzero(rows >= 0)
                hits.append(left[owner[at]])
                found.append((hits[-1], rows[at], np.full(len(at), weight / n)))
            left, weight = np.setdiff1d(left, np.concatenate(hits)), weight * BACKOFF
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Logs by word and language."""
        k = len(self.languages)
        word, row, weight = self.entries(words)
        by_kind = np.bincount(word * (LONGEST + 1) + self.kinds[row], weight, len(words) * (LONGEST + 1)).reshape(len(words), -1)
        out = np.zeros((len(words), k))
        for kind in range(LONGEST + 1):  # not a matrix product, whose rounding depends on the other rows
            out += by_kind[:, kind, None] * self.absent[kind]
        start, n = self.starts[row], self.starts[row + 1] - self.starts[row]
        held = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
        return out + np.bincount(np.repeat(word, n) * k + self.langs[held], self.more[held] * np.repeat(weight, n), len(words) * k).reshape(out.shape)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language of each text and its posterior; ``und`` and 0 where it has no letter or nothing was learned."""
        out, k = [("und", 0.0)] * len(texts), len(self.languages)
        docs, counted = [], []
        for i, text in enumerate(texts if k else []):
            c = word_counts((text or "").lower())
            if any(x.isalpha() for w in c for x in w):
                docs.append(i)
                counted.append(c)
        step = max(1, CELLS // max(1, k))
        for a in range(0, len(docs), step):
            part = counted[a : a + step]
            logs = np.zeros((len(part), k))
            word = [w for c in part for w in c]
            of, n = np.repeat(np.arange(len(part)), [len(c) for c in part]), np.array([x for c in part for x in c.values()], np.float64)
            for b in range(0, len(word), step):
                number = {w: i for i, w in enumerate(dict.fromkeys(word[b : b + step]))}
                scores = self.word_scores(list(number))
                np.add.at(logs, of[b : b + step], scores[[number[w] for w in word[b : b + step]]] * n[b : b + step, None])
            logs /= np.sqrt(np.bincount(of, n))[:, None]  # words depend on one another
            best = logs.argmax(axis=1)
            share = 1 / np.exp(logs - logs.max(axis=1)[:, None]).sum(axis=1)
            for i, x, p in zip(docs[a : a + step], best.tolist(), share.tolist(), strict=True):
                out[i] = (self.languages[x], p)
        return out


def string_counts(words: dict[str, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Kinds, hashes and counts of counted words and their n-grams."""
    names, n = list(words), np.fromiter(words.values(), np.int64, len(words))
    yield 0, word_keys(names), n
    for kind in range(1, LONGEST + 1):
        for owner, keys in gram_keys(names, kind):
            each, at = np.unique(keys, return_inverse=True)
            yield kind, each, np.bincount(at, n[owner], len(each)).astype(np.int64)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, total: int = TRAIN_TOTAL) -> Model:
    """Learn from rows with a language and a text; about ``rows`` distinct texts of each language, chosen by a hash of the text.

    With more than ``total`` / ``rows`` languages it is about ``total`` / languages texts of each, but LEAST_ROWS. Every
    language is learned, and every word and n-gram of the sample. What reaches the driver is a row of numbers for each
    string and language of the sample. No usable row, or an empty table: an empty model.
    """
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = usable.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")).collect()
    languages = sorted(r["lang"] for r in sizes)
    at = {lang: i for i, lang in enumerate(languages)}
    most = min(rows, max(LEAST_ROWS, total // max(1, len(languages))))
    table = pa.table({"kind": pa.array([], pa.int32()), "key": pa.array([], pa.int64()), "lang": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
    if languages:
        shares = usable.sparkSession.createDataFrame([(r["lang"], min(1.0, 1.05 * most / r["n"])) for r in sizes], "lang string, share double")
        part = usable.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
        part = part.select("lang", "text").dropDuplicates()  # copies share a hash

        def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, Counter] = defaultdict(Counter)

            def out() -> Iterator[pa.RecordBatch]:
                for lang, words in held.items():
                    for kind, keys, n in string_counts(words):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), at[lang], np.int32)), pa.array(n)], names=["kind", "key", "lang", "n"])
                held.clear()

            for batch in batches:
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    held[lang].update(word_counts(text.lower()))
                    if sum(map(len, held.values())) > HELD:
                        yield from out()
            yield from out()

        counts = map_arrow(part, count, "kind int, key bigint, lang int, n bigint")
        table = counts.groupBy("kind", "key", "lang").agg(F.sum("n").alias("n")).toArrow()
    column = lambda c: table.column(c).to_numpy()
    return Model(languages, column("kind").astype(np.int64), column("key").view(_U), column("lang").astype(np.int64), column("n"))


def identify(df: DataFrame, model: Model, text_col: str = "text", least: float | None = None, names: tuple[str, str] = ("lang_pred", "score"), carry: tuple[str, ...] | None = None) -> DataFrame:
    """All columns of ``df``, or those of ``carry``, and ``names``: the language and its score (0 to 1: the posterior of the language); rows below ``least`` or ``und`` go where it is given.

    ``und`` with score 0 for a null or empty text, one without a letter, or an empty model. Equal texts get
    equal results; an empty table gives an empty one. Columns of those names in ``df`` are replaced. Very long texts
    count whole. A map over the scan with the model broadcast, whose size the bounds of ``train`` bound.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    own = [c for c in (df.columns if carry is None else carry) if c not in names]
    n = len(own)
    at = own.index(text_col) if text_col in own else n
    part = df.select(*own, *([F.col(text_col).alias("__text")] if at == n else []))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = m.predict(batch.column(at).to_pylist())
            out = pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*own, *names])
            yield out if least is None else out.filter(pa.array([f[0] != "und" and f[1] >= least for f in found], pa.bool_()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema[:n])
    return map_arrow(part, run, f"{schema}{', ' * bool(schema)}`{names[0]}` string, `{names[1]}` double")


def held_out() -> Column:
    """Documents that are never learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those that are not held out."""
    docs = documents(spark, sf_dir)
    model = train(docs.where(~F.coalesce(held_out(), F.lit(True))))
    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")
